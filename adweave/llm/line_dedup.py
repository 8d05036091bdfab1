"""Line dedup by distinct-site spread [operator 10].

Every line gets a HyperLogLog sketch of the sites it appears on; sketches of map
tasks merge in the aggregation. Lines whose estimate is clearly at or over the
threshold are boilerplate, lines near it get an exact distinct count, and the
documents lose their boilerplate lines. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, small

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers; the standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this share of the threshold are settled by an exact count (four standard errors).
NEAR = 4 * 1.04 / 2 ** (LG_K / 2)


def _key(line: Column) -> Column:
    return F.xxhash64(line)


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row per non-blank line: doc_id, site, h1, h2 (a 128-bit key of the trimmed line)."""
    line = F.explode(F.split(F.col("text"), "\n")).alias("line")
    lines = docs.select(F.col("doc_id"), F.col(site).alias("site"), line).withColumn("line", F.trim("line"))
    return lines.filter(F.col("line") != "").select("doc_id", "site", _key(F.col("line")).alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Keys (h1, h2) of the lines on min_sites distinct sites or more. Null sites don't count."""
    spread = cut(
        lines.filter(F.col("site").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("est"))
        .filter(F.col("est") >= min_sites * (1 - near))
    )
    clear = spread.filter(F.col("est") > min_sites * (1 + near)).select("h1", "h2")
    close = spread.filter(F.col("est") <= min_sites * (1 + near)).select("h1", "h2")
    exact = (
        lines.join(small(close), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site")
        .filter(F.col("site").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.countDistinct("site").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("h1", "h2")
    )
    return cut(clear.unionByName(exact))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, whole_copies: bool = False) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of text, plus n_lines and n_removed.

    A line counts as its text without spaces at either end; blank lines are never
    removed and count in n_lines. Every occurrence of a boilerplate line goes. With
    whole_copies, documents without any other non-blank line count as copies as a whole,
    which near dedup deals with, and stay untouched.
    Null texts stay null with n_lines 0; empty texts stay empty with n_lines 1.
    Other columns pass through unchanged. doc_id must be unique; columns of docs
    named n_lines or n_removed are replaced. Rows with a null doc_id pass unchanged.
    """
    base = docs.drop("n_lines", "n_removed")
    lines = site_lines(base, site)
    flagged = boilerplate_lines(lines, min_sites, lg_k)
    bad = (
        lines.join(small(flagged), ["h1", "h2"], "left_semi")
        .select(F.col("doc_id").alias("__id"), "h1")
        .groupBy("__id")
        .agg(F.collect_set("h1").alias("__bad"))
    )
    parts = F.split(F.col("text"), "\n")
    kept = F.filter("__lines", lambda x: ~F.array_contains(F.col("__bad"), _key(F.trim(x))))
    out = base.join(bad, base["doc_id"] == bad["__id"], "left").withColumn("__lines", parts)
    out = out.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
    if whole_copies:
        copy = F.forall("__kept", lambda x: F.trim(x) == "")
        out = out.withColumn("__kept", F.when(F.col("__bad").isNotNull() & copy, F.col("__lines")).otherwise(F.col("__kept")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    text = F.when(F.size("__kept") == F.size("__lines"), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    names = [text.alias("text") if c == "text" else F.col(c) for c in base.columns]
    return out.select(
        *names,
        F.when(F.col("text").isNull(), 0).otherwise(n(F.col("__lines"))).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n(F.col("__lines")) - n(F.col("__kept"))).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), bad AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' AND source IS NOT NULL
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON trim(l.line, ' ') = b.line
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_gone, 0)::BIGINT AS n_removed,
  CASE WHEN p.n_gone > 0 THEN p.kept ELSE d.text END AS text
FROM documents d LEFT JOIN per p USING (doc_id)
"""
