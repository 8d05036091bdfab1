"""Registration of queries, table access and the proxy tables that stand for the domain's own.

The domain's tables (matches, assets, dealers, jobs, feedback) are derived from the
driver's tables, once as DataFrames and once as SQL for the checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register the decorated function of Tables under name, with the SQL that checks it."""

        def wrap(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = with_proxies(sql)
            return f

        return wrap


class Tables:
    """The driver's tables and the proxies over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in PROXIES:
            return PROXIES[name](self)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def case(value: Column, pairs: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(pairs.items())):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def _matches(t: Tables) -> DataFrame:
    li, od = t.lineitem, t.orders.select("o_orderkey", "o_orderpriority")
    c = F.col
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("match_id"),
        c("l_orderkey").alias("scan_job_id"),
        c("l_partkey").alias("asset_id"),
        F.when(c("l_suppkey") % 50 != 7, c("l_suppkey")).alias("distributor_id"),
        (c("l_quantity") * 2).alias("score"),
        c("l_shipdate").alias("created_at"),
        F.when(c("l_linenumber") % 3 != 0, F.date_add(F.to_date("l_shipdate"), c("l_linenumber"))).alias("last_seen"),
        case(c("l_returnflag"), {"A": "compliant", "R": "violation"}, "pending").alias("status"),
        (c("l_linestatus") == "O").alias("was_correct"),
        c("o_orderpriority").alias("channel"),
        c("l_extendedprice").alias("price"),
    )


def _assets(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select(
        c("p_partkey").alias("asset_id"),
        c("p_name").alias("name"),
        c("p_brand").alias("campaign_id"),
        (F.substring("p_brand", 7, 9).cast("int") % 5).alias("org_id"),
        c("p_type").alias("source_type"),
        F.when(c("p_size") % 3 == 0, F.array().cast("array<string>")).when(c("p_size") % 3 == 1, F.array(F.lit("instagram"))).otherwise(F.array(F.lit("facebook"), F.lit("instagram"))).alias("platforms"),
        c("p_size").alias("size"),
        c("p_retailprice").alias("retail"),
    )


def _dealers(t: Tables) -> DataFrame:
    n, s = t.nation, t.supplier
    c = F.col
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(  # one row a nation
        c("s_suppkey").alias("distributor_id"),
        c("s_name").alias("name"),
        c("n_regionkey").alias("org_id"),
        c("n_name").alias("region"),
        F.when(c("s_acctbal") >= 0, "active").otherwise("inactive").alias("status"),
        F.concat(F.lit("https://Dealer"), (c("s_suppkey") % 40).cast("string"), F.lit(".example.com/shop/")).alias("website"),
    )


def _jobs(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.select(
        c("o_orderkey").alias("job_id"),
        (c("o_custkey") % 5).cast("int").alias("org_id"),
        c("o_custkey").alias("campaign_no"),
        case(c("o_orderstatus"), {"F": "completed", "O": "running"}, "pending").alias("status"),
        c("o_orderpriority").alias("source"),
        c("o_orderdate").alias("created_at"),
        c("o_totalprice").alias("cost"),
    )


def _feedback(t: Tables) -> DataFrame:
    m = t.matches.join(t.assets.select("asset_id", "source_type"), "asset_id")
    verdict = F.when(F.col("was_correct"), F.when(F.col("status") == "pending", "true_negative").otherwise("true_positive")).otherwise(F.when(F.col("status") == "violation", "false_negative").otherwise("false_positive"))
    return m.select("match_id", "source_type", "channel", "was_correct", verdict.alias("verdict"), F.when(F.col("match_id") % 11 != 0, F.col("score")).alias("confidence"), "created_at")


PROXIES: dict[str, Callable[[Tables], DataFrame]] = {"matches": _matches, "assets": _assets, "dealers": _dealers, "jobs": _jobs, "feedback": _feedback}

_SQL = {
    "matches": """SELECT l_orderkey*10+l_linenumber AS match_id, l_orderkey AS scan_job_id, l_partkey AS asset_id,
      CASE WHEN l_suppkey % 50 <> 7 THEN l_suppkey END AS distributor_id, l_quantity*2 AS score, l_shipdate AS created_at,
      CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) + l_linenumber END AS last_seen,
      CASE l_returnflag WHEN 'A' THEN 'compliant' WHEN 'R' THEN 'violation' ELSE 'pending' END AS status,
      l_linestatus = 'O' AS was_correct, o_orderpriority AS channel, l_extendedprice AS price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "assets": """SELECT p_partkey AS asset_id, p_name AS name, p_brand AS campaign_id, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS org_id,
      p_type AS source_type, CASE p_size % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['instagram'] ELSE ['facebook','instagram'] END AS platforms,
      p_size AS size, p_retailprice AS retail FROM part""",
    "dealers": """SELECT s_suppkey AS distributor_id, s_name AS name, n_regionkey AS org_id, n_name AS region,
      CASE WHEN s_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status,
      'https://Dealer' || CAST(s_suppkey % 40 AS VARCHAR) || '.example.com/shop/' AS website
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "jobs": """SELECT o_orderkey AS job_id, CAST(o_custkey % 5 AS INTEGER) AS org_id, o_custkey AS campaign_no,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
      o_orderpriority AS source, o_orderdate AS created_at, o_totalprice AS cost FROM orders""",
    "feedback": """SELECT match_id, source_type, channel, was_correct,
      CASE WHEN was_correct THEN CASE WHEN m.status = 'pending' THEN 'true_negative' ELSE 'true_positive' END
           ELSE CASE WHEN m.status = 'violation' THEN 'false_negative' ELSE 'false_positive' END END AS verdict,
      CASE WHEN match_id % 11 <> 0 THEN score END AS confidence, created_at
      FROM matches m JOIN assets USING (asset_id)""",
}


def with_proxies(sql: str) -> str:
    """sql after common table expressions for the proxies that it names."""
    need = [k for k in _SQL if f" {k} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    if "feedback" in need:
        need = [k for k in _SQL if k in {*need, "matches", "assets"}]
    if not need:
        return sql
    ctes = ",\n".join(f"{k} AS ({_SQL[k]})" for k in need)
    body = sql.strip()
    return f"WITH {ctes}" + (f",\n{body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}")
