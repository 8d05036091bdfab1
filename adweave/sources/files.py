"""CSV, JSON, XML and HTML sources, and a paged source by the Python data source API."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def normal_header(name: str) -> str:
    """Trimmed, lower case, runs of spaces and dashes as one underscore."""
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV with header: doubled quotes, line ends in quotes, any line end; short rows get empty cells, blank rows go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    cells = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(normal_header(c)) for c in raw.columns]
    out = raw.select(*cells)
    return out.filter(F.concat(*[F.col(c) for c in out.columns]) != "")


def write_manifest(cases: DataFrame, path: str, group: Column, version: int = 2) -> None:
    """Cases (struct column x) as a folder of JSON documents, one file for each value of group, for read_manifest."""
    docs = cases.groupBy(group.alias("group")).agg(F.lit(version).alias("version"), F.collect_list("x").alias("cases")).drop("group")
    docs.write.option("maxRecordsPerFile", 1).json(path)  # a multi-line reader takes one document a file


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cases of a JSON document with a list called cases, or of a folder of them."""
    doc = spark.read.schema(f"version int, cases array<struct<{schema}>>").option("multiLine", True).json(path)
    return doc.select("version", F.explode("cases").alias("case")).select("version", "case.*")


def sitemap_locations(xml: Column) -> Column:
    """loc entries of a sitemap, by XPath or, if it is no XML, by pattern."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*([^<]+?)\s*</(?:\w+:)?loc>"), F.lit(1))


def html_links(html: Column) -> Column:
    """Targets of href attributes, without anchors, mail, telephone and script links; each once."""
    found = F.regexp_extract_all(html, F.lit(r"""href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: (u != "") & ~u.rlike(r"^(#|mailto:|tel:|javascript:)")))


def resolved(base: Column, link: Column) -> Column:
    """link against the page's URL: absolute, scheme-relative, root-relative or relative to the folder."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]+.*/)[^/]*$", "$1")
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a base64 data: URI; null for anything else."""
    return F.when(uri.startswith("data:"), F.try_to_binary(F.element_at(F.split(uri, ","), -1), F.lit("base64")))


class _Page(InputPartition):
    def __init__(self, source: int) -> None:
        self.source = source


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, sources: int, most: int) -> None:
        self.fetch, self.sources, self.most = fetch, sources, most

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(self.sources)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        token = None
        for _ in range(self.most):
            rows, token = self.fetch(partition.source, token)
            yield from rows
            if token is None:
                return


def paged_source(name: str, columns: str, fetch: Callable, sources: int, most: int = 3) -> type[DataSource]:
    """A data source class that follows page tokens: fetch(source, token) gives (rows, next token or None); most pages a source."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return _PagedReader(fetch, sources, most)

    return Paged
