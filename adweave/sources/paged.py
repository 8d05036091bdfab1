"""A paged source by the Python data source API: pushed filters, page tokens, and a stream whose offsets are pages."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, InputPartition

#: fetch(options, source, token) gives (rows as tuples, next token or None); tokens are page numbers from 0.
Fetch = Callable[[dict, str, int], tuple[list[tuple], int | None]]
#: sources(options) lists them; pages(options, source) is how many there are by now.
Sources = Callable[[dict], list[str]]
Pages = Callable[[dict, str], int]


#: Pages that one task reads, at most.
SPAN = 256


class PageRange(InputPartition):
    """Pages first .. end - 1 of a source."""

    def __init__(self, source: str, first: int, end: int) -> None:
        self.source, self.first, self.end = source, first, end


def spans(source: str, first: int, end: int) -> list[InputPartition]:
    """Pages first .. end - 1 of a source in ranges of up to SPAN, cut at multiples of it."""
    edges = [first, *range(first // SPAN * SPAN + SPAN, end, SPAN), end]
    return [PageRange(source, a, b) for a, b in zip(edges, edges[1:]) if b > a]


class PagedReader(DataSourceReader):
    """Follows the tokens of each source, `most` pages at most, in ranges of SPAN pages that start from a token each. A pushed equality on the source column leaves other sources unread, a pushed lower bound on the time column rows that aren't newer."""

    def __init__(self, plug: type, options: dict) -> None:
        self.plug, self.options = plug, options
        self.only: list[str] | None = None
        self.after = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.plug.source_column,):
                self.only = [f.value]
            elif isinstance(f, GreaterThan) and f.attribute == (self.plug.time_column,):
                self.after = f.value if self.after is None else max(self.after, f.value)
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[InputPartition]:
        found, most = self.plug.sources(self.options), int(self.options.get("most", self.plug.most))
        return [x for s in found if self.only is None or s in self.only for x in spans(s, 0, min(most, self.plug.pages(self.options, s)))]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        token, time = partition.first, self.plug.time_index()
        while token is not None and token < partition.end:
            rows, token = self.plug.fetch(self.options, partition.source, token)
            yield from (r for r in rows if self.after is None or (r[time] is not None and r[time] > self.after))


class PagedStream(DataSourceStreamReader):
    """Offsets are the numbers of pages read of each source, so a stream that starts again goes on with the next page."""

    def __init__(self, plug: type, options: dict) -> None:
        self.plug, self.options = plug, options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: str(self.plug.pages(self.options, s)) for s in self.plug.sources(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [x for s, n in end.items() for x in spans(s, int(start.get(s, 0)), int(n))]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for token in range(partition.first, partition.end):
            yield from self.plug.fetch(self.options, partition.source, token)[0]

    def commit(self, end: dict) -> None:
        pass


def paged_source(label: str, columns: str, fetch: Fetch, sources: Sources, pages: Pages, source_column: str, time_column: str, most: int = 3) -> type[DataSource]:
    """A data source class over a paged service, to be registered with spark.dataSource.register; batch reads follow tokens over `most` pages at most (option most), streams read every page once."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        @classmethod
        def time_index(cls) -> int:
            return [x.split()[0] for x in columns.split(", ")].index(time_column)

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(type(self), dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PagedStream(type(self), dict(self.options))

    Paged.fetch, Paged.sources, Paged.pages = staticmethod(fetch), staticmethod(sources), staticmethod(pages)
    Paged.source_column, Paged.time_column, Paged.most = source_column, time_column, most
    return Paged


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


# A service that answers from files: what write_pages has written. rows/source=s/block=b has
# the rows of BLOCK page numbers, pages/source=s which pages are there; so the number of files
# follows from that of blocks and writes, and a page is found without a look at the others.

#: Page numbers of a block.
BLOCK = 256


def write_pages(rows: DataFrame, folder: str, source: Column, page: Column) -> None:
    """Add rows as JSON lines, by the columns source and page; what is written once stays as it is."""
    x = rows.withColumn("source", source).withColumn("page", page.cast("long")).withColumn("block", F.floor(F.col("page") / BLOCK))
    x.repartition("source", "block").write.mode("append").partitionBy("source", "block").json(f"{folder}/rows")
    known = x.groupBy("source", "block").agg(F.sort_array(F.collect_set("page")).alias("pages"))  # BLOCK numbers at most
    known.repartition("source").write.mode("append").partitionBy("source").json(f"{folder}/pages")


def _files(folder: str):
    from pyarrow.fs import FileSelector, FileSystem

    files, at = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return files, at, lambda path: files.get_file_info(FileSelector(path, allow_not_found=True))


def _parts(folder: str, path: str) -> tuple[str, ...]:
    """Paths of the JSON files in a folder; Spark gives each write's files names of their own, so a path stands for its content."""
    _, at, ls = _files(folder)
    return tuple(sorted(x.path for x in ls(f"{at}/{path}") if x.base_name.endswith(".json")))


def _lines(folder: str, paths: tuple[str, ...]) -> Iterator[dict]:
    files, _, _ = _files(folder)
    for path in paths:
        with files.open_input_stream(path) as f:
            yield from map(json.loads, f.read().decode().splitlines())


@functools.lru_cache(maxsize=8)
def _known(folder: str, paths: tuple[str, ...]) -> list[int]:
    return sorted({n for r in _lines(folder, paths) for n in r["pages"]})


@functools.lru_cache(maxsize=1)
def _block(folder: str, paths: tuple[str, ...]) -> dict[int, list[dict]]:
    """Rows of a block by page."""
    out: dict[int, list[dict]] = {}
    for r in _lines(folder, paths):
        out.setdefault(r["page"], []).append(r)
    return out


def _numbered(options: dict, source: str) -> list[int]:
    return _known(options["folder"], _parts(options["folder"], f"pages/source={source}"))


def file_sources(options: dict) -> list[str]:
    _, at, ls = _files(options["folder"])
    return sorted(x.base_name.removeprefix("source=") for x in ls(f"{at}/pages") if x.base_name.startswith("source="))


def file_pages(options: dict, source: str) -> int:
    return len(_numbered(options, source))


def file_fetch(names: list[str]) -> Fetch:
    """Fetches the columns `names` of the token-th page of a source; `source` is the source's name."""

    def fetch(options: dict, source: str, token: int) -> tuple[list[tuple], int | None]:
        numbers, rows = _numbered(options, source), []
        if token < len(numbers):
            number = numbers[token]
            block = _block(options["folder"], _parts(options["folder"], f"rows/source={source}/block={number // BLOCK}"))
            rows = [tuple(source if n == "source" else r.get(n) for n in names) for r in block.get(number, [])]
        return rows, token + 1 if token + 1 < len(numbers) else None

    return fetch
