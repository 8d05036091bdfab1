"""Paged sources: pushed filters, streams that go on; table functions from SQL."""

import pytest
from pyspark.sql import functions as F

from adweave.functions import table_functions
from adweave.sources.paged import PagedReader, PagedStream, file_fetch, file_pages, file_sources, paged_source, register, write_pages
from adweave.streaming.base import drained

COLUMNS = "event_id long, source string, modified long"


def service(spark, folder, ids):
    rows = spark.createDataFrame([(i, 1000 + i, "ab"[i % 2]) for i in ids], "event_id long, modified long, kind string")
    write_pages(rows, folder, F.col("kind"), F.floor(F.col("event_id") / 10))


def source(fetch=None, most=3):
    return paged_source("adweave_test_pages", COLUMNS, fetch or file_fetch(["event_id", "source", "modified"]), file_sources, file_pages, "source", "modified", most)


def test_pushed_filters_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "pages")
    service(spark, folder, range(60))
    register(spark, source(most=100))
    rows = spark.read.format("adweave_test_pages").option("folder", folder).load()
    got = rows.filter("source = 'a' AND modified > 1020 AND event_id <> 40")
    assert sorted(r.event_id for r in got.collect()) == [i for i in range(22, 60, 2) if i != 40]
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    reader = PagedReader(source(most=100), {"folder": folder})
    left = list(reader.pushFilters([EqualTo(("source",), "a"), GreaterThan(("modified",), 1020), LessThan(("event_id",), 50)]))
    assert left == [LessThan(("event_id",), 50)] and reader.only == ["a"] and reader.after == 1020
    parts = reader.partitions()
    assert [p.source for p in parts] == ["a"] and [r[0] for p in parts for r in reader.read(p)] == list(range(22, 60, 2))


def test_pages_are_followed_up_to_the_limit(spark, tmp_path):
    folder, calls = str(tmp_path / "pages"), []
    service(spark, folder, [*range(20), *range(40, 90)])  # pages 2 and 3 are missing
    real = file_fetch(["event_id", "source", "modified"])
    reader = PagedReader(source(lambda o, s, t: calls.append((s, t)) or real(o, s, t)), {"folder": folder})
    got = sorted(r[0] for p in reader.partitions() for r in reader.read(p))
    assert got == [*range(20), *range(40, 50)] and calls == [(s, t) for s in "ab" for t in range(3)]
    assert PagedReader(source(), {"folder": str(tmp_path / "none")}).partitions() == []


def test_a_restarted_stream_neither_skips_nor_repeats(spark, tmp_path):
    folder, state = str(tmp_path / "pages"), str(tmp_path / "state")
    register(spark, source())
    seen = []
    for ids in (range(30), [], range(30, 75), range(80, 85)):
        if len(ids):
            service(spark, folder, ids)
        rows = drained(spark.readStream.format("adweave_test_pages").option("folder", folder).load(), at=state)
        seen.append(sorted(r.event_id for r in rows.collect()))
    assert seen == [list(range(30)), list(range(30)), list(range(75)), [*range(75), *range(80, 85)]]
    stream = PagedStream(source(), {"folder": folder})
    end = stream.latestOffset()
    assert [(p.source, p.first, p.end) for p in stream.partitions({"a": "2"}, end)] == [("a", 2, int(end["a"])), ("b", 0, int(end["b"]))]
    assert stream.partitions(end, end) == []


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [("x", 90.0, True, 3), ("x", 70.0, True, 3), ("x", 10.0, False, 9), ("y", 50.0, True, 2), ("z", None, True, 12), (None, 80.0, True, 10)]
    spark.createDataFrame(rows, "kind string, score double, was_correct boolean, n long").createOrReplaceTempView("t_scores")
    got = {r.kind: (r.rows, r.threshold) for r in spark.sql("SELECT * FROM optimal_threshold(TABLE(t_scores) PARTITION BY kind)").collect()}
    assert got == {"x": (15, 75), "y": (2, 40), "z": (12, 40), None: (10, 80)}
    few = {r.kind: r.threshold for r in spark.sql("SELECT * FROM optimal_threshold(TABLE(t_scores) PARTITION BY (kind), 100)").collect()}
    assert set(few.values()) == {40}
    assert spark.sql("SELECT * FROM optimal_threshold(TABLE(SELECT * FROM t_scores WHERE n > 99) PARTITION BY kind)").count() == 0
    for bad in ("optimal_threshold(TABLE(SELECT 1 AS a) PARTITION BY a)", "optimal_threshold(3)", "link_counts(TABLE(t_scores) PARTITION BY kind)"):
        with pytest.raises(Exception, match="table|column|lacks"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    spark.createDataFrame([(1, 2, True), (1, 0, False), (1, 3, True), (2, 0, False), (2, 5, None)], "key long, tier int, ok boolean").createOrReplaceTempView("t_tries")
    assert sorted(map(tuple, spark.sql("SELECT * FROM first_tier(TABLE(t_tries))").collect())) == [(1, 2, True, 2), (2, 5, False, 2)]


def test_many_pages_are_few_files_and_many_ranges(spark, tmp_path):
    """A file holds a block of pages, and ranges of pages are read by tasks of their own, each page once."""
    from adweave.sources.paged import SPAN

    folder = str(tmp_path / "pages")
    service(spark, folder, range(0, 6_000, 2))  # 600 pages of one source
    service(spark, folder, range(6_000, 6_010))  # a page of a block that is there, and a second source
    assert len(list((tmp_path / "pages").rglob("*.json"))) < 20
    plug = source(most=1 << 30)
    reader = PagedReader(plug, {"folder": folder})
    parts = reader.partitions()
    assert SPAN == 256 and [(p.source, p.first, p.end) for p in parts] == [("a", 0, 256), ("a", 256, 512), ("a", 512, 601), ("b", 0, 1)]
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted([*range(0, 6_000, 2), *range(6_000, 6_010)])
    stream = PagedStream(plug, {"folder": folder})
    assert [(p.first, p.end) for p in stream.partitions({"a": "300"}, {"a": "600"})] == [(300, 512), (512, 600)]
