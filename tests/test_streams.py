"""Streams over files one at a time in shuffled order, timers, state with a time to live, and replayed sinks."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from adweave.streaming.base import drained, read_arriving
from adweave.streaming.limits import LADDER, Timeouts
from adweave.streaming.ordered import Buffer, Cache, Claim, Heartbeats, HostPolicy, Throttle, in_order, live_cache
from adweave.streaming.sinks import LedgerSink, matches_with_alerts

START = dt.datetime(2024, 1, 1)
SCHEMA = "host long, ts timestamp, event_id long, kind string, strategy string"


def files(spark, folder, rows, n):
    """rows (host, seconds, event_id, kind, strategy) as n files in a shuffled order, and a last one with a far time."""
    rng = random.Random(3)
    rows = rows[:]
    rng.shuffle(rows)
    for k in range(n):
        part = [(h, START + dt.timedelta(seconds=s), *x) for h, s, *x in rows[k::n]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([(-1, dt.datetime(2100, 1, 1), None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return read_arriving(spark, str(folder), spark.read.parquet(str(folder)).schema, 1)


def events(kinds=("images", "blocked", "timeout", "pin", "release", "reset")):
    rng = random.Random(1)
    return [(i % 4, rng.randrange(900), i, rng.choices(kinds, [2, 5, 5, 1, 1, 0.3][: len(kinds)])[0], rng.choice(LADDER)) for i in range(240)]


def by_hand(machine, rows, until=None):
    out = []
    for host in sorted({r[0] for r in rows}):
        state = machine.start
        own = sorted((int((START + dt.timedelta(seconds=s)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6), *x) for h, s, *x in rows if h == host)
        for at, event, kind, strategy in [*own, (2**62, None, None, None)]:
            while (end := machine.deadline(state)) is not None and end <= at:
                state, new = machine.expire(state, end)
                out += [(host, *x) for x in new]
            if event is not None:
                payload = {"event_id": event, "kind": kind, "strategy": strategy}
                state, new = machine.step(state, at, tuple(payload[p.split()[0]] for p in machine.payload.split(", ")))
                out += [(host, *x) for x in new]
    return sorted(out, key=str)


@pytest.mark.parametrize("machine", [Throttle(60_000_000), HostPolicy(), Heartbeats(30_000_000, 45_000_000), Cache((30, 60, 1800))], ids=lambda m: type(m).__name__)
def test_shuffled_files_one_at_a_time(spark, tmp_path, machine):
    """Late rows of a micro-batch come before earlier ones of another: the result is that of the rows in order."""
    rows = events(("images", "blocked", "invalidate") if isinstance(machine, Cache) else ("images", "blocked", "timeout", "pin", "release", "reset"))
    got = drained(in_order(files(spark, tmp_path / "in", rows, 4), "host", machine, "1000 seconds")).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(machine, rows)


def test_policy_rules():
    """Two failures promote, a success resets the count and not the rung, a pinned host stays, the last rung is sticky."""
    m = HostPolicy()

    def run(*kinds):
        state = m.start
        for kind, *strategy in (k.split(":") for k in kinds):
            state, out = m.step(state, 0, (1, kind, strategy[0] if strategy else None))
        return out[0][1:5]

    assert run("blocked") == (LADDER[0], 1, False, 0)
    assert run("blocked", "timeout") == (LADDER[1], 0, False, 0)
    assert run("blocked", "images", "blocked") == (LADDER[0], 1, False, 1)
    assert run("blocked", "blocked", "images") == (LADDER[1], 0, False, 1)
    assert run("pin:screenshotone_only", *["blocked"] * 5) == ("screenshotone_only", 5, True, 0)
    assert run("pin:screenshotone_only", *["blocked"] * 5, "release", "blocked") == ("screenshotone_residential", 0, False, 0)
    assert run(*["blocked"] * 13) == ("unreachable", 3, False, 0)
    assert run(*["blocked"] * 13, "reset") == (LADDER[0], 0, False, 0)


def test_buffer_and_claim():
    b, state, out = Buffer(3), Buffer.start, []
    for i, kind in enumerate(["", "", "", "", "close", "close", ""]):
        state, new = b.step(state, i, (i, kind))
        out += new
    assert out == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 2, 4)] and state == ([6], 2)
    k, state, won = Claim(), Claim.start, []
    for i, kind in enumerate(["", "", "release", "", ""]):
        state, new = k.step(state, i, (i, kind))
        won += new
    assert won == [(0, True), (1, False), (3, True), (4, False)]


def test_timeouts():
    assert Timeouts().idle_minutes > Timeouts().cap_minutes
    with pytest.raises(ValueError, match="cap"):
        Timeouts(idle_minutes=20)


def test_live_cache(spark, tmp_path):
    """Entries are there within their time to live and gone after it; the longer one outlives the shorter."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "host long, name string, loaded string"
    folder, seen = str(tmp_path / "in"), []

    def lookup(value):
        spark.createDataFrame([(1, "a", value)], schema).coalesce(1).write.mode("append").parquet(folder)
        q = live_cache(spark.readStream.schema(schema).parquet(folder), "host", 300, 3).writeStream.trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state"))
        q = q.foreachBatch(lambda b, n: seen.extend(tuple(r)[2:] for r in b.collect())).start()
        had, end = len(seen), time.time() + 40
        while len(seen) == had and time.time() < end:  # such a query has no end of its own
            time.sleep(0.2)
        q.stop()
        return seen[-1]

    assert lookup("first") == (False, False, "first", "first")
    time.sleep(4)
    assert lookup("second") == (True, False, "first", "second")


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = [(1, 10, 7, "violation"), (2, 11, 99, "violation"), (3, 12, None, "compliant"), (1, 10, 7, "violation")]
    batch = spark.createDataFrame(rows, "match_id long, price long, distributor_id long, status string")
    dealers = spark.createDataFrame([(7,), (7,)], "distributor_id long")
    sink = LedgerSink(spark, matches_with_alerts(["match_id", "price"], dealers), str(tmp_path / "sink"))
    sink.write(batch, 0)
    before = sorted(map(tuple, sink.table("matches").collect()), key=str), sorted(map(tuple, sink.table("alerts").collect()), key=str)
    assert len(before[0]) == 3 and {r[3] for r in before[0]} == {7, None}
    assert {a[0] for a in before[1]} == {r[0] for r in before[0] if r[4] == "violation"}
    batch.write.parquet(f"{sink.path}/matches/batch=1")  # a try that broke off before its ledger line
    sink.write(batch, 0)
    sink.write(batch.limit(1), 0)
    assert (sorted(map(tuple, sink.table("matches").collect()), key=str), sorted(map(tuple, sink.table("alerts").collect()), key=str)) == before
    sink.write(batch.filter("match_id = 3").withColumn("match_id", F.lit(4).cast("long")), 1)
    assert sink.batches() == [0, 1] and sink.table("matches").count() == 4


def test_rows_are_made_once(spark, tmp_path):
    """Instalments come from one pass over the rows, and a batch's alerts from its stored matches."""
    from adweave.streaming.base import arriving

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "match_id long, price long, distributor_id long, status string"
    rows = spark.createDataFrame([(i, 10, 7, "violation" if i % 2 else "compliant") for i in range(40)], schema).mapInArrow(counted, schema)
    at, span = arriving(rows, F.col("match_id"), 4)
    assert made.value == 40 and span == 10 and spark.read.parquet(at).count() == 40
    sink = LedgerSink(spark, matches_with_alerts(["match_id", "price"], spark.createDataFrame([(7,)], "distributor_id long")), str(tmp_path / "sink"))
    sink.write(rows, 0)
    assert made.value == 80 and sink.table("matches").count() == 40 and sink.table("alerts").count() == 20
