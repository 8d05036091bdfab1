"""Streams whose rows arrive late and out of order, over several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.base import arriving, drained, read_arriving
from ..streaming.limits import BUFFERED_IMAGES, CACHE_SECONDS, GRACE_READS, GRACE_SECONDS, LADDER
from ..streaming.ordered import Buffer, Cache, Claim, Heartbeats, HostPolicy, Throttle, in_order, micros
from ..streaming.sinks import LedgerSink, matches_with_alerts
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Rows arrive up to so much later than their time says.
LATE = 2 * DAY
#: The tables' events are hours apart and not seconds: times of the domain count for so much here.
SCALE = 3600
INSTALMENTS = 5


def late(t: Tables, rows: DataFrame, key: str, ts: str = "ts", files: int | None = None) -> tuple[DataFrame, int]:
    """The rows as a stream in the order of arrival, and how late in microseconds they can be behind the watermark.

    A row arrives up to LATE after its time, by a hash of its key columns; a closing row
    of key -1 and a far time lets the watermark pass the others.
    """
    arrival = micros(ts) + F.pmod(F.xxhash64(*rows.columns), F.lit(LATE))
    far = {key: F.lit(-1), ts: F.lit("2100-01-01")}
    closing = t.spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    at, span = arriving(rows, arrival, INSTALMENTS, closing)
    n = files or int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return read_arriving(t.spark, at, rows.schema, n), LATE + span + 1_000_000


def _kinds(**kinds: str):
    """A column of kinds by event type; '' where none is given."""
    out = F.lit("")
    for k, v in kinds.items():
        out = F.when(c("event_type") == k, F.lit(v)).otherwise(out)
    return out.alias("kind")


_E = "e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@R.add(
    "i2_throttle",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), t AS (SELECT user_id, event_id, rn, ts AS last, true AS emitted FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ts >= t.last + INTERVAL 1 HOUR THEN e.ts ELSE t.last END, e.ts >= t.last + INTERVAL 1 HOUR FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
    SELECT user_id, event_id FROM t WHERE emitted""",
)
def throttled(t: Tables) -> DataFrame:
    """Events within an hour of the last one emitted are dropped, in event-time order whatever the order of arrival."""
    rows, delay = late(t, t.events.select("user_id", "event_id", "ts"), "user_id")
    return drained(in_order(rows, "user_id", Throttle(HOUR), f"{delay} microseconds"))


@R.add(
    "i1_heartbeats",
    f"""WITH RECURSIVE {_E}, t AS (SELECT user_id, event_id, rn, us AS last, true AS emitted, us FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.us >= t.last + {HOUR} THEN e.us ELSE t.last END, e.us >= t.last + {HOUR}, e.us FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
    SELECT user_id, event_id, 'heartbeat' AS what, us AS "at" FROM t WHERE emitted
    UNION ALL SELECT user_id, -1, 'idle', us + {DAY} FROM (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY rn) AS next FROM e) WHERE next IS NULL OR next >= us + {DAY}""",
)
def heartbeats(t: Tables) -> DataFrame:
    """A stream of heartbeats a job, written at most once an hour; jobs silent for a day are reported by a timer."""
    rows, delay = late(t, t.events.select("user_id", "event_id", "ts"), "user_id")
    return drained(in_order(rows, "user_id", Heartbeats(HOUR, DAY), f"{delay} microseconds"))


_STEP = "confidence + 1 >= 2 AND NOT pinned AND rung < 5"


@R.add(
    "i8_host_policy",
    f"""WITH RECURSIVE k AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'timeout' WHEN 'signup' THEN ['pin','release','reset'][event_id % 3 + 1] ELSE 'images' END AS kind, event_id % 6 AS pin FROM events),
    e AS (SELECT *, kind IN ('blocked','timeout') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM k),
    t AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0::BIGINT AS rung, 0 AS confidence, false AS pinned, 0::BIGINT AS good, 0::BIGINT AS fails, NULL::VARCHAR AS last FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN kind = 'pin' THEN pin WHEN kind = 'reset' THEN 0 WHEN e.bad AND {_STEP} THEN rung + 1 ELSE rung END,
      CASE WHEN kind IN ('reset', 'images') OR (e.bad AND {_STEP}) THEN 0 WHEN e.bad THEN confidence + 1 ELSE confidence END,
      CASE WHEN kind = 'pin' THEN true WHEN kind IN ('release', 'reset') THEN false ELSE pinned END, good + CAST(kind = 'images' AS BIGINT), fails + CAST(e.bad AS BIGINT), CASE WHEN kind = 'images' OR e.bad THEN kind ELSE last END
      FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
    SELECT user_id, event_id, {list(LADDER)}[rung + 1] AS strategy, confidence, pinned, good, fails AS bad, last AS last_outcome FROM t WHERE rn > 0""",
)
def policy(t: Tables) -> DataFrame:
    """Outcomes of scans and an operator's words are two streams; both late, merged in event-time order."""
    ladder = F.array(*[F.lit(x) for x in LADDER])
    pin = F.element_at(ladder, (c("event_id") % 6 + 1).cast("int"))
    word = F.element_at(F.array(F.lit("pin"), F.lit("release"), F.lit("reset")), (c("event_id") % 3 + 1).cast("int"))
    own, delay = late(t, t.events.filter("event_type <> 'signup'").select("user_id", "event_id", "ts", "event_type"), "user_id")
    said, more = late(t, t.events.filter("event_type = 'signup'").select("user_id", "event_id", "ts"), "user_id")
    outcomes = own.select("user_id", "ts", "event_id", _kinds(error="blocked", view="timeout", click="images", purchase="images"), F.lit(None).cast("string").alias("strategy"))
    words = said.select("user_id", "ts", "event_id", word.alias("kind"), pin.alias("strategy"))
    return drained(in_order([outcomes, words], "user_id", HostPolicy(), f"{max(delay, more)} microseconds"))


_TTL = [x * SCALE * 1_000_000 for x in CACHE_SECONDS]
_HITS = [f"l{i} >= 0 AND e.us - l{i} < {x}" for i, x in enumerate(_TTL)]


@R.add(
    "i15_caches",
    f"""WITH RECURSIVE {_E}, t AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, (-1)::BIGINT AS l0, (-1)::BIGINT AS l1, (-1)::BIGINT AS l2, '' AS hits FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, {", ".join(f"CASE WHEN event_type = 'error' THEN -1 WHEN {h} THEN l{i} ELSE e.us END" for i, h in enumerate(_HITS))},
      CASE WHEN event_type = 'error' THEN '' ELSE {" || ".join(f"CASE WHEN {h} THEN 'h' ELSE 'm' END" for h in _HITS)} END FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
    SELECT user_id, event_id, hits FROM t WHERE hits <> ''""",
)
def caches(t: Tables) -> DataFrame:
    """Hit (h) or miss (m) of each look-up in caches of three times to live; errors empty them; timers drop what is too old."""
    rows, delay = late(t, t.events.select("user_id", "event_id", "ts", "event_type"), "user_id")
    got = drained(in_order(rows.select("user_id", "ts", "event_id", _kinds(error="invalidate")), "user_id", Cache(tuple(x * SCALE for x in CACHE_SECONDS)), f"{delay} microseconds"))
    return got.select("user_id", "event_id", F.array_join(F.transform("hits", lambda h: F.when(h, "h").otherwise("m")), "").alias("hits"))


@R.add(
    "i5_buffers",
    f"""WITH RECURSIVE {_E}, t AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS held, 0 AS flush, false AS emit, '' AS event_type, 0::BIGINT AS us FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.event_type = 'error' OR held + 1 >= {BUFFERED_IMAGES} THEN 0 ELSE held + 1 END,
      CASE WHEN t.emit AND t.rn > 0 THEN flush + 1 ELSE flush END, CASE WHEN e.event_type = 'error' THEN held > 0 ELSE held + 1 >= {BUFFERED_IMAGES} END, e.event_type, e.us FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
    SELECT user_id, event_id, flush + 1 AS flush, f.us AS flushed_at FROM t JOIN (SELECT user_id, flush, us FROM t WHERE emit) f USING (user_id, flush) WHERE event_type <> 'error' AND t.rn > 0""",
)
def buffers(t: Tables) -> DataFrame:
    """Rows of a page are written 25 at a time, and when the page ends (errors stand for that)."""
    rows, delay = late(t, t.events.select("user_id", "event_id", "ts", "event_type"), "user_id")
    return drained(in_order(rows.select("user_id", "ts", "event_id", _kinds(error="close")), "user_id", Buffer(BUFFERED_IMAGES), f"{delay} microseconds"))


@R.add(
    "i14_claims",
    """WITH s AS (SELECT user_id, event_id, event_type, ts, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, turn ORDER BY ts, event_id) = 1 AS won FROM s WHERE event_type <> 'error'""",
)
def claims(t: Tables) -> DataFrame:
    """Of the workers that claim a job, the first wins until the job is given back (errors stand for that)."""
    rows, delay = late(t, t.events.select("user_id", "event_id", "ts", "event_type"), "user_id")
    return drained(in_order(rows.select("user_id", "ts", "event_id", _kinds(error="release")), "user_id", Claim(), f"{delay} microseconds"))


_WAIT = int(GRACE_READS * GRACE_SECONDS * 1_000_000)


@R.add(
    "i13_grace",
    f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (event_id * 7919) % 13000 - 3000 END AS lag FROM events WHERE event_type <> 'error')
    SELECT event_id, CASE WHEN lag * 1000 <= {_WAIT} THEN greatest(0, CAST(ceil(lag / {GRACE_SECONDS * 1000}) AS INTEGER)) END AS attempt, CASE WHEN lag * 1000 <= {_WAIT} THEN 'dispatched' ELSE 'failed' END AS outcome FROM x""",
)
def grace(t: Tables) -> DataFrame:
    """A claimed job's payload may land up to five re-reads of 1.5 s after the claim; a stream-stream join waits for it and gives up when the watermark has passed the last one."""
    claim = t.events.filter("event_type <> 'error'").select("event_id", "ts")
    landed = F.timestamp_micros(micros() + ((c("event_id") * 7919) % 13000 - 3000) * 1000)
    payload = t.events.filter("event_id % 9 <> 0").select("event_id", landed.alias("ts"))
    (a, x), (b, y) = late(t, claim, "event_id"), late(t, payload, "event_id")
    a = a.select("event_id", c("ts").cast("timestamp").alias("claimed")).withWatermark("claimed", f"{x} microseconds")
    b = b.select(c("event_id").alias("payload"), c("ts").alias("landed")).withWatermark("landed", f"{y} microseconds")
    near = F.expr(f"payload = event_id AND landed >= claimed - INTERVAL 15 MINUTES AND landed <= claimed + INTERVAL '{_WAIT / 1e6}' SECOND")  # rows pending for 15 minutes have failed before
    j = drained(a.join(b, near, "leftOuter").select("event_id", "claimed", "landed")).filter("event_id >= 0")
    waited = (micros("landed") - micros("claimed")) / (GRACE_SECONDS * 1_000_000)
    attempt = F.greatest(F.lit(0), F.ceil(waited).cast("int"))
    return j.select("event_id", F.when(c("landed").isNotNull(), attempt).alias("attempt"), F.when(c("landed").isNotNull(), "dispatched").otherwise("failed").alias("outcome"))


@R.add(
    "a22_stream_sink",
    """WITH k AS (SELECT match_id, price, count(*) AS n FROM matches GROUP BY ALL),
    m AS (SELECT md5(concat_ws(':', match_id, price)) AS id, match_id, price, any_value(status) AS status, max(CASE WHEN s.s_suppkey IS NOT NULL THEN m.distributor_id END) AS distributor_id FROM matches m LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = m.distributor_id GROUP BY 1, 2, 3)
    SELECT m.id, match_id, coalesce(distributor_id, -1) AS distributor_id, status = 'violation' AS alerted, CASE WHEN status = 'violation' THEN 'compliance_violation' ELSE '' END AS alert FROM m""",
)
def stream_sink(t: Tables) -> DataFrame:
    """Matches come as a stream and are written batch by batch, dangling dealers as null, each with a generated id that its alert carries; a ledger makes a replayed batch change nothing."""
    rows = t.matches.select("match_id", "price", "distributor_id", "status", "created_at")
    at, _ = arriving(rows, micros("created_at"), 3)
    stream = read_arriving(t.spark, at, rows.schema, 1000)
    dealers = t.supplier.filter("s_acctbal > 0").select(c("s_suppkey").alias("distributor_id"))
    sink = LedgerSink(t.spark, matches_with_alerts(["match_id", "price"], dealers))
    sink.run(stream)
    m, a = sink.table("matches"), sink.table("alerts")
    j = m.join(a.select(c("match_ref").alias("id"), "alert"), "id", "left")
    return j.select("id", "match_id", F.coalesce("distributor_id", F.lit(-1)).alias("distributor_id"), c("alert").isNotNull().alias("alerted"), F.coalesce("alert", F.lit("")).alias("alert"))
