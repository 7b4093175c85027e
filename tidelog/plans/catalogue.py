"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import codec
from ..operators import commit, integrity, metrics, model, placement, reads, retention, scan, writes
from ..streaming import batches
from . import control, extensions, views
from .views import sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def registered(oracle: str | None):
    def keep(f: Query) -> Query:
        REGISTERED[f.__name__] = f, oracle
        return f

    return keep


@registered(sql("SELECT timeline_id, off, payload, ts_ms FROM log WHERE timeline_id = 1 AND off >= 1", "log"))
def fetch_earliest(spark, d):
    return reads.fetch(views.log(spark, d), timelines=[1]).select("timeline_id", "off", "payload", "ts_ms").orderBy("off")


@registered(sql("SELECT timeline_id, off, payload FROM log WHERE timeline_id = 3 AND off >= 5 AND off < 25", "log"))
def fetch_range(spark, d):
    return reads.range_read(views.log(spark, d), 3, 5, 25).select("timeline_id", "off", "payload").orderBy("off")


@registered(sql("SELECT l.timeline_id, off, payload FROM log l JOIN (SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1) w USING (timeline_id) WHERE off > lra", "log", "replicas"))
def fetch_latest(spark, d):
    wm = commit.commit_watermark(views.replicas(spark, d)).withColumnRenamed("watermark", "lra")
    return reads.fetch_latest(views.log(spark, d), wm).select("timeline_id", "off", "payload")


@registered(sql("SELECT timeline_id, off, payload FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY off) AS n FROM log WHERE off >= 7) WHERE n <= 5", "log"))
def fetch_limit(spark, d):
    return reads.fetch(views.log(spark, d), start=7, limit=5).select("timeline_id", "off", "payload")


@registered(sql("SELECT timeline_id, off, payload FROM log JOIN (SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1) USING (timeline_id) WHERE off >= 3 AND off <= lra", "log", "replicas"))
def fetch_committed(spark, d):
    wm = commit.commit_watermark(views.replicas(spark, d)).withColumnRenamed("watermark", "lra")
    return reads.fetch(views.log(spark, d), start=3, committed=wm).select("timeline_id", "off", "payload")


@registered(sql("SELECT l.timeline_id, off, k FROM log l JOIN (SELECT timeline_id, min(off) AS f FROM log WHERE k = 'purchase' GROUP BY 1) x USING (timeline_id) WHERE off >= f", "log"))
def fetch_by_index(spark, d):
    own = views.log(spark, d)
    return reads.fetch_by_index(own, retention.secondary_index(own), "purchase").select("timeline_id", "off", "k")


@registered(
    sql(
        """SELECT timeline_id, chunk, first_off, last_off, n_events, CASE WHEN m = 0 THEN 'FULL' WHEN chunk = 0 THEN 'FIRST' WHEN chunk = m THEN 'LAST' ELSE 'MIDDLE' END AS chunk_type,
        last_off + 1 AS advanced_off FROM (SELECT *, max(chunk) OVER (PARTITION BY timeline_id) AS m FROM (
        SELECT timeline_id, (n - 1) // 16 AS chunk, min(off) AS first_off, max(off) AS last_off, count(*) AS n_events
        FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY off) AS n FROM log) GROUP BY 1, 2))""",
        "log",
    )
)
def fetch_chunks(spark, d):
    return reads.chunks(views.log(spark, d), 16)


ROUTED = "SELECT l.timeline_id, off, start_offset, ensemble FROM log l LEFT JOIN (SELECT *, coalesce(lead(start_offset) OVER (PARTITION BY timeline_id ORDER BY start_offset), 9223372036854775807) AS e FROM segs) s ON l.timeline_id = s.timeline_id AND off >= start_offset AND off < e"


@registered(sql(ROUTED, "log", "segs"))
def segment_route(spark, d):
    return reads.route(views.log(spark, d).select("timeline_id", "off"), views.segs(spark, d)).drop("end_offset")


@registered(sql("SELECT timeline_id, max(start_offset) AS start_offset, arg_max(ensemble, start_offset) AS ensemble FROM segs GROUP BY 1", "segs"))
def last_segment(spark, d):
    return reads.last_segment(views.segs(spark, d))


@registered("SELECT event_id, user_id, event_type, value, props FROM events")
def dataset_read_all(spark, d):
    return scan.scan(views.table(spark, d, "events"), scan.ScanRequest("events", ("event_id", "user_id", "event_type", "value", "props")))


@registered("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 5000 AND value > 10 AND value <= 90 AND event_type = 'click' AND user_id <> 4 ORDER BY event_id LIMIT 50")
def dataset_scan(spark, d):
    filters = [("event_id", "gt_eq", b"100"), ("event_id", "lt", b"5000"), ("value", "gt", b"10"), ("value", "lt_eq", b"90"), ("event_type", "eq", b"click"), ("user_id", "not_eq", b"4")]
    request = scan.ScanRequest("events", ("event_id", "value"), tuple(scan.ScanFilter(*f) for f in filters), 50, order=("event_id",))
    return scan.scan(views.table(spark, d, "events"), request)


@registered(sql("SELECT timeline_id, max(off) + 1 AS next_off FROM log GROUP BY 1", "log"))
def dataset_next_offset(spark, d):
    return writes.next_offset(views.log(spark, d))


@registered(sql("SELECT pos, address, zone FROM units WHERE status = 'WRITABLE'", "units"))
def writable_units(spark, d):
    return placement.writable(views.units(spark, d)).select("pos", "address", "zone")


@registered("SELECT e.user_id AS timeline_id, e.event_id, coalesce(b.lra, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS off FROM events e LEFT JOIN (SELECT c_custkey AS user_id, c_custkey * 10 AS lra FROM customer WHERE c_custkey % 2 = 0) b USING (user_id)")
def assign_offsets(spark, d):
    arrivals = views.table(spark, d, "events").select(F.col("user_id").alias("timeline_id"), "event_id")
    bases = views.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("timeline_id"), (F.col("c_custkey") * 10).alias("lra"))
    return writes.assign_offsets(arrivals, bases, "event_id").withColumn("off", F.col("off").cast("bigint"))


@registered(sql("SELECT timeline_id, off, payload FROM log WHERE NOT (timeline_id % 3 = 0 AND off >= 40) UNION ALL SELECT timeline_id, off, concat('new-', payload) FROM log WHERE timeline_id % 3 = 0 AND off BETWEEN 40 AND 45", "log"))
def apply_truncate(spark, d):
    own = views.log(spark, d).select("timeline_id", "off", "payload")
    new = own.where("timeline_id % 3 = 0 AND off BETWEEN 40 AND 45").withColumn("payload", F.concat(F.lit("new-"), "payload"))
    return writes.truncate_and_append(own, new)


@registered(sql("SELECT timeline_id, off, payload, copy FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, off ORDER BY off % 2 + copy DESC, read_seq DESC) AS n FROM reads) WHERE n = 1", "reads"))
def upsert_offsets(spark, d):
    attempts = views.reads(spark, d).withColumn("term", F.col("off") % 2 + F.col("copy"))
    return writes.upsert(attempts, "read_seq").select("timeline_id", "off", "payload", "copy")


@registered(sql("SELECT timeline_id, min(lra) AS watermark FROM replicas GROUP BY 1", "replicas"))
def commit_watermark(spark, d):
    return commit.commit_watermark(views.replicas(spark, d))


@registered(sql("SELECT * FROM (SELECT timeline_id, (off - 1) // 8 AS batch, max(off) AS max_off, count(*) AS n FROM log GROUP BY 1, 2) JOIN (SELECT timeline_id, min(lra) AS watermark FROM replicas GROUP BY 1) USING (timeline_id) WHERE max_off <= watermark", "log", "replicas"))
def ack_batches(spark, d):
    return commit.acknowledged(views.log(spark, d), views.replicas(spark, d), 8)


@registered(sql("SELECT timeline_id, min(lra) AS lra, max(lra) AS max_lra, min(lra) <> max(lra) AS truncates FROM replicas GROUP BY 1", "replicas"))
def recovery_lra(spark, d):
    return commit.recovery(views.replicas(spark, d))


@registered(
    sql(
        """SELECT timeline_id, CAST(coalesce(max(CASE WHEN off = rn THEN off END), 0) AS BIGINT) AS lra FROM (
        SELECT *, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY timeline_id, n >= 2 ORDER BY off) END AS rn FROM (
        SELECT timeline_id, off, count(DISTINCT u) AS n FROM held GROUP BY 1, 2)) GROUP BY 1""",
        "log",
        held="SELECT timeline_id, off, u FROM log CROSS JOIN (SELECT unnest([1, 2, 3]) AS u) WHERE (off + u) % 23 > 1",
    )
)
def contiguous_ack(spark, d):
    held = views.log(spark, d).select("timeline_id", "off").withColumn("u", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("(off + u) % 23 > 1")
    return commit.contiguous_ack(held, 2)


@registered(sql("SELECT timeline_id, timeline_id % 4 AS new_term, CASE WHEN timeline_id % 4 < 2 THEN 'FENCED' ELSE 'OK' END AS code, CAST(CASE WHEN timeline_id % 4 < 2 THEN -1 ELSE lra END AS BIGINT) AS lra, greatest(timeline_id % 4, 2) AS current_term FROM (SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1)", "replicas"))
def fence_decide(spark, d):
    states = commit.commit_watermark(views.replicas(spark, d)).select("timeline_id", F.lit(2).cast("bigint").alias("term"), F.col("watermark").alias("lra"))
    return writes.fence_decision(states.select("timeline_id", (F.col("timeline_id") % 4).alias("new_term")), states)


@registered(sql("SELECT zone, count(*) AS n FROM units GROUP BY 1", "units"))
def zone_counts(spark, d):
    return placement.zone_counts(views.units(spark, d))


@registered(
    sql(
        """, kept AS (SELECT *, row_number() OVER (ORDER BY rank) AS o FROM c JOIN inc USING (pos)),
        rest AS (SELECT c.*, row_number() OVER (PARTITION BY c.zone ORDER BY pressure, pos) AS rn, coalesce(u.n, 0) AS used FROM c LEFT JOIN (SELECT zone, count(*) AS n FROM kept GROUP BY 1) u ON c.zone = u.zone WHERE pos NOT IN (SELECT pos FROM inc)),
        every AS (SELECT address, zone, o FROM kept UNION ALL SELECT address, zone, 1000 + row_number() OVER (ORDER BY rn, used, zone) FROM rest)
        SELECT address, zone, CAST(p AS BIGINT) AS place FROM (SELECT *, row_number() OVER (ORDER BY o) AS p FROM every) WHERE p <= 5""",
        "units",
        inc="SELECT * FROM (VALUES (5, 1), (4, 2), (3, 3)) x(pos, rank)",
        c="SELECT pos, address, zone, cpu * 0.4 + mem * 0.4 + disk * 0.2 AS pressure FROM units WHERE status = 'WRITABLE' AND pos <> 2",
    ).replace(") , kept", "), kept")
)
def select_ensemble(spark, d):
    own = views.units(spark, d)
    rank = F.when(F.col("pos") == 5, 1).when(F.col("pos") == 4, 2).when(F.col("pos") == 3, 3)
    include = own.where("pos IN (3, 4, 5)").select("address", rank.alias("rank"))
    return placement.select_ensemble(own, include, own.where("pos = 2").select("address"), 5)


ORDER = "SELECT timeline_id, off, read_seq, p AS previous_off FROM (SELECT *, lag(off, 1, 0) OVER (PARTITION BY timeline_id ORDER BY read_seq) AS p FROM reads) WHERE off <= p"
DUPLICATE = "SELECT timeline_id, off, read_seq, n FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, off ORDER BY read_seq) AS n FROM reads) WHERE n > 1"
GAP = "SELECT timeline_id, unnest(range(off + 1, nx)) AS off FROM (SELECT timeline_id, off, lead(off) OVER (PARTITION BY timeline_id ORDER BY off) AS nx FROM acked) WHERE nx > off + 1"
DURABILITY = "SELECT timeline_id, off FROM acked a ANTI JOIN reads r USING (timeline_id, off)"
PHANTOM = "SELECT timeline_id, off, read_seq FROM reads r ANTI JOIN acked a USING (timeline_id, off)"
MISMATCH = "SELECT timeline_id, off, read_seq, CAST(strlen(a.payload) AS BIGINT) AS first_difference FROM reads r JOIN acked a USING (timeline_id, off) WHERE r.payload <> a.payload"


@registered(sql(ORDER, "reads"))
def verify_order(spark, d):
    return integrity.order(views.reads(spark, d))


@registered(sql(DUPLICATE, "reads"))
def verify_duplicate(spark, d):
    return integrity.duplicate(views.reads(spark, d))


@registered(sql(GAP, "acked"))
def verify_gap(spark, d):
    return integrity.gap(views.acked(spark, d))


@registered(sql(DURABILITY, "acked", "reads"))
def verify_durability(spark, d):
    return integrity.durability(views.acked(spark, d), views.reads(spark, d))


@registered(sql(PHANTOM, "acked", "reads"))
def verify_phantom(spark, d):
    return integrity.phantom(views.acked(spark, d), views.reads(spark, d))


@registered(sql(MISMATCH, "acked", "reads"))
def verify_payload(spark, d):
    return integrity.payload_mismatch(views.acked(spark, d), views.reads(spark, d))


@registered(sql("SELECT timeline_id, off, CASE WHEN off % 19 = 0 THEN 'SHORT' WHEN off % 17 = 0 THEN 'SIZE' WHEN off % 13 = 0 THEN 'FILL' ELSE 'NUMBER' END AS what FROM log WHERE off % 19 = 0 OR off % 17 = 0 OR off % 13 = 0 OR off % 11 = 0", "log"))
def verify_corruption(spark, d):
    whole = fn.soak_payload(F.col("off"))
    damaged = (
        F.when(F.col("off") % 19 == 0, F.substring(whole, 1, 5)).when(F.col("off") % 17 == 0, F.substring(whole, 1, 200))
        .when(F.col("off") % 13 == 0, F.concat(F.substring(whole, 1, 255), F.unhex(F.lpad(F.hex((F.col("off") + 1) % 256), 2, "0"))))
        .when(F.col("off") % 11 == 0, fn.soak_payload(F.col("off") + 256)).otherwise(whole)
    )
    return integrity.corruption(views.log(spark, d).select("timeline_id", "off", damaged.alias("payload")))


CLASSES = {"order": ORDER, "duplicate": DUPLICATE, "gap": GAP, "durability": DURABILITY, "phantom": PHANTOM, "payload_mismatch": MISMATCH}


@registered(
    sql(
        "SELECT t.timeline_id, "
        + ", ".join(f'coalesce(v{i}.n, 0) AS "{c}"' for i, c in enumerate(CLASSES))
        + ", CASE WHEN " + " + ".join(f"coalesce(v{i}.n, 0)" for i in range(len(CLASSES))) + " = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT DISTINCT timeline_id FROM log) t "
        + " ".join(f"LEFT JOIN (SELECT timeline_id, count(*) AS n FROM ({q}) GROUP BY 1) v{i} ON t.timeline_id = v{i}.timeline_id" for i, q in enumerate(CLASSES.values())),
        "log", "acked", "reads",
    )
)
def verify_summary(spark, d):
    return integrity.summary(views.acked(spark, d), views.reads(spark, d))


@registered(sql("SELECT timeline_id, off, count(DISTINCT CASE WHEN (off + u) % 20 = 0 THEN concat(payload, u) ELSE payload END) AS n_payloads FROM log CROSS JOIN (SELECT unnest([1, 2, 3]) AS u) GROUP BY 1, 2 HAVING n_payloads > 1", "log"))
def replica_divergence(spark, d):
    copies = views.log(spark, d).withColumn("u", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return integrity.divergence(copies.withColumn("payload", F.when((F.col("off") + F.col("u")) % 20 == 0, F.concat("payload", F.col("u").cast("string"))).otherwise(F.col("payload"))))


@registered(sql("SELECT timeline_id, off FROM acked WHERE off % 53 = 0", "acked"))
def acked_subset_sent(spark, d):
    return integrity.not_sent(views.acked(spark, d), views.log(spark, d).where("off % 53 <> 0"))


COPIES = "SELECT timeline_id, off, u, payload FROM log CROSS JOIN (SELECT unnest([1::BIGINT, 2, 3]) AS u) WHERE (off + u) % 23 <> 0"
MARKS = "SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1"


def copies(spark, d):
    """What three units hold of the log: each lacks some offsets."""
    units = F.explode(F.array(*[F.lit(u).cast("bigint") for u in (1, 2, 3)]))
    return views.log(spark, d).select("timeline_id", "off", units.alias("u"), "payload").where("(off + u) % 23 <> 0")


def marks(spark, d):
    return commit.commit_watermark(views.replicas(spark, d)).withColumnRenamed("watermark", "lra")


def ensembles(spark, d):
    two = F.array(F.lit(1), (F.col("start_offset") % 2 + 2)).cast("array<bigint>")
    return views.segs(spark, d).withColumn("ensemble", two)


@registered(sql("SELECT l.timeline_id, l.off, count(DISTINCT c.u) AS n_units FROM log l JOIN marks m ON l.timeline_id = m.timeline_id LEFT JOIN (SELECT * FROM copies WHERE off % 29 <> 0) c ON l.timeline_id = c.timeline_id AND l.off = c.off WHERE l.off <= lra GROUP BY 1, 2 HAVING n_units < 3", "log", "replicas", copies=COPIES, marks=MARKS))
def model_under_replicated(spark, d):
    """Offsets that one of three units lacks, and some that none has."""
    return model.under_replicated(copies(spark, d).where("off % 29 <> 0"), views.log(spark, d), marks(spark, d), 3)


@registered(
    sql(
        "SELECT timeline_id, off, u FROM (SELECT l.timeline_id, off, unnest([1, start_offset % 2 + 2]) AS u FROM (" + ROUTED + ") l JOIN marks m ON l.timeline_id = m.timeline_id WHERE off <= lra) x ANTI JOIN copies c USING (timeline_id, off, u)",
        "log", "segs", "replicas", copies=COPIES, marks=MARKS,
    )
)
def model_lost(spark, d):
    return model.lost(copies(spark, d), views.log(spark, d), ensembles(spark, d), marks(spark, d))


@registered(sql("SELECT c.timeline_id, off, count(DISTINCT CASE WHEN (off + u) % 20 = 0 THEN concat(payload, u) ELSE payload END) AS n_payloads FROM copies c JOIN marks m ON c.timeline_id = m.timeline_id WHERE off <= lra AND u IN (1, 3) GROUP BY 1, 2 HAVING n_payloads > 1", "log", "replicas", copies=COPIES, marks=MARKS))
def model_divergence(spark, d):
    altered = F.when((F.col("off") + F.col("u")) % 20 == 0, F.concat("payload", F.col("u").cast("string"))).otherwise(F.col("payload"))
    return model.diverging(copies(spark, d).withColumn("payload", altered), ensembles(spark, d), marks(spark, d))


@registered(sql("SELECT DISTINCT c.timeline_id, u FROM copies c JOIN marks m ON c.timeline_id = m.timeline_id JOIN (SELECT timeline_id, max(start_offset) AS s FROM segs GROUP BY 1) g ON c.timeline_id = g.timeline_id WHERE off <= lra AND off >= s AND (timeline_id + u) % 3 <> 0".replace("(timeline_id + u)", "(c.timeline_id + u)"), "log", "segs", "replicas", copies=COPIES, marks=MARKS))
def model_pinned(spark, d):
    return model.pinned(copies(spark, d).where("(timeline_id + u) % 3 <> 0"), reads.last_segment(views.segs(spark, d)), marks(spark, d))


@registered(sql("SELECT timeline_id, off, lra FROM log JOIN marks USING (timeline_id) WHERE off > lra + 1", "log", "replicas", marks=MARKS))
def model_flow(spark, d):
    return model.beyond_window(views.log(spark, d), marks(spark, d))


@registered(sql("SELECT timeline_id, off, u FROM copies JOIN marks USING (timeline_id) WHERE off > lra", "log", "replicas", copies=COPIES, marks=MARKS))
def reconcile_dirty_tail(spark, d):
    return model.dirty_tail(copies(spark, d), views.replicas(spark, d))


@registered(sql("SELECT DISTINCT timeline_id, off, payload FROM copies JOIN marks USING (timeline_id) WHERE off <= lra", "log", "replicas", copies=COPIES, marks=MARKS))
def reconcile_aligned(spark, d):
    return model.aligned(copies(spark, d), views.replicas(spark, d))


@registered(sql("SELECT timeline_id, k, max(off) AS off, arg_max(payload, off) AS payload FROM log GROUP BY 1, 2", "log"))
def latest_per_key(spark, d):
    return retention.latest_per_key(views.log(spark, d))


@registered(sql("SELECT timeline_id, off, t AS txn_id FROM (SELECT *, CASE WHEN off % 3 = 0 THEN event_id // 10 END AS t FROM log) WHERE t IS NULL OR t % 4 <> 1", "log"))
def txn_committed(spark, d):
    own = views.log(spark, d).select("timeline_id", "off", F.when(F.col("off") % 3 == 0, F.floor(F.col("event_id") / 10)).alias("txn_id"))
    return retention.committed(own, own.select("txn_id").where("txn_id % 4 <> 1").distinct()).select("timeline_id", "off", "txn_id")


@registered(sql("SELECT timeline_id, off, ts_ms FROM (SELECT *, max(ts_ms) OVER (PARTITION BY timeline_id) AS m FROM log) WHERE ts_ms >= m - 86400000", "log"))
def retain_age(spark, d):
    return retention.by_age(views.log(spark, d), 86_400_000).select("timeline_id", "off", "ts_ms")


@registered(sql("SELECT timeline_id, off FROM (SELECT *, sum(strlen(payload)) OVER (PARTITION BY timeline_id ORDER BY off DESC ROWS UNBOUNDED PRECEDING) AS s FROM log) WHERE s <= 200", "log"))
def retain_bytes(spark, d):
    return retention.by_bytes(views.log(spark, d), 200).select("timeline_id", "off")


@registered(sql("SELECT timeline_id, k, off FROM log", "log"))
def secondary_index(spark, d):
    return retention.secondary_index(views.log(spark, d))


@registered(sql("SELECT k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM log GROUP BY 1", "log"))
def materialize_incremental(spark, d):
    own = views.log(spark, d)
    empty = own.limit(0).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("decimal(28,6)").alias("total"))
    first = retention.refreshed(empty, own.where("off <= 30"))
    return retention.refreshed(first, own.where("off > 30")).withColumn("total", F.col("total").cast("double"))


@registered(sql("SELECT timeline_id, off, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k_value FROM log", "log"))
def typed_view(spark, d):
    parsed = F.from_json("payload", "k bigint")
    return views.log(spark, d).select("timeline_id", "off", parsed["k"].alias("k_value"))


@registered(sql("SELECT timeline_id, start_offset, concat('timelines/', timeline_id, '/seg-', lpad(CAST(start_offset AS VARCHAR), 19, '0')) AS key FROM segs", "segs"))
def key_format(spark, d):
    name = F.concat(F.lit("timelines/"), F.col("timeline_id").cast("string"))
    return views.segs(spark, d).select("timeline_id", "start_offset", fn.segment_key(name, F.col("start_offset")).alias("key"))


@registered("SELECT page_id, replace(replace(replace(url, '://', '_'), '/', '_'), ':', '_') AS address FROM pages")
def sanitize(spark, d):
    return views.table(spark, d, "pages").select("page_id", fn.sanitized(F.col("url")).alias("address"))


@registered("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'default' ELSE concat('z', s_nationkey) END AS zone FROM supplier")
def default_zone(spark, d):
    raw = F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("z"), F.col("s_nationkey").cast("string")))
    return views.table(spark, d, "supplier").select("s_suppkey", fn.zone_or_default(raw).alias("zone"))


@registered(
    sql(
        """SELECT timeline_id, CAST(ts_ms // 3600000 * 3600000 AS BIGINT) AS window_ms, round(sum(step) / 3600e0, 9) AS rate FROM (
        SELECT *, CASE WHEN lag(c) OVER w IS NULL THEN 0 WHEN c < lag(c) OVER w THEN c ELSE c - lag(c) OVER w END AS step
        FROM (SELECT *, off % 25 AS c FROM log) WINDOW w AS (PARTITION BY timeline_id ORDER BY ts_ms)) GROUP BY 1, 2""",
        "log",
    )
)
def rate_per_window(spark, d):
    own = views.log(spark, d).select("timeline_id", "ts_ms", (F.col("off") % 25).alias("value"))
    return metrics.rate(own, ["timeline_id"], 3600).withColumn("rate", F.round("rate", 9))


@registered("SELECT user_id, count(*) FILTER (event_type <> 'error') AS good, count(*) AS n, round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS ratio FROM events GROUP BY 1")
def success_ratio(spark, d):
    return metrics.ratio(views.table(spark, d, "events"), ["user_id"], F.col("event_type") != "error").withColumn("ratio", F.round("ratio", 9))


@registered(
    sql(
        """SELECT event_type, round(CASE WHEN cum = below THEN low ELSE low + (le - low) * (r - below) / (cum - below) END, 6) AS quantile FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS n FROM (SELECT *, coalesce(lag(cum) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low,
        max(cum) OVER (PARTITION BY event_type) * 0.95e0 AS r FROM buckets WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE cum >= r) WHERE n = 1""",
        "buckets",
    )
)
def hist_quantile(spark, d):
    return metrics.histogram_quantile(views.buckets(spark, d), ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@registered("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def value_quantiles(spark, d):
    found = metrics.quantiles(views.table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@registered(sql("SELECT timeline_id, off, concat_ws(chr(9), timeline_id, off, coalesce(CASE WHEN off % 5 = 0 THEN NULL ELSE payload END, 'NULL')) AS line FROM log", "log"))
def tsv_render(spark, d):
    own = views.log(spark, d).select("timeline_id", "off", F.when(F.col("off") % 5 != 0, F.col("payload")).alias("payload"))
    return own.select("timeline_id", "off", F.concat_ws("\t", *[fn.rendered(F.col(c), t) for c, t in own.dtypes]).alias("line"))


@registered(
    sql(
        """SELECT timeline_id, off, 11 + strlen(payload) AS n_bytes, CASE WHEN off % 9 = 0 THEN 'checksum' WHEN off % 10 = 0 THEN 'header' END AS damage,
        CASE WHEN off % 9 <> 0 AND off % 10 <> 0 THEN CASE off % 4 WHEN 0 THEN 'FULL' WHEN 1 THEN 'FIRST' WHEN 2 THEN 'MIDDLE' ELSE 'LAST' END END AS record_type,
        CASE WHEN off % 9 <> 0 AND off % 10 <> 0 THEN timeline_id * 1000 + off END AS log_number, CASE WHEN off % 9 <> 0 AND off % 10 <> 0 THEN md5(payload) END AS digest FROM log""",
        "log",
    )
)
def codec_roundtrip(spark, d):
    """Records of all types; of some a byte of the data is changed, some are cut within the header."""
    kind = F.element_at(F.array(*map(F.lit, ("FULL", "FIRST", "MIDDLE", "LAST"))), (F.col("off") % 4 + 1).cast("int"))
    own = views.log(spark, d).select("timeline_id", "off", kind.alias("record_type"), (F.col("timeline_id") * 1000 + F.col("off")).alias("log_number"), F.col("payload").cast("binary").alias("data"))
    made = codec.encoded(own).withColumn("n_bytes", F.octet_length("record").cast("bigint"))
    changed = F.concat(F.expr("substring(record, 1, n_bytes - 1)"), F.unhex(F.lit("00")))
    damaged = F.when(F.col("off") % 9 == 0, changed).when(F.col("off") % 10 == 0, F.substring("record", 1, 10)).otherwise(F.col("record"))
    back = codec.decoded(made.withColumn("record", damaged))
    return back.select("timeline_id", "off", "n_bytes", F.regexp_extract("error", "checksum|header", 0).alias("damage"), "record_type", "log_number", F.md5("data").alias("digest"))


def streamed(name: str, oracle: str, build: Callable) -> None:
    REGISTERED[name] = build, oracle


streamed("stream_tail", "SELECT event_id, user_id, event_type FROM events", batches.tail)
streamed("stream_tumbling", "SELECT event_type, epoch_us(ts) // 3600000000 * 3600000 AS window_ms, count(*) AS n FROM events GROUP BY 1, 2", batches.tumbling)
streamed("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events", batches.deduplicated)
streamed("stream_commit_state", "SELECT user_id AS timeline_id, count(*) AS lra FROM events GROUP BY 1", batches.commit_state)
streamed(
    "stream_session",
    """SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s""",
    batches.sessions,
)


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in (REGISTERED | control.REGISTERED | extensions.REGISTERED).items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in (REGISTERED | control.REGISTERED | extensions.REGISTERED).items() if o}
