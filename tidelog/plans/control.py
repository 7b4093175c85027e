"""Registered queries of the control plane and of writers: catalogs, timelines and datasets made in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..catalog import Catalog
from ..dataset import DatasetClient
from ..errors import InvalidTerm, VersionConflict
from ..functions import segment_files, wire
from ..operators import commit, integrity, metrics, model, placement, reads, retention, scan, writes
from ..streaming import batches
from ..timeline import Cursor, Recorder, Timeline
from ..types import Dataset, DatasetSchema, Field, Policies
from . import views
from .views import sql

REGISTERED: dict = {}


def registered(oracle: str | None):
    def keep(f):
        REGISTERED[f.__name__] = f, oracle
        return f

    return keep


def sandbox(spark: SparkSession) -> tuple[Catalog, str]:
    """An empty catalog, and a folder for data."""
    at = batches.folder(spark)
    return Catalog(spark, f"{at}/catalog"), f"{at}/data"


EVENTS = DatasetSchema((Field("event_id", "int64", False), Field("kind", "string"), Field("user_id", "int64")))


def events_of(spark, d, kind: str) -> DataFrame:
    return views.table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", F.col("event_type").alias("kind"), "user_id")


def events_dataset(spark, d, kinds: list[str], policies: Policies = Policies()) -> DatasetClient:
    catalog, root = sandbox(spark)
    catalog.create_dataset(Dataset("events", EVENTS, policies))
    client = DatasetClient(catalog, root, "events")
    for kind in kinds:
        client.write(events_of(spark, d, kind), ["event_id"])
    return client


# Datasets

BY_KIND = "SELECT event_id, event_type AS kind, user_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type = '{}'"
TWO = f"WITH a AS ({BY_KIND.format('click')}), b AS ({BY_KIND.format('purchase')}) "


@registered(TWO + "SELECT event_id, kind, user_id, n AS off FROM a UNION ALL SELECT event_id, kind, user_id, n + (SELECT count(*) FROM a) FROM b")
def dataset_append(spark, d):
    return events_dataset(spark, d, ["click", "purchase"]).rows().select("event_id", "kind", "user_id", F.col("_offset").alias("off"))


@registered(TWO + "SELECT event_id, kind, user_id, n AS off FROM a UNION ALL SELECT event_id, kind, user_id, n + (SELECT count(*) FROM a) FROM b")
def dataset_append_race(spark, d):
    """The writer of purchases has numbered its rows when that of clicks commits."""
    client = events_dataset(spark, d, [])
    other, part = DatasetClient(client.catalog, client.root, "events"), client._part
    first = []

    def between(path):
        if not first:
            first.append(other.write(events_of(spark, d, "click"), ["event_id"]))
        return part(path)

    client._part = between
    client.write(events_of(spark, d, "purchase"), ["event_id"])
    return client.rows().select("event_id", "kind", "user_id", F.col("_offset").alias("off"))


@registered(TWO + "SELECT 1 AS snapshot, count(*) AS n FROM a UNION ALL SELECT 2, (SELECT count(*) FROM a) + count(*) FROM b UNION ALL SELECT 0, 0")
def dataset_snapshots(spark, d):
    client = events_dataset(spark, d, ["click", "purchase"])
    count = lambda k: client.rows(k).agg(F.count("*").alias("n")).select(F.lit(k).alias("snapshot"), "n")
    return count(0).unionByName(count(1)).unionByName(count(2))


@registered("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id < 50")
def dataset_index_scan(spark, d):
    client = events_dataset(spark, d, ["click", "purchase", "view"], Policies(indexes=("kind",)))
    filters = (scan.ScanFilter("kind", "eq", b"purchase"), scan.ScanFilter("user_id", "lt", b"50"))
    return client.scan(scan.ScanRequest("events", ("event_id", "user_id"), filters))


@registered("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def action_compact(spark, d):
    """Of each user the row written last; clicks are written before purchases, so an action on numbers that grow with both."""
    catalog, root = sandbox(spark)
    catalog.create_dataset(Dataset("events", EVENTS))
    client = DatasetClient(catalog, root, "events")
    client.write(events_of(spark, d, "click").unionByName(events_of(spark, d, "purchase")), ["event_id"])
    client.run_action(catalog.submit_action("compact", "events", {"key": "user_id"})["id"])
    return client.rows().select("user_id", "event_id")


@registered("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def action_refresh(spark, d):
    client = events_dataset(spark, d, ["click"])
    run = lambda: client.run_action(client.catalog.submit_action("refresh", "events", {"by": "kind"})["id"])["message"]
    run()
    client.write(events_of(spark, d, "purchase"), ["event_id"])
    return spark.read.parquet(run())


# Catalog


@registered("SELECT n_name AS name, CAST(CASE WHEN n_nationkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS version, row_number() OVER (ORDER BY n_name) AS pos FROM nation WHERE n_nationkey % 5 <> 0")
def catalog_datasets(spark, d):
    """Datasets made, some changed, some deleted, listed by name."""
    catalog, _ = sandbox(spark)
    for r in views.table(spark, d, "nation").orderBy("n_nationkey").collect():  # a catalog's entries, 25 of them
        made = catalog.create_dataset(Dataset(r["n_name"], EVENTS))
        if r["n_nationkey"] % 3 == 1:
            made = catalog.update_dataset(made, made.version)
            try:
                catalog.update_dataset(made, 1)
            except VersionConflict:
                pass
        if r["n_nationkey"] % 5 == 0:
            catalog.delete_dataset(made.name, made.version)
    return spark.createDataFrame([(x.name, x.version, i + 1) for i, x in enumerate(catalog.list_datasets())], "name string, version long, pos long")


@registered("SELECT concat('action-', r_regionkey + 1) AS id, CASE r_regionkey % 2 WHEN 0 THEN 'compact' ELSE 'vacuum' END AS kind, r_name AS dataset, CASE WHEN r_regionkey = 0 THEN 'running' ELSE 'pending' END AS status FROM region")
def catalog_actions(spark, d):
    catalog, _ = sandbox(spark)
    for r in views.table(spark, d, "region").orderBy("r_regionkey").collect():
        catalog.create_dataset(Dataset(r["r_name"], EVENTS))
        catalog.submit_action(("compact", "vacuum")[r["r_regionkey"] % 2], r["r_name"])
    catalog.set_action("action-1", "running")
    return spark.createDataFrame([(a["id"], a["kind"], a["dataset"], a["status"]) for a in catalog.list_actions()], "id string, kind string, dataset string, status string")


@registered("SELECT r_name AS name, r_regionkey + 1 AS timeline_id, CAST(r_regionkey % 3 AS BIGINT) AS term FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 'again', CAST(6 AS BIGINT), CAST(0 AS BIGINT)")
def catalog_timelines(spark, d):
    """Ids count on from those given, also when a timeline goes; each new term is one more; segments are no timelines."""
    catalog, _ = sandbox(spark)
    for r in views.table(spark, d, "region").orderBy("r_regionkey").collect():
        catalog.get_or_create_timeline(r["r_name"])
        for _ in range(r["r_regionkey"] % 3):
            catalog.new_term(r["r_name"])
        catalog.put_segment(r["r_name"], 1, ["u1"])
        if r["r_regionkey"] == 3:
            catalog.delete_timeline(r["r_name"], catalog.get_timeline(r["r_name"]).version)
    catalog.create_timeline("again")
    return spark.createDataFrame([(t["name"], t["timeline_id"], t["term"]) for t in catalog.list_timelines()], "name string, timeline_id long, term long")


@registered("SELECT n_nationkey AS off, CASE WHEN n_nationkey < 1 THEN NULL WHEN n_nationkey < 9 THEN 1 WHEN n_nationkey < 21 THEN 9 ELSE 21 END AS start_offset, CASE WHEN n_nationkey < 1 THEN NULL WHEN n_nationkey < 9 THEN 'a' WHEN n_nationkey < 21 THEN 'c' ELSE 'd' END AS unit FROM nation")
def catalog_segments(spark, d):
    """Segments put, the last one's ensemble changed while it was empty, and the one that each offset belongs to."""
    catalog, _ = sandbox(spark)
    catalog.put_segment("t", 1, ["a"])
    catalog.put_segment("t", 9, ["b"])
    catalog.change_ensemble("t", 8, ["c"])
    catalog.change_ensemble("t", 20, ["d"])
    offsets = [r["n_nationkey"] for r in views.table(spark, d, "nation").select("n_nationkey").collect()]
    found = [(o, catalog.segment_for("t", o)) for o in offsets]
    return spark.createDataFrame([(o, s and s["start_offset"], s and s["ensemble"][0]) for o, s in found], "off long, start_offset int, unit string")


@registered("SELECT n_name AS address, CASE WHEN n_regionkey = 0 THEN 'default' ELSE concat('z', n_regionkey) END AS zone, CASE WHEN n_nationkey % 4 = 0 THEN 'READONLY' ELSE 'WRITABLE' END AS status FROM nation WHERE n_nationkey % 6 <> 0")
def catalog_units(spark, d):
    catalog, _ = sandbox(spark)
    for r in views.table(spark, d, "nation").collect():
        zone = f"z{r['n_regionkey']}" if r["n_regionkey"] else ""
        catalog.register_unit(r["n_name"], zone, "READONLY" if r["n_nationkey"] % 4 == 0 else "WRITABLE")
        if r["n_nationkey"] % 6 == 0:
            catalog.unregister_unit(r["n_name"], zone)
    return catalog.units().select("address", "zone", "status")


@registered("SELECT CAST(x AS BIGINT) AS start_offset FROM (VALUES (1), (21), (41)) t(x)")
def segments_subscribed(spark, d):
    """A timeline's segments as a stream, others' left out."""
    catalog, _ = sandbox(spark)
    for start in (1, 21, 41):
        catalog.put_segment("a", start, ["u1"])
        catalog.put_segment("b", start + 1, ["u1"])
    return batches.drained(catalog.subscribe_segments("a").select("start_offset")).drop("epoch")


@registered("SELECT n_nationkey AS id, concat('datasets/', n_name) AS dataset_key, concat('timelines/', n_name) AS timeline_key, concat('actions/action-', n_nationkey) AS action_key, concat('units/', CASE WHEN n_regionkey = 0 THEN 'default' ELSE concat('z', n_regionkey) END, '/', n_name, '_80') AS unit_key, concat('action-', 1000 + n_nationkey, '-', n_regionkey) AS timed_action FROM nation")
def catalog_keys(spark, d):
    zone = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("z"), F.col("n_regionkey").cast("string")))
    return views.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), fn.catalog_key("datasets", F.col("n_name")).alias("dataset_key"), fn.catalog_key("timelines", F.col("n_name")).alias("timeline_key"),
        fn.catalog_key("actions", fn.action_id(F.col("n_nationkey"))).alias("action_key"), fn.unit_key(zone, F.concat("n_name", F.lit(":80"))).alias("unit_key"),
        fn.action_id(F.col("n_regionkey"), F.col("n_nationkey") + 1000).alias("timed_action"),
    )


@registered("SELECT DISTINCT r_name AS dataset, unnest(list_sort([concat('by_', lower(r_name)), 'a_key', 'z_key'])) AS index_name, r_regionkey AS id FROM region WHERE r_regionkey < 3")
def index_names(spark, d):
    """Datasets joined with the names of their indexes."""
    catalog, root = sandbox(spark)
    rows = views.table(spark, d, "region").where("r_regionkey < 3").select("r_name", "r_regionkey")
    for r in rows.collect():
        catalog.create_dataset(Dataset(r["r_name"], EVENTS, Policies(indexes=("z_key", f"by_{r['r_name'].lower()}", "a_key"))))
    names = [(x.name, n) for x in catalog.datasets_with_index("a_key") for n in DatasetClient(catalog, root, x.name).index_names]
    return spark.createDataFrame(names, "dataset string, index_name string").join(rows, F.col("dataset") == F.col("r_name")).select("dataset", "index_name", F.col("r_regionkey").alias("id"))


@registered("SELECT r_name AS name, CAST(1 AS BIGINT) AS version, 'kind' AS field_name, 'string' AS field_type, r_regionkey * 1000 AS max_age_ms FROM region")
def dataset_json(spark, d):
    """Datasets as JSON, read with a schema."""
    made = [(Dataset(r["r_name"], EVENTS, Policies(max_age_ms=r["r_regionkey"] * 1000)).at(1).to_json(),) for r in views.table(spark, d, "region").collect()]
    whole = F.from_json("json", "name string, version long, policies struct<max_age_ms:long>, schema struct<fields:array<struct<name:string,data_type:string>>>")
    x = spark.createDataFrame(made, "json string").select(whole.alias("x"))
    return x.select("x.name", "x.version", F.col("x.schema.fields")[1]["name"].alias("field_name"), F.col("x.schema.fields")[1]["data_type"].alias("field_type"), F.col("x.policies.max_age_ms").alias("max_age_ms"))


# Timelines

FIRST_USER = "SELECT row_number() OVER (ORDER BY event_id) AS off, props AS payload FROM events WHERE user_id = 1"


def payloads(spark, d) -> DataFrame:
    return views.table(spark, d, "events").where("user_id = 1").select("event_id", F.col("props").alias("payload"))


@registered(FIRST_USER)
def timeline_append(spark, d):
    catalog, root = sandbox(spark)
    t = Timeline(catalog, root, "t")
    t.append(payloads(spark, d), ["event_id"])
    return t.rows().select("off", F.col("payload").cast("string").alias("payload"))


@registered(f"SELECT off, payload, CAST(CASE WHEN off <= 5 THEN 1 ELSE 2 END AS BIGINT) AS term FROM ({FIRST_USER}) WHERE off <= 8")
def takeover(spark, d):
    """A new writer comes when the old one's manifest is written; what the old one then writes is nobody's."""
    catalog, root = sandbox(spark)
    events = [(r["payload"].encode(), None, None) for r in payloads(spark, d).orderBy("event_id").limit(8).collect()]
    old, put, new = Timeline(catalog, root, "t"), catalog.store.put, []
    old.record_batch(events[:5])

    def between(kind, *args):
        done = put(kind, *args)
        if kind == "manifests":
            catalog.store.put = put
            new.append(Timeline(catalog, root, "t"))
        return done

    catalog.store.put = between
    try:
        old.record_batch(events[:3])
    except InvalidTerm:
        pass
    new[0].record_batch(events[5:])
    return new[0].rows().select("off", F.col("payload").cast("string").alias("payload"), "term")


@registered(f"SELECT off, payload FROM ({FIRST_USER}) WHERE off >= 4 AND off < 11")
def cursor_read(spark, d):
    """Seven events from an offset, three at a time; the first read fails."""
    catalog, root = sandbox(spark)
    t = Timeline(catalog, root, "t")
    t.append(payloads(spark, d), ["event_id"])
    read, failures = t.rows, iter([True])
    t.rows = lambda *a: 1 / 0 if next(failures, False) else read(*a)
    found = [(e["off"], bytes(e["payload"]).decode()) for e in Cursor(t, 4, limit=7, piece=3, poll=0.01)]
    return spark.createDataFrame(found, "off long, payload string")


@registered(f"SELECT off, payload FROM ({FIRST_USER}) WHERE off <= 20")
def recorder_batches(spark, d):
    """Single events through a recorder, each with the offset that its future gives."""
    catalog, root = sandbox(spark)
    t = Timeline(catalog, root, "t")
    recorder = Recorder(t, linger=0.2)
    sent = [(r["payload"], recorder.record(r["payload"].encode())) for r in payloads(spark, d).orderBy("event_id").limit(20).collect()]
    told = spark.createDataFrame([(f.result(120), p) for p, f in sent], "off long, told string")
    recorder.close()
    return t.rows().join(told, "off").where(F.col("told") == F.col("payload").cast("string")).select("off", F.col("told").alias("payload"))


@registered(f"SELECT off, payload FROM ({FIRST_USER}) WHERE off <= 4")
def timeline_truncate(spark, d):
    catalog, root = sandbox(spark)
    t = Timeline(catalog, root, "t")
    t.append(payloads(spark, d), ["event_id"])
    t.truncate(4)
    return Timeline(catalog, root, "t", readonly=True).rows().select("off", F.col("payload").cast("string").alias("payload"))


@registered("SELECT 'z' || x AS zone FROM (VALUES (0), (1), (2)) t(x)")
def replacement_search(spark, d):
    """Three units in three zones, one of them kept, one forgiven as there are no others."""
    catalog, root = sandbox(spark)
    for i in range(3):
        catalog.register_unit(f"u{i}", f"z{i}")
    found, _ = placement.find_replacement(catalog.units, ["u0"], ["u1", "u2"], 3, wait=0.0)
    return catalog.units().where(F.col("address").isin(found)).select("zone")


# Reading and writing as plans


@registered(
    sql(
        """, asked AS (SELECT c_custkey AS request_id, c_custkey % 40 AS timeline_id, c_custkey % 50 + 1 AS start, c_custkey % 50 + c_custkey % 24 - 1 AS e FROM customer),
        f AS (SELECT request_id, (n - 1) // 8 AS chunk, min(off) AS first_off, max(off) AS last_off, count(*) AS n_events FROM (
            SELECT request_id, off, row_number() OVER (PARTITION BY request_id ORDER BY off) AS n FROM asked JOIN log USING (timeline_id) WHERE off >= start AND off < e) GROUP BY 1, 2),
        m AS (SELECT *, max(chunk) OVER (PARTITION BY request_id) AS last FROM f)
        SELECT request_id, chunk, first_off, last_off, n_events, CASE WHEN last = 0 THEN 'FULL' WHEN chunk = 0 THEN 'FIRST' WHEN chunk = last THEN 'LAST' ELSE 'MIDDLE' END AS chunk_type, last_off + 1 AS advanced_off FROM m
        UNION ALL SELECT request_id, 0, NULL, NULL, 0, CASE WHEN e < start THEN 'INVALID_ARGUMENT' ELSE 'FULL' END, start FROM asked WHERE request_id NOT IN (SELECT request_id FROM f)""",
        "log",
    ).replace(") , asked", "), asked")
)
def fetch_frames(spark, d):
    asked = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 40).alias("timeline_id"), (F.col("c_custkey") % 50 + 1).alias("start"), (F.col("c_custkey") % 50 + F.col("c_custkey") % 24 - 1).alias("end")
    )
    return reads.frames(views.log(spark, d), asked, 8)


@registered(sql("SELECT timeline_id, ts_ms // 86400000 * 86400000 AS window_ms, (n - 1) // 3 AS flush, count(*) AS n, min(off) AS first_off, max(off) AS last_off FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, ts_ms // 86400000 ORDER BY off) AS n FROM log) GROUP BY 1, 2, 3", "log"))
def micro_batches(spark, d):
    return writes.micro_batches(views.log(spark, d), 3, 86_400_000)


ITEMS = "SELECT o_orderkey AS batch_id, l_linenumber AS i, o_custkey % 7 + CASE WHEN o_orderkey % 11 = 0 AND l_linenumber = 2 THEN 1 ELSE 0 END AS timeline_id, o_custkey % 3 AS term, CASE WHEN o_orderkey % 13 = 0 AND l_linenumber = 3 THEN NULL ELSE 'x' END AS payload FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@registered(
    f"""WITH items AS ({ITEMS}), first AS (SELECT batch_id, arg_min(timeline_id, i) AS t, arg_min(term, i) AS term FROM items GROUP BY 1),
    faults AS (SELECT batch_id, i, CASE WHEN payload IS NULL THEN 'MISSING_EVENT' WHEN timeline_id <> t OR items.term <> first.term THEN 'MIXED_BATCH' WHEN first.term < t % 2 THEN 'INVALID_TERM' END AS f FROM items JOIN first USING (batch_id)),
    codes AS (SELECT batch_id, arg_min(f, i) FILTER (f IS NOT NULL) AS f FROM faults GROUP BY 1)
    SELECT o_orderkey AS batch_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'EMPTY_BATCH' ELSE coalesce(f, 'OK') END AS code, CAST(CASE WHEN f = 'INVALID_TERM' THEN -1 END AS BIGINT) AS commit_off, CAST(CASE WHEN f = 'INVALID_TERM' THEN t % 2 END AS BIGINT) AS current_term
    FROM orders LEFT JOIN (SELECT batch_id, count(*) AS n FROM items GROUP BY 1) c ON o_orderkey = c.batch_id LEFT JOIN codes ON o_orderkey = codes.batch_id LEFT JOIN first ON o_orderkey = first.batch_id"""
)
def record_validate(spark, d):
    o, i = views.table(spark, d, "orders"), views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    joined = o.select("o_orderkey", "o_custkey").join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    line, order = F.col("l_linenumber"), F.col("o_orderkey")
    item = F.struct(
        line.alias("i"), (F.col("o_custkey") % 7 + F.when((order % 11 == 0) & (line == 2), 1).otherwise(0)).alias("timeline_id"),
        (F.col("o_custkey") % 3).alias("term"), F.when(~((order % 13 == 0) & (line == 3)), "x").alias("payload"),
    )
    batches_ = joined.groupBy(order.alias("batch_id")).agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), item))).alias("items"))  # a batch has 256 items at most
    states = spark.range(8).select(F.col("id").alias("timeline_id"), (F.col("id") % 2).alias("term"))
    return writes.validated(batches_, states)


@registered(sql("SELECT off % 3 AS unit, event_id, row_number() OVER (PARTITION BY off % 3 ORDER BY event_id) AS sequence, row_number() OVER (PARTITION BY off % 3 ORDER BY event_id) AS synced FROM log", "log"))
def wal_append(spark, d):
    return writes.wal_append(views.log(spark, d).select((F.col("off") % 3).alias("unit"), "event_id"), "event_id")


@registered(sql("SELECT DISTINCT user_id AS timeline_id, CASE WHEN user_id % 4 = 0 THEN -1 ELSE w.lra END AS watermark FROM events JOIN (SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1) w ON user_id = w.timeline_id", "replicas"))
def commit_watermark_default(spark, d):
    every = views.table(spark, d, "events").select(F.col("user_id").alias("timeline_id")).distinct()
    return commit.commit_watermark(views.replicas(spark, d).where("timeline_id % 4 <> 0"), every)


@registered(sql("SELECT timeline_id, read_seq, off, max(off) OVER (PARTITION BY timeline_id ORDER BY read_seq ROWS UNBOUNDED PRECEDING) AS lra FROM reads", "reads"))
def running_lra(spark, d):
    return commit.running_lra(views.reads(spark, d).select("timeline_id", "read_seq", "off"), "read_seq")


@registered(
    sql(
        """, r AS (SELECT x.timeline_id, x.off, x.payload, a.ts_ms FROM reads x JOIN log a ON x.timeline_id = a.timeline_id AND x.off = a.off),
        k AS (SELECT ts_ms // 7200000 * 7200000 AS w, 1 AS a, 0 AS b, 0 AS c, 0 AS e FROM acked UNION ALL SELECT ts_ms // 7200000 * 7200000, 0, 1, 0, 0 FROM r
            UNION ALL SELECT r.ts_ms // 7200000 * 7200000, 0, 0, 1, 0 FROM r JOIN acked a ON r.timeline_id = a.timeline_id AND r.off = a.off WHERE r.payload = a.payload UNION ALL SELECT ts_ms // 7200000 * 7200000, 0, 0, 0, 1 FROM log WHERE off % 37 = 0),
        s AS (SELECT w, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(e) AS e FROM k GROUP BY w)
        SELECT w AS interval_ms, CAST(sum(a) OVER o AS BIGINT) AS written, CAST(sum(b) OVER o AS BIGINT) AS read, CAST(sum(c) OVER o AS BIGINT) AS verified, CAST(sum(e) OVER o AS BIGINT) AS errors,
        CAST(a * 1000 // 7200000 AS BIGINT) AS written_rate, CAST(b * 1000 // 7200000 AS BIGINT) AS read_rate FROM s WINDOW o AS (ORDER BY w ROWS UNBOUNDED PRECEDING)""",
        "log", "acked", "reads",
    ).replace(") , r AS", "), r AS")
)
def verify_counters(spark, d):
    own = views.log(spark, d)
    seen = views.reads(spark, d).select("timeline_id", "off", "payload").join(own.select("timeline_id", "off", "ts_ms"), ["timeline_id", "off"])
    return integrity.counters(views.acked(spark, d), seen, own.where("off % 37 = 0"), 7_200_000)


@registered(sql("SELECT 'all' AS cluster, round(count(*) FILTER (status = 'WRITABLE') / count(*), 9) AS ratio, count(*) FILTER (status <> 'WRITABLE') AS down FROM units UNION ALL SELECT 'none', NULL, 0", "units"))
def units_up(spark, d):
    units = views.units(spark, d)
    one = lambda rows, name: metrics.up(rows, F.col("status") == "WRITABLE").select(F.lit(name).alias("cluster"), F.round("ratio", 9).alias("ratio"), "down")
    return one(units, "all").unionByName(one(units.limit(0), "none"))


@registered("SELECT l_returnflag AS component, CAST(sum(l_quantity) AS DOUBLE) AS total, CASE l_returnflag WHEN 'A' THEN 1000000e0 WHEN 'N' THEN 2000000e0 END AS capacity, round(CAST(sum(l_quantity) AS DOUBLE) / CASE l_returnflag WHEN 'A' THEN 1000000e0 WHEN 'N' THEN 2000000e0 END, 9) AS load FROM lineitem GROUP BY 1")
def sum_over_capacity(spark, d):
    used = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("component"), F.col("l_quantity").cast("double").alias("quantity"))
    room = spark.createDataFrame([("A", 1e6), ("N", 2e6)], "component string, capacity double")
    return metrics.load(used, room, ["component"], "quantity").withColumn("load", F.round("load", 9))


ENSEMBLES = "SELECT timeline_id, start_offset, coalesce(lead(start_offset) OVER (PARTITION BY timeline_id ORDER BY start_offset), 9223372036854775807) AS e, unnest([CAST(1 AS BIGINT), start_offset % 2 + 2]) AS u FROM segs"
MEMBERS = "SELECT l.timeline_id, l.off, s.u FROM log l JOIN ens s ON l.timeline_id = s.timeline_id AND l.off >= s.start_offset AND l.off < s.e"


def ensembles(spark, d):
    return views.segs(spark, d).withColumn("ensemble", F.array(F.lit(1), (F.col("start_offset") % 2 + 2)).cast("array<bigint>"))


def answers(spark, d):
    """Unit 2 does not answer each 19th offset, unit 3 refuses each 23rd."""
    units = F.explode(F.array(*[F.lit(u).cast("bigint") for u in (1, 2, 3)]))
    return views.log(spark, d).select("timeline_id", "off", units.alias("u")).where("NOT (u = 2 AND off % 19 = 0)").withColumn("ok", F.expr("NOT (u = 3 AND off % 23 = 0)"))


@registered(sql("SELECT timeline_id, off, count(*) AS n_members, count(*) FILTER (NOT bad) AS n_acked, coalesce(list(u ORDER BY u) FILTER (bad), []) AS failed FROM (SELECT *, (u = 2 AND off % 19 = 0) OR (u = 3 AND off % 23 = 0) AS bad FROM members) GROUP BY 1, 2", "log", "segs", ens=ENSEMBLES, members=MEMBERS))
def replica_broadcast(spark, d):
    return model.broadcast(views.log(spark, d), answers(spark, d), ensembles(spark, d))


@registered(sql("SELECT timeline_id, off, u FROM (SELECT *, min(off) OVER (PARTITION BY timeline_id) AS f FROM members WHERE (u = 2 AND off % 19 = 0) OR (u = 3 AND off % 23 = 0)) WHERE off = f", "log", "segs", ens=ENSEMBLES, members=MEMBERS))
def retry_unacked(spark, d):
    return model.retries(views.log(spark, d), answers(spark, d).where("ok"), ensembles(spark, d))


@registered(sql("SELECT timeline_id, u, CAST(CASE WHEN timeline_id % 7 < 5 THEN timeline_id % 7 + 1 END AS BIGINT) AS attempt FROM replicas WHERE NOT ((timeline_id + u) % 3 = 0 AND timeline_id % 7 > 0)", "replicas"))
def fence_retry(spark, d):
    members = views.replicas(spark, d).select("timeline_id", "u")
    tried = members.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("timeline_id") % 7))).where("attempt > 0")
    return model.fence_retries(members, tried.withColumn("answered", F.expr("(timeline_id + u) % 3 = 0 AND attempt = timeline_id % 7")))


@registered(sql("SELECT timeline_id, off, CASE WHEN off <= lra THEN 'ACKED' ELSE 'CANCELLED' END AS status FROM log JOIN (SELECT timeline_id, min(lra) AS lra FROM replicas GROUP BY 1) USING (timeline_id)", "log", "replicas"))
def drain_status(spark, d):
    return model.drained(views.log(spark, d), commit.commit_watermark(views.replicas(spark, d)).withColumnRenamed("watermark", "lra"))


@registered(sql("SELECT timeline_id, k, min(off) AS first_off FROM log GROUP BY 1, 2", "log"))
def index_first(spark, d):
    return retention.secondary_index(views.log(spark, d)).groupBy("timeline_id", "k").agg(F.min("off").alias("first_off"))


# Functions and files


@registered("SELECT r_regionkey AS id, r_name || chr(65533) || 'x' AS text FROM region")
def lossy_utf8(spark, d):
    raw = F.concat(F.col("r_name").cast("binary"), F.unhex(F.lit("FF78")))
    return views.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), fn.lossy_text(raw).alias("text"))


@registered("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'http://' || regexp_replace(url, '^https?://', '') END AS endpoint FROM pages WHERE url IS NOT NULL")
def endpoints(spark, d):
    bare = F.regexp_replace("url", "^https?://", "")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("  "), "url")).otherwise(F.concat(bare, F.lit(" ")))
    return views.table(spark, d, "pages").where("url IS NOT NULL").select("page_id", fn.endpoint(raw).alias("endpoint"))


@registered("SELECT p_partkey, CAST((p_size * 997 + 4095) // 4096 * 4096 AS BIGINT) AS size FROM part")
def aligned_size(spark, d):
    return views.table(spark, d, "part").select("p_partkey", fn.aligned(F.col("p_size") * 997).alias("size"))


@registered(sql("SELECT CAST(timeline_id AS BIGINT) AS log_number, md5(payload) AS digest FROM log", "log"))
def segment_files_read(spark, d):
    """The log as aligned segment files of 64 KB at most, read back."""
    at = f"{batches.folder(spark)}/segments"
    own = views.log(spark, d).select(F.lit("FULL").alias("record_type"), F.col("timeline_id").alias("log_number"), F.col("payload").cast("binary").alias("data"))
    segment_files.write_segments(own, at, 1 << 16, True).agg(F.sum("n")).first()
    return segment_files.read_segments(spark, at, True).select("log_number", F.md5("data").alias("digest"))


SIZED = " + ".join(f"CASE WHEN {c} = 0 THEN 0 WHEN {c} < 128 THEN 2 WHEN {c} < 16384 THEN 3 ELSE 4 END" for c in ("timeline_id", "term", "lra"))


@registered(sql(f"SELECT name, timeline_id, status, term, lra, 2 + strlen(name) + CASE WHEN status = 'SEALED' THEN 2 ELSE 0 END + {SIZED} AS n_bytes FROM (SELECT 't-' || timeline_id AS name, timeline_id, CASE WHEN timeline_id % 3 = 0 THEN 'SEALED' ELSE 'ACTIVE' END AS status, timeline_id % 2 AS term, max(off) * 100 AS lra FROM log GROUP BY timeline_id)", "log"))
def message_codec(spark, d):
    last = views.log(spark, d).groupBy("timeline_id").agg((F.max("off") * 100).alias("lra"))
    metas = last.select(
        F.concat(F.lit("t-"), F.col("timeline_id").cast("string")).alias("name"), "timeline_id", F.when(F.col("timeline_id") % 3 == 0, "SEALED").otherwise("ACTIVE").alias("status"), (F.col("timeline_id") % 2).alias("term"), "lra"
    )
    back = wire.decoded(wire.encoded(metas, wire.TIMELINE), wire.TIMELINE, "name string, timeline_id long, status string, term long, version long, lra long")
    return back.drop("version")


# Streams

REGISTERED["stream_resume"] = batches.resumed, "SELECT event_id, event_id % 2 AS run FROM events"
REGISTERED["stream_backpressure"] = batches.throttled, "SELECT unnest([CAST(0 AS BIGINT), 1, 2]) AS epoch, CAST(2 AS BIGINT) AS files"


@registered("SELECT CAST(count(*) AS BIGINT) AS rows, true AS has_rates FROM events")
def stream_metrics(spark, d):
    """What a running stream reports of itself, added up."""
    import time

    from ..streaming.metrics import QueryMetrics

    listener = QueryMetrics()
    spark.streams.addListener(listener)
    try:
        batches.tail(spark, d).count()
        until = time.monotonic() + 30
        while not listener.ended and time.monotonic() < until:  # reports come a little later
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark).agg(F.sum("input_rows").alias("rows"), F.coalesce(F.max(F.col("trigger_ms").isNotNull()), F.lit(False)).alias("has_rates"))
