"""Durable timelines: append-only logs in Parquet under one folder.

Offsets begin at 1 and are contiguous. Every append writes files of its own, then a
manifest (term, offsets, files), and takes effect when the timeline's entry in the catalog
moves its last offset by compare-and-set. A writer of a newer term fixes the offset that
it goes on after; what an older term has beyond it, and what lies beyond the last offset,
is not read, so a lost or fenced append leaves nothing visible and blocks nobody.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import Cancelled, InvalidArgument, InvalidTerm, NotEnoughUnits, ReadOnly, VersionConflict
from .operators import placement, reads, retention

EVENT = "off long, term long, ts_ms long, key binary, txn_id long, schema_id long, crc32 long, payload binary"
#: Events of a flush, how long one waits for more, events that wait at most.
MAX_BATCH, LINGER_S, MAX_INFLIGHT = 256, 0.005, 1024


@dataclass(frozen=True)
class TimelineOptions:
    replication_factor: int = 1
    retention_ms: int | None = None
    max_bytes: int | None = None
    compaction: bool = False
    schema_id: int = 0
    max_records_per_file: int = 5_000_000


def numbered(rows: DataFrame, order: list[str], base: int, staging: str) -> DataFrame:
    """rows with ``off`` from base + 1 on in the given order, without one task seeing all: parts by range, numbered after their counts.

    The parts are written to the folder staging first, so that they are the same when counted and when
    numbered, whatever is computed anew; equal rows of the order are dealt by a hash of the row. The
    caller deletes the folder once the result is written.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = [c for c, t in rows.dtypes if "map<" not in t and t != "variant"]
    spread = rows.repartitionByRange(parts, *order, F.xxhash64(*plain))
    spread = spread.withColumn("_part", F.spark_partition_id())
    spread.write.parquet(staging)
    held = spark.read.schema(spread.schema).parquet(staging)
    counts = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}  # as many as parts
    at, starts = base, {}
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(base)
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order, F.xxhash64(*plain)))
    return held.withColumn("off", (start + within).cast("long")).drop("_part")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def limits(entry: dict) -> Callable[[int], int]:
    """The last offset that events of a term count up to, by a timeline's entry."""

    def limit(term: int) -> int:
        return min([entry["lra"], *(base for later, base in entry["bases"] if later > term)])

    return limit


class Timeline:
    def __init__(self, catalog: Catalog, root: str, name: str, options: TimelineOptions = TimelineOptions(), readonly: bool = False):
        self.spark: SparkSession = catalog.spark
        self.catalog, self.root, self.name, self.options, self.readonly = catalog, root.rstrip("/"), name, options, readonly
        self._seen: dict[str, dict | None] = {}
        if readonly:
            self.meta = catalog.get_timeline(name)
        else:
            self.meta = catalog.new_term(name)
            self.recover()

    @property
    def timeline_id(self) -> int:
        return self.meta.value["timeline_id"]

    @property
    def term(self) -> int:
        return self.meta.value["term"]

    def recover(self) -> None:
        """Takes out manifests that count no more; the first segment gets its ensemble."""
        limit = limits(self.meta.value)
        for key, m in self._named().items():
            if m["start"] > limit(m["term"]):
                self._forget(key)
        if self.catalog.list_units() and not self.catalog.last_segment(self.name):
            self.catalog.put_segment(self.name, 1, self.place())

    def place(self, include: list[str] = (), exclude: list[str] = ()) -> list[str]:
        """Addresses of a new ensemble."""
        as_rows = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        chosen = placement.select_ensemble(
            self.catalog.units(), as_rows([(a, i) for i, a in enumerate(include)], "address string, rank int"), as_rows([(a,) for a in exclude], "address string"), self.options.replication_factor
        ).orderBy("place")
        found = [r["address"] for r in chosen.collect()]  # as many as replicas
        if len(found) < self.options.replication_factor:
            raise NotEnoughUnits(f"{self.options.replication_factor} units wanted")
        return found

    def _named(self, end: int = reads.END) -> dict[str, dict]:
        """Manifests of appends that begin before end; each is read once, as they never change."""
        for key in self.catalog.store.keys("manifests", f"{self.name}/"):
            if key not in self._seen and int(key.rpartition("/")[2].split("-")[0]) < end:
                got = self.catalog.store.latest("manifests", key)
                self._seen[key] = got.value if got else None
        return {k: m for k, m in self._seen.items() if m}

    def _forget(self, key: str) -> None:
        if got := self.catalog.store.latest("manifests", key):
            self.catalog.store.put("manifests", key, None, got.version)
        self._seen[key] = None

    def _manifests(self, end: int = reads.END) -> list[dict]:
        """What counts, in order of offsets; ``end`` of a manifest lies after the last offset of it that counts."""
        limit = limits(self.catalog.get_timeline(self.name).value)
        live = [m | {"whole": m["end"], "end": min(m["end"], limit(m["term"]) + 1)} for m in self._named(end).values()]
        return sorted((m for m in live if m["start"] < m["end"]), key=lambda m: m["start"])

    def _checked(self) -> dict:
        got = self.catalog.get_timeline(self.name)
        if got.value["term"] > self.term:
            raise InvalidTerm(got.value["term"])
        self.meta = got
        return got.value

    def append(self, rows: DataFrame, order: list[str]) -> tuple[int, int]:
        """Appends rows (payload, and key, txn_id, ts_ms if they have them) in the given order; returns their offsets [start, end)."""
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        try:
            return self._append(lambda base: numbered(rows, order, base, staging))
        finally:
            delete(self.spark, staging)

    def _append(self, placed: Callable[[int], DataFrame]) -> tuple[int, int]:
        if self.readonly:
            raise ReadOnly(self.name)
        entry, base = self._checked(), self.meta.value["lra"]
        new = placed(base)
        have = set(new.columns)
        own = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        ts = F.coalesce(F.col("ts_ms"), F.unix_millis(F.current_timestamp())) if "ts_ms" in have else F.unix_millis(F.current_timestamp())
        events = new.select(
            "off", F.lit(self.term).cast("long").alias("term"), ts.cast("long").alias("ts_ms"), own("key", "binary"), own("txn_id", "long"),
            F.lit(self.options.schema_id).cast("long").alias("schema_id"), F.crc32(F.col("payload").cast("binary")).alias("crc32"), F.col("payload").cast("binary").alias("payload"),
        )
        path = f"{self.root}/log/{self.timeline_id}/{uuid.uuid4().hex}"
        events.sortWithinPartitions("off").write.option("maxRecordsPerFile", self.options.max_records_per_file).parquet(path)
        n = self.spark.read.schema(EVENT).parquet(path).count()
        if not n:
            return base + 1, base + 1
        start, end = base + 1, base + 1 + n
        key = f"{self.name}/{start:019d}-{self.term}-{uuid.uuid4().hex[:12]}"
        self.catalog.store.put("manifests", key, {"start": start, "end": end, "term": self.term, "path": path}, None)
        try:
            while True:
                try:
                    self.meta = self.catalog.update_timeline(self.name, entry | {"lra": end - 1}, self.meta.version)
                    return start, end
                except VersionConflict:  # a newer term raises here; other changes of the entry do not matter
                    entry = self._checked()
                    if entry["lra"] != base:
                        raise
        except InvalidTerm:
            self._forget(key)
            raise
        except Exception:  # whether it took effect is unknown: the next append begins a term, which settles it
            self.meta = self.catalog.new_term(self.name) if self.catalog.get_timeline(self.name).value["term"] == self.term else self.meta
            raise

    def record(self, payload: bytes, key: bytes | None = None, txn_id: int | None = None) -> int:
        """Appends one event and returns its offset; a Recorder puts many together."""
        return self.record_batch([(payload, key, txn_id)])[0]

    def record_batch(self, events: list[tuple[bytes, bytes | None, int | None]], term: int | None = None) -> tuple[int, int]:
        """Appends events (payload, key, txn_id) that are at hand, in one file; all are checked before any is written."""
        if not events:
            raise InvalidArgument("an empty batch")
        if any(e is None or e[0] is None for e in events):
            raise InvalidArgument("an event without payload")
        if term is not None and term < self._checked()["term"]:
            raise InvalidTerm(self.meta.value["term"])
        data = lambda x: None if x is None else bytearray(x)
        rows = lambda base: self.spark.createDataFrame([(base + 1 + i, data(p), data(k), t) for i, (p, k, t) in enumerate(events)], "off long, payload binary, key binary, txn_id long").coalesce(1)
        return self._append(rows)

    def truncate(self, after: int) -> None:
        """Forgets what lies behind an offset: a new term goes on from there."""
        if self.readonly:
            raise ReadOnly(self.name)
        self._checked()
        self.meta = self.catalog.new_term(self.name, after)
        self.recover()

    def rows(self, start: int = reads.ORIGIN, end: int = reads.END) -> DataFrame:
        """Committed events of [start, end); files outside it are not opened."""
        if end < start:
            raise InvalidArgument(f"end {end} is before start {start}")
        live = [m for m in self._manifests(end) if m["end"] > start and m["start"] < end]
        found = self.spark.read.schema(EVENT).parquet(*[m["path"] for m in live]) if live else self.spark.createDataFrame([], EVENT)
        for m in live:  # few: a term that was cut within an append
            if m["end"] < m["whole"]:
                found = found.where((F.col("term") != m["term"]) | (F.col("off") < m["end"]))
        return found.where(reads.in_range(start, end)).withColumn("timeline_id", F.lit(self.timeline_id).cast("long"))

    def fetch(self, start: int | str = "earliest", limit: int | None = None) -> DataFrame:
        """Events in order from an offset, or from the "earliest", or after the "latest"."""
        first = {"earliest": reads.ORIGIN, "latest": self.catalog.get_timeline(self.name).value["lra"] + 1}.get(start, start)
        rows = self.rows(first).orderBy("off")
        return rows if limit is None else rows.limit(limit)

    def fetch_by_key(self, key: bytes, limit: int | None = None) -> DataFrame:
        """Events from the first one of a key on."""
        first = self.rows().where(F.col("key") == F.lit(bytearray(key))).agg(F.min("off")).first()[0]
        return self.fetch(reads.END - 1 if first is None else first, limit)

    def retained(self) -> DataFrame:
        """What the options keep: recent events, within the bytes, the latest of each key."""
        rows = self.rows()
        if self.options.retention_ms is not None:
            rows = retention.by_age(rows, self.options.retention_ms)
        if self.options.max_bytes is not None:
            rows = retention.by_bytes(rows, self.options.max_bytes)
        if self.options.compaction:
            rank = F.row_number().over(W.partitionBy(F.coalesce("key", F.concat(F.lit("#"), F.col("off").cast("string")).cast("binary"))).orderBy(F.desc("off")))
            rows = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        return rows

    def tail(self) -> DataFrame:
        """The log's files as a stream; unlike fetch() it also sees files of appends that lost their manifest, so join it with the watermark."""
        return self.spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(f"{self.root}/log/{self.timeline_id}")

    def close(self) -> None:
        """Ends this writer; reading goes on."""
        self.readonly = True

    def drop(self) -> None:
        """Deletes the timeline with its segments, manifests and files."""
        got = self.catalog.get_timeline(self.name)
        self.catalog.delete_timeline(self.name, got.version)
        for key in self._named():
            self._forget(key)
        delete(self.spark, f"{self.root}/log/{self.timeline_id}")


class Recorder:
    """Puts single events together: a flush takes up to max_batch of them, or what came within linger seconds.

    ``record`` gives a Future of the event's offset and waits while max_inflight events are on their
    way. ``close`` writes what waits, or, told not to, fails it with Cancelled.
    """

    def __init__(self, timeline: Timeline, max_batch: int = MAX_BATCH, linger: float = LINGER_S, max_inflight: int = MAX_INFLIGHT):
        self.timeline, self.max_batch, self.linger = timeline, max_batch, linger
        self.room, self.waiting, self.changed = threading.Semaphore(max_inflight), deque(), threading.Condition()
        self.closed, self.worker = False, threading.Thread(target=self._run, daemon=True)
        self.worker.start()

    def record(self, payload: bytes, key: bytes | None = None, txn_id: int | None = None) -> Future:
        self.room.acquire()
        with self.changed:
            if self.closed:
                self.room.release()
                raise Cancelled("the recorder is closed")
            done = Future()
            self.waiting.append(((payload, key, txn_id), done))
            self.changed.notify()
        return done

    def _run(self) -> None:
        while True:
            with self.changed:
                self.changed.wait_for(lambda: self.waiting or self.closed)
                if not self.waiting:
                    return
                self.changed.wait_for(lambda: len(self.waiting) >= self.max_batch or self.closed, self.linger)
                batch = [self.waiting.popleft() for _ in range(min(self.max_batch, len(self.waiting)))]
            try:
                start, _ = self.timeline.record_batch([event for event, _ in batch])
                for i, (_, done) in enumerate(batch):
                    done.set_result(start + i)
            except Exception as error:
                for _, done in batch:
                    done.set_exception(error)
            self.room.release(len(batch)) if batch else None

    def close(self, drain: bool = True) -> None:
        with self.changed:
            self.closed = True
            dropped = [] if drain else list(self.waiting)
            if not drain:
                self.waiting.clear()
            self.changed.notify_all()
        for _, done in dropped:
            done.set_exception(Cancelled("the recorder was closed"))
            self.room.release()
        self.worker.join()


class Cursor:
    """Events in order from an offset, piece by piece; remembers where it is, so that it can go on after an error.

    It ends after limit events, or when none came for timeout seconds; without a timeout it ends at
    the log's end. A read that fails is tried again from the same place, ``retries`` times in a row.
    """

    def __init__(self, timeline: Timeline, start: int = reads.ORIGIN, limit: int | None = None, timeout: float | None = None, piece: int = reads.CHUNK, poll: float = 0.5, retries: int = 5):
        self.timeline, self.position, self.limit, self.timeout, self.piece, self.poll, self.retries = timeline, start, limit, timeout, piece, poll, retries

    def _read(self, n: int) -> list:
        for attempt in range(self.retries + 1):
            try:
                return self.timeline.rows(self.position, self.position + n).orderBy("off").collect()  # n events at most
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.poll)

    def __iter__(self):
        last = time.monotonic()
        while self.limit is None or self.limit > 0:
            found = self._read(self.piece if self.limit is None else min(self.piece, self.limit))
            for event in found:
                self.position = event["off"] + 1
                if self.limit is not None:
                    self.limit -= 1
                yield event
            if found:
                last = time.monotonic()
            elif self.timeout is None or time.monotonic() - last >= self.timeout:
                return
            else:
                time.sleep(min(self.poll, self.timeout))
