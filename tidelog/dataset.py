"""Datasets: typed tables with snapshots, scans and maintenance actions."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, now_ms
from .errors import AlreadyExists, CatalogError, NotFound, ScanError, VersionConflict
from .operators import scan as scans
from .types import Dataset

#: Files smaller than this are put together by a compaction.
SMALL_FILE = 32 << 20
#: Values of an indexed field that a part's entry lists, at most; of a field with more, all parts are read.
MOST_VALUES = 1000


class DatasetClient:
    """A dataset's rows lie in Parquet folders; a snapshot is the list of those that belong to it.

    Offsets begin at 0 and grow by append; each row has ``_offset`` and ``_schema_id``.
    """

    def __init__(self, catalog: Catalog, root: str, name: str):
        self.catalog, self.spark, self.root, self.name = catalog, catalog.spark, root.rstrip("/"), name
        self.dataset: Dataset = catalog.get_dataset(name)

    def _snapshot(self, number: int | None = None) -> dict:
        """A snapshot's entry {number, next, parts, oldest}; its number is its version in the catalog."""
        got = self.catalog.store.latest("snapshots", self.name)
        now = got.value if got else {"number": 0, "next": 0, "parts": [], "oldest": 0}
        if number is None or number == now["number"]:
            return now
        past = self.catalog.store.at("snapshots", self.name, number) if now["oldest"] <= number < now["number"] else None
        if past is None and number != 0:
            raise NotFound(f"snapshot {number} of {self.name}")
        return past.value if past else {"number": 0, "next": 0, "parts": [], "oldest": 0}

    def _commit(self, state: dict, parts: list[dict], following: int, oldest: int | None = None) -> int:
        """The snapshot after state; raises VersionConflict if that is no longer the last one."""
        new = {"number": state["number"] + 1, "next": following, "parts": parts, "oldest": state["oldest"] if oldest is None else oldest}
        self.catalog.store.put("snapshots", self.name, new, state["number"] or None)
        return new["number"]

    @property
    def snapshot(self) -> int:
        return self._snapshot()["number"]

    @property
    def next_offset(self) -> int:
        return self._snapshot()["next"]

    @property
    def index_names(self) -> list[str]:
        return sorted(self.dataset.policies.indexes)

    def _folder(self) -> str:
        return f"{self.root}/data/{self.name}/{uuid.uuid4().hex}"

    def _part(self, path: str) -> dict:
        """A part's entry: its folder, and the values of indexed fields that have few."""
        rows, values = self.spark.read.schema(self._schema()).parquet(path), {}
        for name in self.index_names:
            found = [r[0] for r in rows.select(F.col(name).cast("string")).distinct().limit(MOST_VALUES + 1).collect()]
            if len(found) <= MOST_VALUES:
                values[name] = sorted(v for v in found if v is not None)
        return {"path": path, "values": values}

    def write(self, rows: DataFrame, order: list[str] | None = None) -> tuple[int, int]:
        """Appends rows that must fit the schema; returns their offsets [start, end).

        Whoever commits in between goes first: the rows then get the offsets after theirs.
        """
        from .timeline import delete, numbered

        fields = self.dataset.schema.fields
        missing = [f.name for f in fields if f.name not in rows.columns and not f.nullable]
        unknown = [c for c in rows.columns if c not in {f.name for f in fields}]
        if missing or unknown:
            raise CatalogError(f"{self.name}: missing fields {missing}, unknown fields {unknown}")
        struct = self.dataset.schema.struct()
        typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct])
        required = [F.count_if(F.col(f.name).isNull()).alias(f.name) for f in fields if not f.nullable]
        if required and (nulls := [c for c, n in typed.agg(*required).first().asDict().items() if n]):
            raise CatalogError(f"{self.name}: null in {', '.join(nulls)}")
        state = self._snapshot()
        base, path, staging = state["next"], self._folder(), self._folder()
        placed = numbered(typed, order or [fields[0].name], base - 1, staging).withColumnRenamed("off", "_offset")
        placed.withColumn("_schema_id", F.lit(self.dataset.schema.version).cast("long")).write.parquet(path)
        delete(self.spark, staging)
        n = self.spark.read.parquet(path).count()
        while True:
            try:
                self._commit(state, [*state["parts"], self._part(path)], state["next"] + n)
                return state["next"], state["next"] + n
            except (VersionConflict, AlreadyExists):
                state = self._snapshot()
                if state["next"] != base:
                    moved, old = self._folder(), path
                    self.spark.read.schema(self._schema()).parquet(old).withColumn("_offset", F.col("_offset") + (state["next"] - base)).write.parquet(moved)
                    delete(self.spark, old)
                    base, path = state["next"], moved

    def _schema(self) -> T.StructType:
        return self.dataset.schema.struct().add("_offset", "long").add("_schema_id", "long")

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(*[p["path"] for p in parts]) if parts else self.spark.createDataFrame([], self._schema())

    def rows(self, snapshot: int | None = None) -> DataFrame:
        return self._read(self._snapshot(snapshot)["parts"])

    def read_all(self, snapshot: int | None = None) -> DataFrame:
        return self.rows(snapshot).select(*[f.name for f in self.dataset.schema.fields])

    def scan(self, request: scans.ScanRequest) -> DataFrame:
        """Projection, filters and limit as a plan; with an equality filter on an indexed field, parts that are known not to hold the value are not read."""
        if request.dataset != self.name:
            raise ScanError(f"{request.dataset} is not {self.name}")
        snapshot = None if request.snapshot is None else int(request.snapshot)
        plan = request if request.projection else replace(request, projection=tuple(f.name for f in self.dataset.schema.fields))
        return scans.scan(self._read(self._holding(self._snapshot(snapshot)["parts"], request.filters)), plan)

    def _holding(self, parts: list[dict], filters: tuple[scans.ScanFilter, ...]) -> list[dict]:
        """Parts that may hold the values asked for; values are compared as text only where text settles equality."""
        exact = {f.name for f in self.dataset.schema.fields if f.data_type in ("string", "json")}
        for f in filters:
            if f.op == "eq" and f.field in exact:
                parts = [p for p in parts if f.field not in p["values"] or f.value.decode() in p["values"][f.field]]
        return parts

    # Actions

    def run_action(self, action_id: str) -> dict:
        """Carries out a submitted action: pending, running, then succeeded or failed with a message."""
        action = self.catalog.set_action(action_id, "running")
        try:
            message = getattr(self, f"_{action['kind']}")(action["parameters"])
        except Exception as error:  # the catalog keeps what went wrong
            return self.catalog.set_action(action_id, "failed", str(error)[:500])
        return self.catalog.set_action(action_id, "succeeded", message)

    def _rewritten(self, change: Callable[[DataFrame], DataFrame], folder: str | None = None) -> str:
        """The rows anew, in one part; rows appended meanwhile stay as they are, any other change starts it again."""
        while True:
            state = self._snapshot()
            path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else self._folder()
            change(self._read(state["parts"])).write.parquet(path)
            part = self._part(path)
            now = state
            while now["parts"][: len(state["parts"])] == state["parts"]:
                try:
                    return f"snapshot {self._commit(now, [part, *now['parts'][len(state['parts']) :]], now['next'])}"
                except (VersionConflict, AlreadyExists):
                    now = self._snapshot()

    def _optimize(self, parameters: dict) -> str:
        """Sorted by a field, in files that can be skipped by its bounds."""
        by = parameters.get("by", "_offset")
        return self._rewritten(lambda rows: rows.repartitionByRange(by).sortWithinPartitions(by))

    def _compact(self, parameters: dict) -> str:
        """Latest row of each key if one is given, in fewer files otherwise."""
        if key := parameters.get("key"):
            last = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "_offset").alias("_row")).select("_row.*")
            return self._rewritten(last)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = sum(fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(p["path"])).getLength() for p in self._snapshot()["parts"])
        return self._rewritten(lambda rows: rows.repartition(max(1, held // SMALL_FILE), "_offset").sortWithinPartitions("_offset"))

    def _vacuum(self, parameters: dict) -> str:
        """Deletes what neither the last snapshot nor the ``keep`` before it name."""
        state = self._snapshot()
        oldest = max(state["oldest"], state["number"] - int(parameters.get("keep", 1)))
        paths = lambda numbers: {p["path"] for k in numbers for p in self._snapshot(k)["parts"]}
        gone = paths(range(state["oldest"], oldest)) - paths(range(oldest, state["number"] + 1))
        self._commit(state, state["parts"], state["next"], oldest)  # first nobody may ask for them any more
        for p in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return f"{len(gone)} folders"

    def _unload(self, parameters: dict) -> str:
        """Writes the rows somewhere else, in a format of Spark's."""
        self.read_all().write.format(parameters.get("format", "parquet")).save(parameters["to"])
        return parameters["to"]

    def _offload(self, parameters: dict) -> str:
        """Moves the rows: the snapshot then names the new place."""
        return self._rewritten(lambda rows: rows, parameters["to"])

    def _refresh(self, parameters: dict) -> str:
        """Brings a derived table of counts by a field up to date with what came since; one fresh enough by the policy's target stays."""
        by, into = parameters["by"], f"{self.root}/derived/{self.name}-{parameters['by']}"
        key = f"{self.name}/{by}"
        got = self.catalog.store.latest("derived", key)
        since, old = (got.value["next"], got.value["path"]) if got else (0, None)
        target = self.dataset.policies.target_freshness_ms
        if got and target is not None and now_ms() - got.value["at_ms"] < target:
            return old
        state = self._snapshot()
        new = self._read(state["parts"]).where(F.col("_offset") >= since).groupBy(by).agg(F.count("*").alias("n"))
        if old:
            new = new.unionByName(self.spark.read.parquet(old)).groupBy(by).agg(F.sum("n").alias("n"))
        path = f"{into}/{int(time.time() * 1000)}-{uuid.uuid4().hex}"
        new.write.parquet(path)
        self.catalog.store.put("derived", key, {"next": state["next"], "path": path, "at_ms": now_ms()}, got.version if got else None)
        return path
