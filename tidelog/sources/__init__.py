"""A Spark data source over timelines: ``spark.dataSource.register(EventLogSource)``, then format "eventlog".

With ``catalog`` (a catalog's root with its namespace) and ``timeline`` it reads what is
committed, by manifest, as a batch or as a stream that goes on with each commit; with
``path`` alone the files of a folder, as a batch. Bounds on the offset reach the files;
batches need ``spark.sql.python.filterPushdown.enabled`` for that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

NAMES = ["off", "term", "ts_ms", "key", "txn_id", "payload"]


@dataclass
class Piece(InputPartition):
    """A file, and the least and greatest offset wanted of it; with term only events of that term."""

    path: str
    low: int | None = None
    high: int | None = None
    term: int | None = None


class Committed:
    """A timeline as its catalog's files tell, without a session."""

    def __init__(self, catalog: str, timeline: str):
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(catalog.rstrip("/"))
        self.timeline = timeline

    def _folders(self, kind: str) -> list[str]:
        return [f.base_name for f in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{kind}", allow_not_found=True))]

    def _latest(self, kind: str, folder: str) -> dict | None:
        versions = [f.path for f in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{kind}/{folder}", allow_not_found=True)) if f.base_name[:-5].isdigit()]
        if not versions:
            return None
        with self.fs.open_input_stream(max(versions)) as stream:
            return json.loads(stream.read())

    def last(self) -> int:
        """The last committed offset."""
        entry = self._latest("timelines", quote(self.timeline, safe=""))
        return entry["lra"] if entry else 0

    def pieces(self, after: int, until: int | None = None) -> list[Piece]:
        """Files of the committed events with offsets beyond after, up to until."""
        from ..timeline import limits

        entry = self._latest("timelines", quote(self.timeline, safe=""))
        if entry is None:
            return []
        limit, out, until = limits(entry), [], entry["lra"] if until is None else until
        for name in self._folders("manifests"):
            key = unquote(name)
            if key.startswith(f"{self.timeline}/") and int(key.rpartition("/")[2].split("-")[0]) <= until and (m := self._latest("manifests", name)):
                high = min(m["end"] - 1, limit(m["term"]), until)
                if max(m["start"], after + 1) <= high:
                    out += [Piece(f, max(m["start"], after + 1), high, m["term"]) for f in files_of(m["path"])]
        return out


def files_of(path: str) -> list[str]:
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [f"{scheme}{f}" for f in ds.dataset(base, format="parquet", filesystem=fs, exclude_invalid_files=True).files]


def rows_of(piece: Piece, low: int | None = None, high: int | None = None):
    test = None
    lows, highs = [x for x in (piece.low, low) if x is not None], [x for x in (piece.high, high) if x is not None]
    bounds = [ds.field("off") >= max(lows)] if lows else []
    bounds += [ds.field("off") <= min(highs)] if highs else []
    bounds += [ds.field("term") == piece.term] if piece.term is not None else []
    for bound in bounds:
        test = bound if test is None else test & bound
    fs, path = pyarrow.fs.FileSystem.from_uri(piece.path)
    yield from ds.dataset(path, format="parquet", filesystem=fs).to_batches(columns=NAMES, filter=test)


class EventLogReader(DataSourceReader):
    """One partition a file; bounds on the offset are pushed into the file's own statistics."""

    def __init__(self, path: str | None, committed: Committed | None):
        self.path, self.committed, self.low, self.high = path, committed, None, None

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("off",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    bound = f.value + isinstance(f, GreaterThan)
                    self.low = bound if self.low is None else max(self.low, bound)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    bound = f.value - isinstance(f, LessThan)
                    self.high = bound if self.high is None else min(self.high, bound)
            yield f  # Spark checks once more

    def partitions(self):
        if self.committed:
            return self.committed.pieces(0 if self.low is None else self.low - 1, self.high)
        return [Piece(f) for f in files_of(self.path)]

    def read(self, partition):
        if partition is not None:  # as it is where there are none
            yield from rows_of(partition, self.low, self.high)


class EventLogStreamReader(DataSourceStreamReader):
    """Offsets of the stream are those of the timeline: what is committed comes once, in the order of commits."""

    def __init__(self, committed: Committed, start: int):
        self.committed, self.start = committed, start

    def initialOffset(self):
        return {"off": self.start - 1}

    def latestOffset(self):
        return {"off": max(self.start - 1, self.committed.last())}

    def partitions(self, start, end):
        return self.committed.pieces(start["off"], end["off"])

    def read(self, partition):
        if partition is not None:
            yield from rows_of(partition)


class EventLogSource(DataSource):
    @classmethod
    def name(cls):
        return "eventlog"

    def schema(self):
        return "off long, term long, ts_ms long, key binary, txn_id long, payload binary"

    def _committed(self) -> Committed | None:
        return Committed(self.options["catalog"], self.options["timeline"]) if "catalog" in self.options else None

    def reader(self, schema):
        return EventLogReader(self.options.get("path"), self._committed())

    def streamReader(self, schema):
        return EventLogStreamReader(self._committed(), int(self.options.get("start", 1)))
