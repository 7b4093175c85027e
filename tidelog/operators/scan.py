"""Dataset scans: projection, conjunctive filters, limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ScanError

OPERATIONS = {"eq": eq, "not_eq": ne, "lt": lt, "lt_eq": le, "gt": gt, "gt_eq": ge}


@dataclass(frozen=True)
class ScanFilter:
    """field op value; the value is UTF-8 text read as the field's type, raw bytes for binary."""

    field: str
    op: str
    value: bytes


@dataclass(frozen=True)
class ScanRequest:
    dataset: str
    projection: tuple[str, ...] = ()
    filters: tuple[ScanFilter, ...] = ()
    limit: int | None = None
    snapshot: str | None = None
    order: tuple[str, ...] = field(default=())


def scan(rows: DataFrame, request: ScanRequest) -> DataFrame:
    """The request as a plan: filters and columns reach the source, a limit takes rows in the request's order."""
    known = {f.name: f.dataType for f in rows.schema}
    if missing := [c for c in (*request.projection, *(f.field for f in request.filters), *request.order) if c not in known]:
        raise ScanError(f"unknown fields: {', '.join(missing)}")
    if unknown := [f.op for f in request.filters if f.op not in OPERATIONS]:
        raise ScanError(f"unknown operations: {', '.join(unknown)}")
    if request.filters:
        value = lambda f: F.lit(f.value) if isinstance(known[f.field], T.BinaryType) else F.lit(f.value.decode()).cast(known[f.field])
        rows = rows.where(reduce(and_, (OPERATIONS[f.op](F.col(f.field), value(f)) for f in request.filters)))
    if request.order:
        rows = rows.orderBy(*request.order)
    if request.limit is not None:
        rows = rows.limit(request.limit)
    return rows.select(*request.projection) if request.projection else rows
