"""Column types, dataset schemas and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import InvalidOptions

#: Names of the ten column types, and what holds them.
SPARK_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "json": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str
    nullable: bool = True
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.data_type not in SPARK_TYPES:
            raise InvalidOptions(f"unknown type {self.data_type!r}")


@dataclass(frozen=True)
class DatasetSchema:
    fields: tuple[Field, ...]
    version: int = 1

    def struct(self) -> T.StructType:
        kind = lambda f: {"tidelog.type": f.data_type} | f.metadata
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.data_type], f.nullable, kind(f)) for f in self.fields])

    @staticmethod
    def of(struct: T.StructType, version: int = 1) -> DatasetSchema:
        names = {type(v): k for k, v in reversed(SPARK_TYPES.items())}
        own = lambda m: {k: v for k, v in m.items() if k != "tidelog.type"}
        return DatasetSchema(tuple(Field(f.name, f.metadata.get("tidelog.type") or names[type(f.dataType)], f.nullable, own(f.metadata)) for f in struct), version)


@dataclass(frozen=True)
class Policies:
    """What a dataset keeps and how; ages in ms, sizes in bytes, None for no bound."""

    max_age_ms: int | None = None
    max_bytes: int | None = None
    row_enabled: bool = True
    column_enabled: bool = True
    parquet_enabled: bool = True
    offload_to: str | None = None
    indexes: tuple[str, ...] = ()
    target_freshness_ms: int | None = None
    compact_by_key: bool = False


@dataclass(frozen=True)
class Dataset:
    name: str
    schema: DatasetSchema
    policies: Policies = Policies()
    status: str = "active"
    version: int = 0
    created_ms: int = 0
    updated_ms: int = 0

    def to_json(self) -> str:
        data = {k: getattr(self, k) for k in ("name", "status", "version", "created_ms", "updated_ms")}
        data["policies"] = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self.policies).items()}
        data["schema"] = {"version": self.schema.version, "fields": [vars(f) for f in self.schema.fields]}
        return json.dumps(data, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Dataset:
        data = json.loads(text)
        schema, policies = data.pop("schema"), data.pop("policies")
        policies["indexes"] = tuple(policies["indexes"])
        return Dataset(schema=DatasetSchema(tuple(Field(**f) for f in schema["fields"]), schema["version"]), policies=Policies(**policies), **data)

    def at(self, version: int, **changes) -> Dataset:
        return replace(self, version=version, **changes)
