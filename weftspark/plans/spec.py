"""The declarative dataset spec: tables, keys, generation rules, events, workload; JSON in and out."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

SQL_TYPES = {
    "INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(), "BOOL": T.BooleanType(),
}
# Other names of the types.
ALIASES = {
    "INT32": "INT", "INT64": "INT", "INTEGER": "INT", "BIGINT": "INT", "SMALLINT": "INT", "TINYINT": "INT", "SERIAL": "INT", "YEAR": "INT", "MEDIUMINT": "INT",
    "DECIMAL": "FLOAT", "NUMERIC": "FLOAT", "DOUBLE": "FLOAT", "REAL": "FLOAT", "FLOAT64": "FLOAT",
    "VARCHAR": "TEXT", "CHAR": "TEXT", "STRING": "TEXT", "ENUM": "TEXT", "SET": "TEXT", "BLOB": "TEXT", "LONGTEXT": "TEXT", "MEDIUMTEXT": "TEXT", "JSON": "TEXT",
    "TIMESTAMP": "DATETIME", "TIME": "TEXT", "BOOLEAN": "BOOL", "BIT": "BOOL",
}


def sql_type(name: str) -> str:
    """The canonical type of a declared one, without length or precision."""
    plain = name.split("(")[0].strip().upper()
    found = ALIASES.get(plain, plain)
    if found not in SQL_TYPES:
        raise ValueError(f"unknown type {name!r}")
    return found


@dataclass
class Column:
    name: str
    sql_type: str = "TEXT"
    nullable: bool = True
    unique: bool = False
    role: str | None = None  # primary_key, foreign_key, measure, attribute
    references: str | None = None  # "table.column"

    def __post_init__(self) -> None:
        self.sql_type = sql_type(self.sql_type)


@dataclass
class ForeignKey:
    column: str
    ref_table: str
    ref_column: str


@dataclass
class Table:
    name: str
    columns: list[Column]
    kind: str | None = None  # fact, dimension, or by its foreign keys
    row_count: int | None = None
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    candidate_keys: list[list[str]] = field(default_factory=list)
    fds: list[dict] = field(default_factory=list)
    implications: list[dict] = field(default_factory=list)

    @property
    def is_fact(self) -> bool:
        return self.kind == "fact" or (self.kind is None and bool(self.foreign_keys))

    def schema(self) -> T.StructType:
        """The Spark schema; roles and references are field metadata."""
        keep = lambda c: {k: v for k, v in (("role", c.role), ("references", c.references), ("unique", c.unique)) if v}
        return T.StructType([T.StructField(c.name, SQL_TYPES[c.sql_type], c.nullable, keep(c)) for c in self.columns])


@dataclass
class Rule:
    """How a column comes about: a distribution, an expression, a window or a provider."""

    table: str
    column: str
    distribution: dict | None = None
    provider: dict | None = None


@dataclass
class Event:
    name: str
    start: str | int | None = None
    end: str | int | None = None
    effects: list[dict] = field(default_factory=list)  # {"table", "column", "effect", "value", "probability"}


@dataclass
class Dataset:
    tables: dict[str, Table]
    rules: list[Rule] = field(default_factory=list)
    events: list[Event] = field(default_factory=list)
    workload: list[dict] = field(default_factory=list)
    description: str = ""
    schema_mode: str = "star"

    def rule(self, table: str, column: str) -> Rule | None:
        return next((r for r in self.rules if (r.table, r.column) == (table, column)), None)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Dataset:
        raw: dict[str, Any] = json.loads(text)
        tables = {}
        for name, t in raw.pop("tables").items():
            columns = [Column(**c) for c in t.pop("columns")]
            keys = [ForeignKey(**k) for k in t.pop("foreign_keys", [])]
            tables[name] = Table(columns=columns, foreign_keys=keys, **t)
        rules = [Rule(**r) for r in raw.pop("rules", [])]
        events = [Event(**e) for e in raw.pop("events", [])]
        return cls(tables=tables, rules=rules, events=events, **raw)

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load(cls, path: str) -> Dataset:
        return cls.from_json(Path(path).read_text())
