"""Checks of a dataset spec. Every finding has a code, a place and a message."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

from weftspark.functions.derive import ExpressionError, dependencies, levels
from weftspark.operators.windows import span_seconds
from weftspark.plans.providers import by_column_name
from weftspark.plans.spec import Dataset, Rule

#: Codes that keep a spec from being generated.
SEVERE = frozenset(
    "PK_COL_MISSING FK_REF_TABLE_MISSING FK_COL_MISSING FK_REF_COL_MISSING GEN_TABLE_MISSING GEN_COL_MISSING "
    "INVALID_DERIVED_EXPR MISSING_DERIVED_DEP WINDOW_ORDER_BY_MISSING WINDOW_PARTITION_BY_MISSING WINDOW_FRAME_INVALID CYCLE".split()
)


@dataclass(frozen=True)
class Issue:
    code: str
    location: str
    message: str

    @property
    def severe(self) -> bool:
        return self.code in SEVERE


def check_schema(spec: Dataset) -> list[Issue]:
    out = []
    for t in spec.tables.values():
        names = {c.name for c in t.columns}
        if not t.primary_key:
            out.append(Issue("MISSING_PK", t.name, "no primary key"))
        if not t.row_count:
            out.append(Issue("MISSING_ROW_COUNT", t.name, "no row count; a default is taken"))
        out += [Issue("PK_COL_MISSING", f"{t.name}.{c}", "primary key names no column") for c in t.primary_key if c not in names]
        for k in t.foreign_keys:
            if k.column not in names:
                out.append(Issue("FK_COL_MISSING", f"{t.name}.{k.column}", "foreign key names no column"))
            if k.ref_table not in spec.tables:
                out.append(Issue("FK_REF_TABLE_MISSING", f"{t.name}.{k.column}", f"no table {k.ref_table!r}"))
            elif k.ref_column not in {c.name for c in spec.tables[k.ref_table].columns}:
                out.append(Issue("FK_REF_COL_MISSING", f"{t.name}.{k.column}", f"no column {k.ref_table}.{k.ref_column}"))
        for fd in t.fds:
            out += [Issue("FD_COL_MISSING", f"{t.name}.{c}", "dependency names no column") for c in (*fd["lhs"], *fd["rhs"]) if c not in names]
        out += [Issue("IMPLICATION_COL_MISSING", f"{t.name}.{i['column']}", "implication names no column") for i in t.implications if i["column"] not in names]
    if spec.schema_mode == "star" and not any(t.is_fact for t in spec.tables.values()):
        out.append(Issue("SCHEMA_MODE_MISMATCH", "spec", "a star schema without a fact table"))
    return out


def check_rules(spec: Dataset) -> list[Issue]:
    out = []
    for r in spec.rules:
        t = spec.tables.get(r.table)
        if t is None:
            out.append(Issue("GEN_TABLE_MISSING", r.table, f"a rule for an unknown table; near: {difflib.get_close_matches(r.table, spec.tables)}"))
            continue
        names = {c.name for c in t.columns}
        if r.column not in names:
            out.append(Issue("GEN_COL_MISSING", f"{r.table}.{r.column}", f"a rule for an unknown column; near: {difflib.get_close_matches(r.column, names)}"))
    for t in spec.tables.values():
        keys = {k.column for k in t.foreign_keys} | set(t.primary_key)
        for c in t.columns:
            if c.name not in keys and spec.rule(t.name, c.name) is None:
                out.append(Issue("MISSING_GEN_SPEC", f"{t.name}.{c.name}", "no rule; the type's default is taken"))
    return out


def check_derived(spec: Dataset) -> list[Issue]:
    out = []
    for t in spec.tables.values():
        near = {c.name for c in t.columns}
        for k in t.foreign_keys:
            near |= {c.name for c in spec.tables[k.ref_table].columns} if k.ref_table in spec.tables else set()
        derived = {}
        for r in (r for r in spec.rules if r.table == t.name and r.distribution):
            place, d = f"{t.name}.{r.column}", r.distribution
            if d["kind"] == "derived":
                try:
                    missing = dependencies(d["expression"]) - near
                    derived[r.column] = d["expression"]
                except ExpressionError as error:
                    out.append(Issue("INVALID_DERIVED_EXPR", place, str(error)))
                    continue
                out += [Issue("MISSING_DERIVED_DEP", place, f"reads {m!r}; near: {difflib.get_close_matches(m, near)}") for m in sorted(missing)]
            elif d["kind"] == "window":
                if d.get("order_by") not in near:
                    out.append(Issue("WINDOW_ORDER_BY_MISSING", place, f"orders by {d.get('order_by')!r}"))
                out += [Issue("WINDOW_PARTITION_BY_MISSING", place, f"partitions by {p!r}") for p in d.get("partition_by", ()) if p not in near]
                frame = d.get("frame", {})
                try:
                    if frame.get("kind", "RANGE").upper() == "RANGE":
                        span_seconds(frame.get("preceding", "1d"))
                except ValueError as error:
                    out.append(Issue("WINDOW_FRAME_INVALID", place, str(error)))
        try:
            levels(derived)
        except ExpressionError as error:
            out.append(Issue("CYCLE", t.name, str(error)))
    return out


def check(spec: Dataset) -> list[Issue]:
    return [*check_schema(spec), *check_rules(spec), *check_derived(spec)]


def repaired(spec: Dataset) -> Dataset:
    """A copy with row counts, near-miss table and column names of rules, and providers filled in."""
    out = Dataset.from_json(spec.to_json())
    for t in out.tables.values():
        t.row_count = t.row_count or (1_000_000 if t.is_fact else 100_000)
        t.kind = t.kind or ("fact" if t.is_fact else "dimension")
    for r in out.rules:
        if r.table not in out.tables:
            r.table = next(iter(difflib.get_close_matches(r.table, out.tables, 1, 0.8)), r.table)
        names = [c.name for c in out.tables[r.table].columns] if r.table in out.tables else []
        if names and r.column not in names:
            r.column = next(iter(difflib.get_close_matches(r.column, names, 1, 0.8)), r.column)
    for t in out.tables.values():
        keys = {k.column for k in t.foreign_keys} | set(t.primary_key)
        for c in t.columns:
            provider = by_column_name(c.name) if c.sql_type == "TEXT" else None
            if provider and c.name not in keys and out.rule(t.name, c.name) is None:
                out.rules.append(Rule(t.name, c.name, provider={"name": provider}))
    return out
