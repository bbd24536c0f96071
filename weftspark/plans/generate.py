"""From a dataset spec to one lazy DataFrame per table.

Dimensions come first. A fact row's foreign keys are laid out so that every parent is covered
and the rest follows a Zipf law; then come base columns, events, look-ups of parent columns
that derived columns read, constraints, derived columns and windows. Nothing is materialised.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import rng
from weftspark.functions.derive import dependencies, derive
from weftspark.operators import constraints, synth
from weftspark.operators.ordered import numbered
from weftspark.operators.predicates import active
from weftspark.operators.relational import lookup
from weftspark.operators.windows import Frame, WindowSpec, add_windows
from weftspark.plans.providers import lookup_columns, lookup_source, provide
from weftspark.plans.spec import SQL_TYPES, Dataset, Rule, Table
from weftspark.plans.validate import check

ROW = "_row"
DIMENSION_ROWS, FACT_ROWS = 100_000, 1_000_000


# Parts of names of columns that list categories, and of ones that name people; hours of
# the rush; ranges of what a time becomes in a number column of some names, in the rush and besides.
CATEGORY_NAMES = ("type_name", "type_", "_type", "category", "_category", "category_", "_code", "code_", "zone_name", "region_name", "status", "class", "kind")
PERSON_NAMES = ("rider_name", "driver_name", "customer_name", "user_name", "person_name", "employee_name", "first_name", "last_name")
RUSH_HOURS = ((7, 9), (16, 18))
BY_HOUR = (
    (("duration", "minutes"), (30, 60), (15, 30)),
    (("distance", "km"), (5, 12), (3, 8)),
    (("surge", "multiplier"), (1.5, 3.0), (1.0, 1.5)),
)


def is_category_name(column: str) -> bool:
    """Whether a column's name says that it lists categories, and not people."""
    low = column.lower()
    return any(p in low for p in CATEGORY_NAMES) and not any(p in low for p in PERSON_NAMES)


def listed_values(spec: Dataset, t: Table) -> dict[str, list[str]]:
    """Of a dimension, the category columns whose values are fewer than its rows: each value is a row."""
    if t.is_fact:
        return {}
    rows, out = t.row_count or DIMENSION_ROWS, {}
    for c in t.columns:
        d = (spec.rule(t.name, c.name) or Rule(t.name, c.name)).distribution or {}
        if c.sql_type == "TEXT" and [c.name] != t.primary_key and is_category_name(c.name) and d.get("kind") == "categorical" and len(d["values"]) < rows:
            out[c.name] = [str(v) for v in d["values"]]
            rows = len(d["values"])
    return out


def _size(spec: Dataset, t: Table) -> int:
    """Rows of a table: as declared, or as many as the shortest list of categories of a dimension has."""
    listed = listed_values(spec, t)
    return min(map(len, listed.values())) if listed else t.row_count or (FACT_ROWS if t.is_fact else DIMENSION_ROWS)


def _base(spark: SparkSession, spec: Dataset, t: Table, made: dict[str, DataFrame], seed: int, skew: float, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    df = spark.range(_size(spec, t)).withColumnRenamed("id", ROW)
    keys = {k.column: k for k in t.foreign_keys}
    for name, key in keys.items():
        if key.ref_table not in made:
            raise ValueError(f"{t.name}.{name}: no table {key.ref_table!r} before it")
        counts = synth.fk_counts(made[key.ref_table], key.ref_column, _size(spec, t), skew)
        rows = counts.select("key", F.explode(F.sequence(F.lit(1).cast("long"), "children")).alias("_copy"))
        # In the order of a hash, so that a parent's rows lie anywhere in the table.
        order = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(name), "key", "_copy"))
        placed, _ = numbered(order, ["_h", "key", "_copy"])
        df = df.join(placed.select(F.col("number").alias(ROW), F.col("key").alias(name)), ROW)
    simple, drawn, listed = {}, {}, listed_values(spec, t)
    for c in t.columns:
        rule = spec.rule(t.name, c.name)
        kind = (rule.distribution or {}).get("kind") if rule else None
        if c.name in keys or kind in ("derived", "window"):
            continue
        if t.primary_key == [c.name] and c.sql_type == "INT" and kind is None:
            simple[c.name] = F.col(ROW) + 1
        elif c.name in listed:  # every value once, in an order by hash
            once = sorted(listed[c.name], key=lambda v: hashlib.md5(f"{seed}/{t.name}.{c.name}/{v}".encode()).hexdigest())  # noqa: B023
            simple[c.name] = F.element_at(F.array(*map(F.lit, once)), (F.col(ROW) + 1).cast("int"))
        elif rule and rule.provider and lookup_source(rule.provider["name"]):
            drawn[c.name] = rule.provider
            continue
        elif rule and rule.provider:
            simple[c.name] = provide(rule.provider, seed, f"{t.name}.{c.name}", F.col(ROW))
        elif kind:
            simple[c.name] = synth.sampler(rule.distribution, seed, f"{t.name}.{c.name}", F.col(ROW))
        else:
            simple[c.name] = synth.fallback(c.sql_type, c.name, seed, F.col(ROW))
        simple[c.name] = _typed(df, simple[c.name], c.sql_type, c.name, seed, t.name)
    df = df.withColumns(simple)
    if not drawn:
        return df
    df = lookup_columns(df, ROW, drawn, (lookups or {}) | made, seed, t.name)
    return df.withColumns({c.name: _typed(df, F.col(c.name), c.sql_type, c.name, seed, t.name) for c in t.columns if c.name in drawn})


def hour_value(hour, name: str, u):
    """What a time becomes in a number column: a duration, distance or surge drawn by the hour, by the column's name; else the hour."""
    rush = F.lit(False)
    for first, last in RUSH_HOURS:
        rush = rush | hour.between(first, last)
    for words, busy, calm in BY_HOUR:
        if any(w in name.lower() for w in words):
            return F.when(rush, busy[0] + (busy[1] - busy[0]) * u).otherwise(calm[0] + (calm[1] - calm[0]) * u)
    return hour.cast("double")


def _typed(df: DataFrame, column, sql_type: str, name: str, seed: int, table: str):
    """Cast to the declared type; where a number is asked for, a time becomes what its name says: an hour or
    a day of the year (INT), or see ``hour_value`` (FLOAT)."""
    target, kind = SQL_TYPES[sql_type], df.select(column).dtypes[0][1]
    if "timestamp" in kind or kind == "date":
        if sql_type == "FLOAT":
            return hour_value(F.hour(column.cast("timestamp_ntz")), name, rng.uniform01(seed, f"{table}.{name}/hour", F.col(ROW))).cast(target)
        if sql_type == "INT":
            return (F.hour(column) if any(w in name.lower() for w in ("hour", "time")) else F.dayofyear(column)).cast(target)
    if sql_type == "INT" and kind == "double":
        return F.floor(column).cast(target)
    return column.cast(target)


def _events(df: DataFrame, spec: Dataset, t: Table, seed: int) -> DataFrame:
    time = next((c.name for c in t.columns if c.sql_type in ("DATETIME", "DATE") and c.name in df.columns), None)
    for event in spec.events:
        if not any(e.get("table") == t.name for e in event.effects):
            continue
        on = active(event.start, event.end, time, F.col(ROW), _size(spec, t))
        for e in event.effects:
            if e.get("table") == t.name and e["column"] in df.columns:
                df = synth.apply_effect(df, e["column"], e["effect"], e["value"], on, e.get("probability", 1.0), seed, ROW)
    return df


def build_table(spark: SparkSession, spec: Dataset, t: Table, made: dict[str, DataFrame], seed: int = 7, wide: bool = False, skew: float = 1.2, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table's DataFrame with its declared columns (``wide``: looked-up columns too)."""
    df = _events(_base(spark, spec, t, made, seed, skew, lookups), spec, t, seed)
    rules = [r for r in spec.rules if r.table == t.name and r.distribution]
    derived = {r.column: r.distribution["expression"] for r in rules if r.distribution["kind"] == "derived"}
    reads = set().union(*map(dependencies, derived.values())) if derived else set()
    dims, wanted = {}, {}
    for k in t.foreign_keys:
        asked = [c for c in made[k.ref_table].columns if c in reads and c not in df.columns]
        if asked:
            dims[k.ref_table], wanted[k.ref_table] = (made[k.ref_table], k.column, k.ref_column), asked
    df = lookup(df, dims, wanted)
    if t.fds or t.implications:
        df = constraints.enforce(df, t.fds, t.implications, [], [ROW])
    df = derive(df, derived, seed, (ROW,))
    windows = {
        r.column: WindowSpec(
            r.distribution["expression"], r.distribution["order_by"], tuple(r.distribution.get("partition_by", ())),
            Frame(**r.distribution.get("frame", {})), (ROW,),
        )
        for r in rules if r.distribution["kind"] == "window"
    }
    df = add_windows(df, windows)
    unique = [c.name for c in t.columns if c.unique and [c.name] != t.primary_key]
    for name in unique:
        df = synth.make_unique(df, name, [ROW])
    required = [c.name for c in t.columns if not c.nullable]
    df = constraints.enforce_not_null(df, required) if required else df
    names = [c.name for c in t.columns]
    return df.select(*names, *[c for c in df.columns if wide and c not in names and c != ROW])


def generate(spark: SparkSession, spec: Dataset, seed: int = 7, wide: bool = False, lookups: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of the spec by name, dimensions first; ``lookups``: tables that providers draw from
    besides those made before."""
    issues = [i for i in check(spec) if i.severe]
    if issues:
        raise ValueError("; ".join(f"{i.code} at {i.location}: {i.message}" for i in issues))
    made: dict[str, DataFrame] = {}
    waiting = sorted(spec.tables.values(), key=lambda t: t.is_fact)
    while waiting:
        ready = [t for t in waiting if all(k.ref_table in made for k in t.foreign_keys)]
        if not ready:
            raise ValueError(f"foreign keys in a cycle: {[t.name for t in waiting]}")
        for t in ready:
            made[t.name] = build_table(spark, spec, t, made, seed, wide, lookups=lookups)
        waiting = [t for t in waiting if t.name not in made]
    return made


SUMMARY = "tab string, status string, rows long, path string, message string"


def write_dataset(
    spark: SparkSession, spec: Dataset, folder: str, seed: int = 7, lookups: dict[str, DataFrame] | None = None, kind: str = "parquet"
) -> DataFrame:
    """Writes every table of the spec to ``folder``/name and returns (tab, status, rows, path, message).

    A table that fails, as it is planned or as its rows are made, leaves the others: it is
    ``failed`` with the reason, those whose foreign keys refer to it are ``skipped``, the rest
    ``written``. Later tables read the written ones, so a dimension is made once. A spec whose
    schema cannot be generated at all is an error, as in ``generate``.
    """
    issues = [i for i in check(spec) if i.severe]
    of = {name: [i for i in issues if i.location.split(".")[0] == name] for name in spec.tables}
    stray = [i for i in issues if i.location.split(".")[0] not in spec.tables]
    if stray or (issues and not any(not of[n] for n in of)):
        raise ValueError("; ".join(f"{i.code} at {i.location}: {i.message}" for i in stray or issues))
    made: dict[str, DataFrame] = {}
    done: dict[str, tuple] = {}
    waiting = sorted(spec.tables.values(), key=lambda t: t.is_fact)
    while waiting:
        ready = [t for t in waiting if all(k.ref_table in done or k.ref_table not in spec.tables for k in t.foreign_keys)]
        if not ready:
            done |= {t.name: (t.name, "failed", None, None, "foreign keys in a cycle") for t in waiting}
            break
        for t in ready:
            lost = sorted({k.ref_table for k in t.foreign_keys if k.ref_table not in made})
            path = f"{folder.rstrip('/')}/{t.name}"
            if of[t.name]:
                done[t.name] = (t.name, "failed", None, None, "; ".join(f"{i.code} at {i.location}: {i.message}" for i in of[t.name]))
            elif lost:
                done[t.name] = (t.name, "skipped", None, None, f"without {', '.join(lost)}")
            else:
                try:
                    build_table(spark, spec, t, made, seed, lookups=lookups).write.format(kind).save(path)
                    made[t.name] = spark.read.format(kind).schema(t.schema()).load(path)
                    done[t.name] = (t.name, "written", made[t.name].count(), path, None)
                except Exception as error:  # noqa: BLE001  any reason is one for the summary
                    made.pop(t.name, None)
                    done[t.name] = (t.name, "failed", None, None, f"{type(error).__name__}: {str(error).splitlines()[0][:500]}")
        waiting = [t for t in waiting if t.name not in done]
    return spark.createDataFrame([done[name] for name in spec.tables], SUMMARY)


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of all values, to compare two runs."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))


def preview(spark: SparkSession, spec: Dataset, name: str, rows: int = 20, seed: int = 7) -> DataFrame:
    """A few rows of one table, for a look at a spec."""
    return generate(spark, spec, seed)[name].limit(rows)


