"""Rolling and shifted columns: one window expression per column spec.

``lag`` is the previous row and ``lead`` the next one, as in SQL. A RANGE frame takes all peers
of the current row, as SQL does; ``peers="physical"`` leaves out the peers that come later.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.ordered import with_numbers

UNITS = {"d": 86400, "day": 86400, "h": 3600, "hour": 3600, "m": 60, "min": 60, "minute": 60, "s": 1, "sec": 1, "second": 1}
#: Length of a slab of numbers in frames at least: an eighth of the rows stands in two slabs.
SLAB_SPANS = 8
#: Rows of a slab of numbers at least.
SLAB_ROWS = 100_000
AGGREGATES = {"mean": "avg", "avg": "avg", "sum": "sum", "count": "count", "std": "stddev_samp"}


@dataclass(frozen=True)
class Frame:
    """ROWS: numbers of rows, the current one counted in ``preceding``. RANGE: spans like "7d"."""

    kind: str = "RANGE"
    preceding: str | int = "1d"
    following: str | int = 0


@dataclass(frozen=True)
class WindowSpec:
    expression: str
    order_by: str
    partition_by: tuple[str, ...] = ()
    frame: Frame = Frame()
    tiebreak: tuple[str, ...] = ()
    peers: str = "sql"
    #: Frames of a RANGE window hold few rows each, whatever the data: one plain window does.
    sparse: bool = False
    #: Partitions grow with the table (a handful of kinds, say): ROWS windows, lag and lead run in slabs.
    wide: bool = False


def span_seconds(text: str | int) -> float:
    """Seconds of a span such as "7d", "24 hours" or "5min"."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]+)\s*", str(text))
    unit = found and found[2].lower()
    unit = unit if unit in UNITS else (unit or "").removesuffix("s")
    if not found or unit not in UNITS:
        raise ValueError(f"{text!r} is no span of time")
    return float(found[1]) * UNITS[unit]


def _quoted(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _bound(frame: Frame, side: str) -> str:
    size = getattr(frame, side)
    if frame.kind.upper() == "ROWS":
        n = int(size) - 1 if side == "preceding" else int(size)
        return f"{n} {side}" if n > 0 else "current row"
    if size in (0, "0"):
        return "current row"
    return f"interval '{span_seconds(size):.6f}' second {side}"


def _parsed(spec: WindowSpec) -> tuple[str, str, int | None]:
    """(function, column, shift) of a spec's expression; a column alone is its mean."""
    text = spec.expression.strip()
    found = re.fullmatch(r"(?:rolling_)?(\w+)\s*\(\s*([\w*]+)\s*(?:,\s*(\d+)\s*)?\)", text)
    if found and found[1] in ("lag", "lead"):
        return found[1], found[2], int(found[3] or 1)
    name, column = (found[1], found[2]) if found else ("mean", text)
    if name not in AGGREGATES or (not found and not re.fullmatch(r"\w+", text)):
        raise ValueError(f"{text!r}: a window takes {', '.join(AGGREGATES)}, lag or lead of a column")
    return name, column, None


def window_column(spec: WindowSpec) -> Column:
    """The Column of a spec such as mean(x), sum(x), count(*), std(x), lag(x, 2), lead(x) or x.

    A frame's rows are summed anew for every row; ``add_windows`` takes this for ROWS frames, lag
    and lead, and for RANGE frames that are said to be ``sparse``.
    """
    name, column, shift = _parsed(spec)
    by = f"partition by {_quoted(spec.partition_by)}" if spec.partition_by else ""
    order = f"order by {_quoted((spec.order_by, *spec.tiebreak))}"
    if shift is not None:
        return F.expr(f"{name}(`{column}`, {shift}) over ({by} {order})")
    call = f"{AGGREGATES[name]}({'*' if column == '*' else f'`{column}`'})"
    rows = spec.frame.kind.upper() == "ROWS"
    order = order if rows else f"order by `{spec.order_by}`"
    frame = f"{'rows' if rows else 'range'} between {_bound(spec.frame, 'preceding')} and {_bound(spec.frame, 'following')}"
    return F.expr(f"{call} over ({by} {order} {frame})")


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time: those of the instant, or, without a zone, those of the clock it shows."""
    t = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(t)
    t = t.cast("timestamp_ntz")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.expr(f"extract(second from cast(`{name}` as timestamp_ntz))") * 1_000_000).cast("long")


def _in_blocks(df: DataFrame, specs: dict[str, WindowSpec]) -> DataFrame:
    """RANGE windows of one partitioning, order and frame, in time that grows with the rows and not with frames.

    Time is cut into blocks as long as the frame, so a frame is the end of one block and the
    beginning of the next. A row stands in its own block and in the one before, and in either group
    two frames that only grow, one from the block's end backwards and one from the next block's
    beginning, give the two parts, which are merged: no frame is summed anew, and nothing is
    subtracted. A group is two blocks of one partition. Rows without a time are peers of each other alone.
    """
    spec = next(iter(specs.values()))
    before, behind = (0 if size in (0, "0") else round(span_seconds(size) * 1_000_000) for size in (spec.frame.preceding, spec.frame.following))
    width = max(before + behind, 1)
    block = lambda at: F.call_function("div", at - F.pmod(at, F.lit(width).cast("long")), F.lit(width).cast("long"))
    dealt = df.withColumn("_t", _micros(df, spec.order_by))
    dealt = dealt.withColumns({"_home": block(F.col("_t")), "_asks": block(F.col("_t") - before)})
    own = F.array(F.col("_home") - 1, F.col("_home"))
    dealt = dealt.withColumn("_block", F.explode(F.when(F.col("_home").isNull(), F.array(F.lit(None).cast("long"))).otherwise(own)))
    group = ", ".join(f"`{c}`" for c in (*spec.partition_by, "_block"))
    upto = lambda reach: f"{reach} following" if reach else "current row"
    sides = (
        ("_home <=> _block", f"(partition by {group} order by _t desc range between unbounded preceding and {upto(before)})"),
        ("_home = _block + 1", f"(partition by {group} order by _t range between unbounded preceding and {upto(behind)})"),
    )
    parsed = {name: _parsed(s)[:2] for name, s in specs.items()}
    states: dict[str, str] = {}
    for i, (inside, frame) in enumerate(sides):
        for name, column in parsed.values():
            value = f"case when {inside} then {'1' if column == '*' else f'`{column}`'} end"
            states[f"_n{i}_{column}"] = f"count({value}) over {frame}"
            if name in ("mean", "avg", "sum"):
                # As avg does: integers are summed as doubles for a mean.
                whole = name != "sum" and not isinstance(df.schema[column].dataType, T.DecimalType)
                states[f"_{'d' if whole else 's'}{i}_{column}"] = f"sum({f'cast({value} as double)' if whole else value}) over {frame}"
            if name == "std":
                states[f"_m{i}_{column}"] = f"avg(cast({value} as double)) over {frame}"
                states[f"_v{i}_{column}"] = f"var_pop({value}) over {frame}"
    made = dealt.withColumns({k: F.expr(v) for k, v in states.items()}).where(F.col("_asks").eqNullSafe(F.col("_block")))
    out = {name: _merged(made, kind, column).cast(df.limit(0).select(window_column(specs[name])).schema[0].dataType) for name, (kind, column) in parsed.items()}
    return made.withColumns(out).select(*df.columns, *[c for c in out if c not in df.columns])


def _merged(made: DataFrame, name: str, column: str) -> Column:
    """A function's value from the states of both parts of the frame."""
    n0, n1 = (F.col(f"_n{i}_{column}") for i in (0, 1))
    if name == "count":
        return n0 + n1
    if name == "std":
        (m0, v0), (m1, v1) = ((F.coalesce(F.col(f"_m{i}_{column}"), F.lit(0.0)), F.coalesce(F.col(f"_v{i}_{column}"), F.lit(0.0))) for i in (0, 1))
        apart = F.when((n0 > 0) & (n1 > 0), (m1 - m0) * (m1 - m0) * n0 * n1 / (n0 + n1)).otherwise(F.lit(0.0))
        return F.when(n0 + n1 > 1, F.sqrt((v0 * n0 + v1 * n1 + apart) / (n0 + n1 - 1)))
    kind = "d" if f"_d0_{column}" in made.columns and name != "sum" else "s"
    s0, s1 = (F.col(f"_{kind}{i}_{column}") for i in (0, 1))
    total = F.coalesce(s0 + s1, s0, s1)
    return total if name == "sum" else F.try_divide(total, n0 + n1)


def _physical(df: DataFrame, name: str, spec: WindowSpec) -> DataFrame:
    """A RANGE window without the peers that come behind the row in physical order: these are taken off again."""
    kind, column, _ = _parsed(spec)
    if kind not in ("sum", "count", "mean", "avg"):
        raise ValueError("physical peers: sum, count and mean only")
    whats = {"count": ["count"], "sum": ["sum"]}.get(kind, ["sum", "count"])
    parts = {f"_{w}_{name}": replace(spec, expression=f"{w}({column})", peers="sql") for w in whats}
    df = _range_windows(df, parts)
    same = f"partition by {_quoted((*spec.partition_by, spec.order_by))}"
    upto = f"{same} order by {_quoted(spec.tiebreak or (spec.order_by,))} rows between unbounded preceding and current row"
    one = "1" if column == "*" else f"`{column}`"
    held = lambda w: f"(coalesce(`_{w}_{name}`, 0) - (coalesce({w}({one}) over ({same}), 0) - coalesce({w}({one}) over ({upto}), 0)))"
    made = held(kind) if kind in ("count", "sum") else f"try_divide({held('sum')}, {held('count')})"
    return df.withColumn(name, F.expr(made)).drop(*parts)


def _range_windows(df: DataFrame, specs: dict[str, WindowSpec]) -> DataFrame:
    """RANGE windows of one partitioning, order and frame."""
    if next(iter(specs.values())).sparse:
        return df.withColumns({name: window_column(s) for name, s in specs.items()})
    return _in_blocks(df, specs)


def _reach(spec: WindowSpec) -> tuple[int, int]:
    """How many rows before and behind a row its ROWS frame, lag or lead looks at."""
    shifted = re.match(r"\s*(lag|lead)\s*\([^,]*(?:,\s*(\d+))?", spec.expression)
    if shifted:
        n = int(shifted[2] or 1)
        return (n, 0) if shifted[1] == "lag" else (0, n)
    return max(int(spec.frame.preceding) - 1, 0), int(spec.frame.following)


def _in_numbered_slabs(df: DataFrame, name: str, spec: WindowSpec) -> DataFrame:
    """A ROWS window, lag or lead, over rows whose place in the order is ``_number``.

    The order begins with the partitioning, if there is one, so partitions are runs of numbers. Slabs have a fixed number of rows. A slab's last rows are carried into the next one, and its
    first ones into the one before, as far as frames reach, so every row finds its frame in its slab.
    """
    before, behind = _reach(spec)
    size = max(SLAB_SPANS * (before + behind), SLAB_ROWS)
    slab = lambda at: F.floor(at / F.lit(size))
    n = F.col("_number")
    dealt = df.withColumns({"_home": slab(n), "_slab": F.explode(F.sequence(slab(n - behind), slab(n + before)))})
    made = dealt.withColumn(name, window_column(replace(spec, partition_by=(*spec.partition_by, "_slab"), order_by="_number", tiebreak=())))
    return made.where(F.col("_home") == F.col("_slab")).drop("_home", "_slab")


def add_windows(df: DataFrame, specs: dict[str, WindowSpec]) -> DataFrame:
    """Window columns in the given order; later ones may read earlier ones.

    RANGE windows run in blocks of time, those of one partitioning, order and frame that follow each
    other together. ROWS windows, lag and lead of one partitioning and order share an exchange and
    a sort; without a partitioning, or with ``wide`` partitions, rows are numbered, once for specs of
    one partitioning and order that follow each other, and windows run in slabs of numbers. Rows that are equal in the order and its tie-break
    have no order among each other, as in SQL.
    """
    numbers: tuple[str, ...] | None = None
    names = list(specs)
    while names:
        name = names.pop(0)
        spec = specs[name]
        _, column, shift = _parsed(spec)
        if shift is None and spec.frame.kind.upper() != "ROWS":
            if spec.peers == "physical":
                df = _physical(df, name, spec)
                continue
            alike = lambda s: (s.partition_by, s.order_by, s.frame, s.peers, s.sparse)
            together = {name: spec}
            while names and alike(specs[names[0]]) == alike(spec) and _parsed(specs[names[0]])[2] is None and _parsed(specs[names[0]])[1] not in together:
                together[names[0]] = specs[names[0]]
                names.pop(0)
            df = _range_windows(df, together)
        elif spec.partition_by and not spec.wide:
            df = df.withColumn(name, window_column(spec))
        else:
            order = (*spec.partition_by, spec.order_by, *spec.tiebreak)
            if numbers != order:
                df, numbers = with_numbers(df.drop("_number"), list(order), "_number"), order
            df = _in_numbered_slabs(df, name, spec)
    return df.drop("_number")
