"""Derived columns from expression strings.

An expression is read with Python's own ``ast`` and becomes a Catalyst ``Column``; nothing is
interpreted per row. ``derive`` adds columns level by level in the order of their
dependencies, one ``withColumns`` a level.

Where SQL and the expression language differ, this is the rule: division by zero is NULL,
comparisons follow three-valued logic, a NULL condition takes the else branch, ``//`` and ``%``
floor, ``substring`` counts from 0, ``concat`` and ``format`` write NULL as the text "None".
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.functions import rng

EARTH_KM = 6371.0
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


class ExpressionError(ValueError):
    """An expression that can't be compiled; the message says where and why."""


class Missing(ExpressionError, KeyError):
    """A name that is no column."""

    def __str__(self) -> str:
        return str(self.args[0])


# The functions of the expression language.
FUNCTIONS = (
    "where case_when abs log exp sqrt clip between isnull notnull int float bool str seconds minutes hours days "
    "hour date day_of_week day_of_month month year ts_diff overlap_days geo_distance concat format substring "
    "uniform normal lognormal pareto weighted_choice weighted_choice_if"
).split()


def parse(text: str) -> ast.expr:
    """The expression's tree; SQL interval literals become calls."""
    plain = re.sub(
        r"INTERVAL\s+'?\s*(\d+)\s*'?\s*(second|minute|hour|day)s?'?", lambda m: f"{m[2].lower()}s({m[1]})", text, flags=re.I
    )
    try:
        return ast.parse(plain.strip(), mode="eval").body
    except SyntaxError as error:
        raise ExpressionError(f"can't read {text!r}: {error.msg}") from None


def dependencies(text: str) -> set[str]:
    """Names that the expression reads; a name that is only called is a function."""
    tree = parse(text)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def levels(expressions: dict[str, str]) -> list[list[str]]:
    """Names in levels: each reads only columns outside and names of levels before."""
    reads = {name: dependencies(text) & set(expressions) - {name} for name, text in expressions.items()}
    out, done = [], set()
    while len(done) < len(reads):
        ready = sorted(n for n in reads if n not in done and reads[n] <= done)
        if not ready:
            stuck = {n: sorted(reads[n] - done) for n in reads if n not in done}
            raise ExpressionError(f"derived columns depend on each other in a cycle: {stuck}")
        out.append(ready)
        done |= set(ready)
    return out


def _haversine(a1: Column, o1: Column, a2: Column, o2: Column) -> Column:
    p1, p2 = F.radians(a1), F.radians(a2)
    x = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(o2) - F.radians(o1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(x, F.lit(1.0))))


class Compiler:
    """Compiles expressions against one frame; ``key`` columns and ``seed`` feed random functions."""

    def __init__(self, df: DataFrame, seed: int = 7, key: tuple[str, ...] = (), stream: str = "") -> None:
        self.df, self.seed, self.key, self.stream, self.draws = df, seed, key, stream, 0
        self.columns = set(df.columns)

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column).schema[0].dataType

    def is_time(self, column: Column) -> bool:
        return isinstance(self.type_of(column), (T.TimestampType, T.TimestampNTZType, T.DateType))

    def __call__(self, text: str) -> Column:
        return self.node(parse(text))

    # -- nodes ---------------------------------------------------------------------------
    def node(self, n: ast.expr) -> Column:
        handler: Callable | None = getattr(self, f"on_{type(n).__name__}", None)
        if handler is None:
            raise ExpressionError(f"{type(n).__name__} is not part of the language: {ast.unparse(n)}")
        return handler(n)

    def on_Name(self, n: ast.Name) -> Column:
        if n.id not in self.columns:
            raise Missing(f"no column {n.id!r}; there are {sorted(self.columns)}")
        return F.col(f"`{n.id}`")

    def on_Constant(self, n: ast.Constant) -> Column:
        return F.lit(n.value)

    def on_UnaryOp(self, n: ast.UnaryOp) -> Column:
        x = self.node(n.operand)
        if isinstance(n.op, ast.Not):
            return ~F.coalesce(self.truth(x), F.lit(False))
        if isinstance(n.op, ast.USub):
            return -x
        return x

    def on_BinOp(self, n: ast.BinOp) -> Column:
        a, b = self.node(n.left), self.node(n.right)
        match n.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a.cast("double") if self.numeric(a) else a, b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a.cast("double"), b))
            case ast.Mod():
                return F.when(b != 0, a - b * F.floor(a.cast("double") / F.when(b != 0, b)))
            case ast.Pow():
                return F.pow(a, b)
        raise ExpressionError(f"operator {type(n.op).__name__} is not part of the language")

    def numeric(self, x: Column) -> bool:
        return isinstance(self.type_of(x), T.NumericType)

    def on_BoolOp(self, n: ast.BoolOp) -> Column:
        parts = [self.truth(self.node(v)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return out

    def on_Compare(self, n: ast.Compare) -> Column:
        out, left = None, n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            one = self.compare(left, op, right)
            out, left = one if out is None else out & one, right
        return out

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        a = self.node(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.Tuple, ast.List)):
                raise ExpressionError("'in' needs a list of literals")
            values = [self.literal(v) for v in right.elts]
            found = F.coalesce(a.isin([v for v in values if v is not None]), F.lit(False))
            found = found | a.isNull() if None in values else found
            return found if isinstance(op, ast.In) else ~found
        none = isinstance(right, ast.Constant) and right.value is None
        if isinstance(op, (ast.Is, ast.IsNot)) and none:
            return a.isNull() if isinstance(op, ast.Is) else a.isNotNull()
        b = self.node(right)
        match op:
            case ast.Lt():
                return a < b
            case ast.LtE():
                return a <= b
            case ast.Gt():
                return a > b
            case ast.GtE():
                return a >= b
            case ast.Eq() | ast.Is():
                return a == b
            case ast.NotEq() | ast.IsNot():
                return a != b
        raise ExpressionError(f"comparison {type(op).__name__} is not part of the language")

    def on_IfExp(self, n: ast.IfExp) -> Column:
        return F.when(self.truth(self.node(n.test)), self.node(n.body)).otherwise(self.node(n.orelse))

    def literal(self, n: ast.expr):
        try:
            return ast.literal_eval(n)
        except ValueError:
            raise ExpressionError(f"a literal is needed, not {ast.unparse(n)}") from None

    def on_Call(self, n: ast.Call) -> Column:
        if not isinstance(n.func, ast.Name):
            raise ExpressionError(f"methods are not part of the language: {ast.unparse(n)}")
        if n.keywords:
            raise ExpressionError(f"{n.func.id}: keyword arguments are not part of the language")
        if n.func.id not in FUNCTIONS:
            raise ExpressionError(f"no function {n.func.id!r}; there are {', '.join(FUNCTIONS)}")
        made = getattr(self, f"fn_{n.func.id}")
        return made(*n.args) if getattr(made, "raw", False) else made(*map(self.node, n.args))

    # -- functions -----------------------------------------------------------------------
    def truth(self, x: Column) -> Column:
        kind = self.type_of(x)
        if isinstance(kind, T.BooleanType):
            return x
        return x != 0 if isinstance(kind, T.NumericType) else F.length(x.cast("string")) > 0

    def fn_where(self, c, a, b):
        return F.when(self.truth(c), a).otherwise(b)

    def fn_case_when(self, *args):
        if len(args) < 3 or len(args) % 2 == 0:
            raise ExpressionError("case_when takes pairs of condition and value, and a default")
        out = F
        for c, v in zip(args[:-1:2], args[1:-1:2], strict=True):
            out = out.when(self.truth(c), v)
        return out.otherwise(args[-1])

    def fn_abs(self, x):
        return F.abs(x)

    def fn_log(self, x):
        return F.log(x)

    def fn_exp(self, x):
        return F.exp(x)

    def fn_sqrt(self, x):
        return F.sqrt(x)

    def fn_clip(self, x, low, high=None):
        out = F.least(x, low) if high is None else F.least(F.greatest(x, low), high)
        return F.when(x.isNotNull(), out)

    def fn_between(self, x, low, high):
        return x.between(low, high)

    def fn_isnull(self, x):
        nan = isinstance(self.type_of(x), (T.DoubleType, T.FloatType))
        return x.isNull() | F.isnan(x) if nan else x.isNull()

    def fn_notnull(self, x):
        return ~self.fn_isnull(x)

    def fn_int(self, x):
        d = F.expr("0d") + x.cast("double") if self.numeric(x) else x.cast("string").try_cast("double")
        return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("long")

    def fn_float(self, x):
        return x.cast("double") if self.numeric(x) else x.cast("string").try_cast("double")

    def fn_bool(self, x):
        return self.truth(x)

    def fn_str(self, x):
        if isinstance(self.type_of(x), T.BooleanType):
            return F.when(x, "True").when(~x, "False").otherwise("None")
        return F.coalesce(x.cast("string"), F.lit("None"))

    def interval(self, x, seconds):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (x * seconds).cast("decimal(18,6)"))

    def fn_seconds(self, x):
        return self.interval(x, 1)

    def fn_minutes(self, x):
        return self.interval(x, 60)

    def fn_hours(self, x):
        return self.interval(x, 3600)

    def fn_days(self, x):
        return self.interval(x, 86400)

    def fn_hour(self, t):
        return F.hour(t)

    def fn_date(self, t):
        return F.date_trunc("day", t).cast("timestamp_ntz")

    def fn_day_of_week(self, t):
        return F.weekday(t)

    def fn_day_of_month(self, t):
        return F.dayofmonth(t)

    def fn_month(self, t):
        return F.month(t)

    def fn_year(self, t):
        return F.year(t)

    def micros(self, t):
        return F.unix_micros(t.cast("timestamp"))

    def fn_ts_diff(self, unit, a, b):
        name = unit.value.rstrip("s") if isinstance(unit, ast.Constant) else "day"
        return (self.micros(self.node(b)) - self.micros(self.node(a))) / float(SECONDS.get(name, 86400) * 1_000_000)

    fn_ts_diff.raw = True

    def fn_overlap_days(self, s1, e1, s2, e2):
        end, start = F.when(e1 < e2, e1).otherwise(e2), F.when(s1 > s2, s1).otherwise(s2)
        span = (self.micros(end) - self.micros(start)) / 86_400_000_000.0
        return F.when(span > 0, span).when(span.isNotNull(), 0.0)

    def fn_geo_distance(self, a1, o1, a2, o2):
        return _haversine(a1, o1, a2, o2)

    def fn_concat(self, *args):
        return F.concat(*map(self.fn_str, args))

    def fn_format(self, template, *args):
        texts = [self.fn_str(self.node(a)) for a in args]
        if not isinstance(template, ast.Constant):  # a template per row: its marks are replaced in turn
            out = self.node(template)
            for i, text in enumerate(texts):
                out = F.replace(out, F.lit(f"{{{i}}}"), text)
                out = F.when(F.instr(out, "{}") > 0, F.concat(F.substring_index(out, "{}", 1), text, F.expr("''"), self.after(out))).otherwise(out)
            return out
        parts, turn = [], 0
        for piece in re.split(r"(\{\d*\})", template.value):
            mark = re.fullmatch(r"\{(\d*)\}", piece)
            if mark:
                at = int(mark[1]) if mark[1] else turn
                turn += not mark[1]
                if at >= len(texts):
                    raise ExpressionError(f"format: no argument {at} for {template.value!r}")
                parts.append(texts[at])
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts) if parts else F.lit("")

    fn_format.raw = True

    @staticmethod
    def after(text: Column) -> Column:
        return F.substring(text, F.instr(text, "{}") + 2, F.length(text))

    def fn_substring(self, s, start, length=None):
        n = F.length(s)
        at = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
        return F.substring(s, at + 1, n if length is None else F.greatest(length, F.lit(0)))

    # -- random functions ----------------------------------------------------------------
    def draw(self, kind=rng.uniform01) -> Column:
        if not self.key:
            raise ExpressionError("random functions need key columns")
        self.draws += 1
        return kind(self.seed, f"{self.stream}/{self.draws}", *map(F.col, self.key))

    def fn_uniform(self, low, high):
        return low + (high - low) * self.draw()

    def fn_normal(self, mean, deviation):
        return mean + deviation * self.draw(rng.normal01)

    def fn_lognormal(self, mean, sigma):
        return F.exp(mean + sigma * self.draw(rng.normal01))

    def fn_pareto(self, alpha):  # of Lomax: support from 0
        return F.pow(1 - self.draw(), -1 / alpha) - 1

    def choice(self, flat: list) -> Column:
        if len(flat) < 2 or len(flat) % 2:
            raise ExpressionError("weighted_choice takes pairs of value and weight")
        return rng.pick(self.draw(), flat[::2], flat[1::2])

    def fn_weighted_choice(self, *args):
        return self.choice([self.literal(a) for a in args])

    fn_weighted_choice.raw = True

    def fn_weighted_choice_if(self, condition, yes, no):
        return F.when(self.truth(self.node(condition)), self.choice(list(self.literal(yes)))).otherwise(self.choice(list(self.literal(no))))

    fn_weighted_choice_if.raw = True


def derive(df: DataFrame, expressions: dict[str, str], seed: int = 7, key: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the derived columns, in order of their dependencies."""
    for level in levels(expressions):
        made = {name: Compiler(df, seed, key, name)(expressions[name]) for name in level}
        df = df.withColumns(made)
    return df
