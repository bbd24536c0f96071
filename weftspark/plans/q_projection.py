"""Queries of derived expressions and rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions.derive import derive
from weftspark.operators.relational import lookup
from weftspark.operators.windows import Frame, WindowSpec, add_windows
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()

FLAGSHIP_SQL = """
with j as (select c.c_custkey, cast(date_trunc('day', o.o_orderdate) as timestamp) as order_day,
                  cast(l.l_extendedprice*(1-l.l_discount) as decimal(18,4)) as net,
                  case when isodow(o.o_orderdate)-1 >= 5 then 1 else 0 end as is_weekend,
                  (epoch_us(l.l_shipdate)-epoch_us(o.o_orderdate))/86400000000.0 as delay_days
           from lineitem l left join orders o on l.l_orderkey=o.o_orderkey
                           left join customer c on o.o_custkey=c.c_custkey),
g as (select c_custkey, order_day, sum(net) as net, cast(max(is_weekend) as bigint) as is_weekend,
             round(avg(delay_days),4) as avg_delay, count(*) as n_lines from j group by c_custkey, order_day)
select c_custkey, order_day, cast(net as double) as net, is_weekend, avg_delay, n_lines,
       cast(sum(net) over w30 as double) as net_30d, count(*) over w30 as days_30d,
       cast(lag(net,1) over (partition by c_custkey order by order_day) as double) as prev_net
from g window w30 as (partition by c_custkey order by order_day
                      range between interval '30' day preceding and current row)
"""


@CATALOG.query(FLAGSHIP_SQL)
def flagship_star_rolling(spark, sf_dir):
    """Star lookup, derived columns, aggregation, 30-day rolling sums and lag per customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")
    star = lookup(lines, {"o": (table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey")}, {"o": ["o_custkey", "o_orderdate"]})
    star = star.withColumn("c_key", F.col("o_custkey"))
    star = lookup(star, {"c": (table(spark, sf_dir, "customer").withColumn("c_id", F.col("c_custkey")), "c_key", "c_custkey")}, {"c": ["c_id"]})
    star = derive(star, {
        "raw_net": "l_extendedprice * (1 - l_discount)",
        "order_day": "date(o_orderdate)",
        "weekend": "where(day_of_week(o_orderdate) >= 5, 1, 0)",
        "delay_days": "ts_diff('days', o_orderdate, l_shipdate)",
    }).withColumn("net", F.col("raw_net").cast("decimal(18,4)"))
    daily = star.groupBy(F.col("c_id").alias("c_custkey"), "order_day").agg(
        F.sum("net").alias("net"), F.max("weekend").cast("long").alias("is_weekend"),
        F.round(F.avg("delay_days"), 4).alias("avg_delay"), F.count("*").alias("n_lines"),
    )
    month = {"frame": Frame("RANGE", "30d"), "sparse": True}  # a row a day, so 31 rows at most
    out = add_windows(daily, {
        "net_30d": WindowSpec("sum(net)", "order_day", ("c_custkey",), **month),
        "days_30d": WindowSpec("count(*)", "order_day", ("c_custkey",), **month),
        "prev_net": WindowSpec("lag(net, 1)", "order_day", ("c_custkey",)),
    })
    return out.withColumns({c: F.col(c).cast("double") for c in ("net", "net_30d", "prev_net")})


D = CATALOG.derived
D("dsl_arith", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"],
  {"plus": "l_quantity + 2", "minus": "l_quantity - l_linenumber", "times": "l_quantity * 3", "ratio": "l_quantity / (l_linenumber - 2)", "negative": "-l_quantity + +1"},
  """select l_orderkey, l_partkey, l_linenumber, l_quantity + 2 as plus, l_quantity - l_linenumber as minus, l_quantity * 3 as times,
     case when l_linenumber - 2 = 0 then null else l_quantity / (l_linenumber - 2) end as ratio, -l_quantity + 1 as negative from lineitem""")  # fmt: skip
D("dsl_floor_mod_pow", "part", ["p_partkey"],
  {"whole": "(p_size - 25) // 7", "rest": "(p_size - 25) % 7", "rest_neg": "(p_size - 25) % -4", "square": "p_size ** 2"},
  """select p_partkey, cast(floor((p_size - 25) / 7.0::double) as bigint) as whole, cast((p_size - 25) - 7 * floor((p_size - 25) / 7.0::double) as bigint) as rest,
     cast((p_size - 25) + 4 * floor((p_size - 25) / (-4.0::double)) as bigint) as rest_neg, cast(pow(p_size, 2) as double) as square from part""")  # fmt: skip
D("dsl_compare_chain", "part", ["p_partkey"],
  {"middle": "10 <= p_size < 30", "both": "p_size > 10 and p_retailprice < 1500", "either": "p_size < 5 or p_size != 7 and not p_size == 9", "eq": "p_size == 15"},
  """select p_partkey, 10 <= p_size and p_size < 30 as middle, p_size > 10 and p_retailprice < 1500 as both,
     p_size < 5 or (p_size <> 7 and not p_size = 9) as either, p_size = 15 as eq from part""")  # fmt: skip
D("dsl_in_notin", "orders", ["o_orderkey"],
  {"urgent": "o_orderpriority in ('1-URGENT', '2-HIGH')", "other": "o_orderstatus not in ['F', 'O']"},
  "select o_orderkey, o_orderpriority in ('1-URGENT','2-HIGH') as urgent, o_orderstatus not in ('F','O') as other from orders")
D("dsl_case_when", "events", ["event_id"],
  {"band": "case_when(value < 10, 'low', value < 100, 'mid', 'high')"},
  "select event_id, case when value < 10 then 'low' when value < 100 then 'mid' else 'high' end as band from events")
D("dsl_where_ifexp", "part", ["p_partkey"],
  {"big": "where(p_size > 25, 1, 0)", "label": "'big' if p_size > 40 else 'small'"},
  "select p_partkey, case when p_size > 25 then 1 else 0 end as big, case when p_size > 40 then 'big' else 'small' end as label from part")
D("dsl_math", "part", ["p_partkey"],
  {"a": "abs(p_size - 25)", "l": "log(p_size)", "e": "exp(p_size / 50)", "r": "sqrt(p_retailprice)"},
  "select p_partkey, abs(p_size - 25) as a, round(ln(p_size), 9) as l, round(exp(p_size / 50.0::double), 9) as e, round(sqrt(p_retailprice), 9) as r from part",
  {"l": 9, "e": 9, "r": 9})
D("dsl_clip_between", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"],
  {"held": "clip(l_quantity, 10, 40)", "top": "clip(l_quantity, 30)", "mid": "between(l_quantity, 10, 20)"},
  """select l_orderkey, l_partkey, l_linenumber, least(greatest(l_quantity, 10), 40) as held, least(l_quantity, 30) as top,
     l_quantity between 10 and 20 as mid from lineitem""")  # fmt: skip
D("dsl_casts", "events", ["event_id"],
  {"i": "int(value)", "f": "float(event_type)", "b": "bool(value)", "s": "str(user_id)", "t": "str(value > 50)"},
  """select event_id, cast(trunc(value) as bigint) as i, try_cast(event_type as double) as f, value <> 0 as b, cast(user_id as varchar) as s,
     case when value > 50 then 'True' else 'False' end as t from events""")  # fmt: skip
D("dsl_interval_add", "orders", ["o_orderkey"],
  {"due": "o_orderdate + days(7)", "soon": "o_orderdate + hours(36)", "early": "o_orderdate - INTERVAL '90 minute'", "later": "o_orderdate + seconds(30)"},
  """select o_orderkey, o_orderdate + interval '7' day as due, o_orderdate + interval '36' hour as soon,
     o_orderdate - interval '90' minute as early, o_orderdate + interval '30' second as later from orders""")  # fmt: skip
D("dsl_datetime_parts", "events", ["event_id"],
  {"h": "hour(ts)", "d": "date(ts)", "w": "day_of_week(ts)", "m": "month(ts)", "y": "year(ts)", "dom": "day_of_month(ts)"},
  """select event_id, cast(hour(ts) as integer) as h, cast(date_trunc('day', ts) as timestamp) as d, cast(isodow(ts) - 1 as integer) as w,
     cast(month(ts) as integer) as m, cast(year(ts) as integer) as y, cast(day(ts) as integer) as dom from events""")  # fmt: skip
D("dsl_ts_diff", "orders", ["o_orderkey"],
  {"in_days": "ts_diff('days', date(o_orderdate), o_orderdate + hours(30))", "in_hours": "ts_diff('hours', o_orderdate, o_orderdate + minutes(90))"},
  """select o_orderkey, (epoch_us(o_orderdate + interval '30' hour) - epoch_us(date_trunc('day', o_orderdate)::timestamp)) / 86400000000.0::double as in_days,
     1.5::double as in_hours from orders""")  # fmt: skip
D("dsl_overlap_days", "orders", ["o_orderkey"],
  {"shared": "overlap_days(o_orderdate, o_orderdate + days(10), o_orderdate + days(4), o_orderdate + days(20))", "none": "overlap_days(o_orderdate, o_orderdate + days(1), o_orderdate + days(2), o_orderdate + days(3))"},
  "select o_orderkey, 6.0::double as shared, 0.0::double as none from orders")
D("dsl_geo_distance", "customer", ["c_custkey"],
  {"km": "geo_distance(c_nationkey, c_custkey % 90, 48.85, 2.35)"},
  """select c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(48.85) - radians(c_nationkey)) / 2), 2)
     + cos(radians(c_nationkey)) * cos(radians(48.85)) * pow(sin((radians(2.35) - radians(c_custkey % 90)) / 2), 2)))), 6) as km from customer""", {"km": 6})  # fmt: skip
D("dsl_concat_format_substring", "part", ["p_partkey"],
  {"c": "concat(p_brand, '-', p_size)", "f": "format('{}/{}', p_brand, p_size)", "g": "format('{1}:{0}', p_brand, p_type)", "s": "substring(p_name, 1, 3)", "tail": "substring(p_name, -3)"},
  """select p_partkey, p_brand || '-' || p_size as c, p_brand || '/' || p_size as f, p_type || ':' || p_brand as g,
     substr(p_name, 2, 3) as s, right(p_name, 3) as tail from part""")  # fmt: skip
D("dsl_topo_chain", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"],
  {"c": "b * 2", "b": "a + 1", "a": "l_quantity - 1"},
  "select l_orderkey, l_partkey, l_linenumber, l_quantity - 1 as a, l_quantity as b, l_quantity * 2 as c from lineitem")


@CATALOG.query("""
with t as (select event_id, nullif(user_id % 5, 0) as k, case when event_id % 7 = 0 then null else value end as v from events)
select event_id, v is null as missing, v is not null as there, k is null as none, case when k is null then true else k in (1, 2) end as listed,
       coalesce(not (k > 2), true) as negated from t
""")
def dsl_null_checks(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(
        "event_id", F.expr("nullif(user_id % 5, 0)").alias("k"), F.expr("case when event_id % 7 = 0 then null else value end").alias("v")
    )
    out = derive(t, {"missing": "isnull(v)", "there": "v is not None", "none": "k is None", "listed": "k in (1, 2, None)", "negated": "not (k > 2)"})
    return out.select("event_id", "missing", "there", "none", "listed", "negated")


WINDOWS = {
    "mean": ("avg", 6), "sum": ("sum", 2), "count": ("count", None), "std": ("stddev_samp", 6),
}


def _rolling(name: str, kind: str) -> None:
    aggregate, digits = WINDOWS[name]
    value = "cast(value as decimal(18,6))" if name == "sum" else "value"
    frame = "range between interval '7' day preceding and current row" if kind == "range" else "rows between 4 preceding and current row"
    call = f"{aggregate}({value}) over (partition by user_id order by ts {frame})"
    shown = f"round(cast({call} as double), {digits})" if digits else call

    def fn(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        if name == "sum":
            events = events.withColumn("value", F.col("value").cast("decimal(18,6)"))
        size = Frame("RANGE", "7 days") if kind == "range" else Frame("ROWS", 5)
        out = add_windows(events, {"rolled": WindowSpec(f"{name}(value)", "ts", ("user_id",), size)})
        rolled = F.round(F.col("rolled").cast("double"), digits) if digits else F.col("rolled")
        return out.select("event_id", rolled.alias("rolled"))

    CATALOG.query(f"select event_id, {shown} as rolled from events", f"win_{kind}_{name}")(fn)


for _name in WINDOWS:
    _rolling(_name, "range")
    _rolling(_name, "rows")


@CATALOG.query("""select event_id, lag(value) over w as before, lag(value, 3) over w as before3, lead(value) over w as after from events
                  window w as (partition by user_id order by ts, event_id)""")
def win_lag_lead(spark, sf_dir):
    key = {"order_by": "ts", "partition_by": ("user_id",), "tiebreak": ("event_id",)}
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    specs = {"before": "lag(value)", "before3": "lag(value, 3)", "after": "lead(value)"}
    return add_windows(events, {n: WindowSpec(e, **key) for n, e in specs.items()}).select("event_id", *specs)


@CATALOG.query("""select event_id, count(*) over (partition by event_type order by ts range between interval '2' hour preceding and interval '1' hour following) as near,
                         sum(event_id) over (partition by event_type order by ts, event_id rows between 2 preceding and 2 following)::bigint as around from events""")
def win_following(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    out = add_windows(events, {  # rows are numbered before the other window takes them twice
        "around": WindowSpec("sum(event_id)", "ts", ("event_type",), Frame("ROWS", 3, 2), ("event_id",), wide=True),
        "near": WindowSpec("count(*)", "ts", ("event_type",), Frame("RANGE", "2h", "1h")),
    })
    return out.select("event_id", "near", "around")


@CATALOG.query("""with d as (select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n from events group by 1)
                  select day, n, cast(sum(n) over (order by day range between interval '30' day preceding and current row) as bigint) as n_30d from d""")
def win_global_range(spark, sf_dir):
    """A window without partitions, over one row per day."""
    daily = derive(table(spark, sf_dir, "events").select("ts"), {"day": "date(ts)"}).groupBy("day").agg(F.count("*").alias("n"))
    return add_windows(daily, {"n_30d": WindowSpec("sum(n)", "day", (), Frame("RANGE", "30d"))})


@CATALOG.query("""with t as (select o_orderkey, o_custkey, cast(date_trunc('month', o_orderdate) as timestamp) as m from orders),
                  w as (select *, count(*) over (partition by o_custkey order by m range between interval '60' day preceding and current row)
                    - (count(*) over (partition by o_custkey, m) - row_number() over (partition by o_custkey, m order by o_orderkey)) as n from t)
                  select o_orderkey, n from w""")
def win_range_physical_peers(spark, sf_dir):
    """RANGE in which later rows of the same time do not count yet."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"))
    spec = WindowSpec("count(*)", "m", ("o_custkey",), Frame("RANGE", "60d"), ("o_orderkey",), "physical")
    return add_windows(orders, {"n": spec}).select("o_orderkey", "n")
