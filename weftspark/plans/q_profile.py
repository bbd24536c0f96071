"""Queries of profiles and dependencies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from weftspark.operators import dependencies, profile
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
_ONE = """select '{c}' as column, count(*) as n, count(*) filter ({c} is null) as n_null, count(distinct {c}) as n_distinct,
 round(avg({c}), {digits}) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min, max({c})::double as max,
 round((avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / pow(stddev_pop({c}), 3), 3) as skewness,
 round(kurtosis_pop({c}), 3) as kurtosis, bool_and({c}::double % 1 = 0) as is_discrete, bool_and({c} > 0) as is_positive,
 bool_and({c} >= 0 and {c} <= 1) as is_bounded,
 round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as p50, round(quantile_cont({c}::double, 0.75), 6) as p75,
 round(quantile_cont({c}::double, 0.9), 6) as p90, round(quantile_cont({c}::double, 0.95), 6) as p95, round(quantile_cont({c}::double, 0.99), 6) as p99,
 round(count(distinct {c}) / count({c})::double, 6) as uniqueness, count(distinct {c}) / count({c})::double > 0.99 as is_unique,
 0.0::double as null_share from lineitem"""


#: Digits of a mean: of hundredths by a round number of rows the sixth one can be a tie.
_MEAN_DIGITS = {"l_discount": 8}


@query(" union all ".join(_ONE.format(c=c, digits=_MEAN_DIGITS.get(c, 6)) for c in _NUMERIC))
def profile_numeric(spark, sf_dir):
    out = profile.numeric_profile(table(spark, sf_dir, "lineitem"), list(_NUMERIC))
    out = out.withColumns({c: F.round(c, 3) for c in ("skewness", "kurtosis")})
    mean = F.when(F.col("column").isin(*_MEAN_DIGITS), F.round("mean", 8)).otherwise(F.round("mean", 6))
    return out.select(*[mean.alias(c) if c == "mean" else F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


_CATEGORICAL = """with v as (select {c} as v, count(*) as c from {t} group by 1), r as (select *, row_number() over (order by c desc, v) as k from v)
 select '{c}' as column, sum(c)::bigint as n, count(*) as n_distinct, round(max(c) / sum(c)::double, 6) as top1_share,
 round((sum(c) filter (k <= 5)) / sum(c)::double, 6) as top5_share, round(ln(sum(c)::double) - sum(c * ln(c::double)) / sum(c)::double, 6) as entropy from r"""


@query(" union all ".join(f"select * from ({_CATEGORICAL.format(c=c, t='part')})" for c in ("p_brand", "p_type")))
def profile_categorical(spark, sf_dir):
    return _rounded(profile.categorical_profile(table(spark, sf_dir, "part"), ["p_brand", "p_type"]))


@query("select p_type as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def top_k_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_type")


@query("""select m.i::integer as month, ['January','February','March','April','May','June','July','August','September','October','November','December'][m.i] as name,
          count(o_orderkey) as n, round(count(o_orderkey) / sum(count(o_orderkey)) over ()::double, 9) as share
          from range(1, 13) m(i) left join orders on month(o_orderdate) = m.i group by m.i""")
def profile_temporal_months(spark, sf_dir):
    return _rounded(profile.month_shares(table(spark, sf_dir, "orders"), "o_orderdate"), 9)


@query("""with g as (select epoch_us(ts) - lag(epoch_us(ts)) over (order by ts) as gap from events),
          m as (select quantile_cont(gap::double, 0.5) / 86400000000.0::double as g from g where gap is not null)
          select min(ts) as first, max(ts) as last, count(ts) as n, round(any_value(g), 9) as median_gap_days,
          case when any_value(g) < 1/24.0 then 'minute' when any_value(g) < 1 then 'hour' when any_value(g) < 7 then 'day' when any_value(g) < 28 then 'week' when any_value(g) < 365 then 'month' else 'year' end as granularity,
          case when floor(any_value(g)) = 0 then 'day' when any_value(g) < 7 then 'week' when any_value(g) < 30 then 'month' else 'year' end as granularity_compat from events, m""")
def profile_time_range(spark, sf_dir):
    return _rounded(profile.time_profile(table(spark, sf_dir, "events"), "ts", ["ts"]), 9)


@query("select round(regr_slope(o_totalprice, o_orderkey), 6) as slope, round(regr_intercept(o_totalprice, o_orderkey), 3) as intercept, round(regr_r2(o_totalprice, o_orderkey), 9) as r2 from orders")
def profile_trend(spark, sf_dir):
    out = profile.trend(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 9).alias("r2"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, abs(corr({a}, {b})) > 0.7 as is_strong from lineitem" for a, b in _PAIRS))
def corr_matrix(spark, sf_dir):
    return _rounded(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("""with c as (select p_brand as v, count(*) as c from part group by 1)
          select 'p_size' as column, min(p_size)::double as low, max(p_size)::double as high, null::varchar as value, null::double as share from part
          union all select 'p_brand', null, null, v, round(c / sum(c) over ()::double, 9) from c""")
def column_summaries(spark, sf_dir):
    return _rounded(profile.column_summaries(table(spark, sf_dir, "part").select("p_size", "p_brand")), 9)


@query("""select 'event_type' as column, count(*) as n, count(*) filter (event_id % 3 = 0) as n_null from events
          union all select 'value', count(*), 0 from events""")
def null_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.expr("case when event_id % 3 = 0 then null else event_type end").alias("event_type"), "value")
    return profile.null_counts(events)


@query("""select 'k' as column, count(*) as n, 'INT' as sql_type from orders union all select 'p', count(*), 'FLOAT' from orders
          union all select 'd', count(*), 'DATE' from orders union all select 's', count(*), 'TEXT' from orders union all select 'b', count(*), 'BOOL' from orders""")
def infer_sql_types(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 2 == 0).cast("string").alias("b"),
    )
    return profile.infer_types(text)


@query("""with m as (select count(*)::double as n, avg(o_totalprice) as m, stddev_pop(o_totalprice) as s, min(o_totalprice) as lo, max(o_totalprice) as hi,
          avg(ln(o_totalprice)) as lm, stddev_pop(ln(o_totalprice)) as ls from orders)
          select 'normal' as family, round(m, 3) as a, round(s, 3) as b, round(-0.5 * (1.8378770664093453 + 1) - ln(s), 6) as loglik from m
          union all select 'lognormal', round(lm, 3), round(ls, 3), round(-0.5 * (1.8378770664093453 + 1) - ln(ls) - lm, 6) from m
          union all select 'exponential', round(m, 3), null, round(-ln(m) - 1, 6) from m
          union all select 'pareto', round(1 / (lm - ln(lo)), 3), round(lo, 3), round(ln(1 / (lm - ln(lo))) + 1 / (lm - ln(lo)) * ln(lo) - (1 / (lm - ln(lo)) + 1) * lm, 6) from m
          union all select 'uniform', round(lo, 3), round(hi, 3), round(-ln(hi - lo), 6) from m""")
def fit_distributions(spark, sf_dir):
    out = profile.fit_distributions(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select("family", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.round("loglik", 6).alias("loglik"))


_SETS = (("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_returnflag"))


@query(" union all ".join(f"select '{','.join(x)}' as columns, count(*) as n, count(distinct ({', '.join(x)})) as n_distinct, "
                          f"round(count(distinct ({', '.join(x)})) / count(*)::double, 9) as support from lineitem" for x in _SETS))
def itemset_support(spark, sf_dir):
    return _rounded(dependencies.itemset_support(table(spark, sf_dir, "lineitem"), list(_SETS)), 9)


@query("""with g as (select c_nationkey, count(*) as n, count(distinct c_mktsegment) = 1 as one from customer group by 1)
          select 'c_nationkey' as lhs, 'c_mktsegment' as rhs, sum(n)::bigint as n, coalesce(sum(n) filter (one), 0) / sum(n)::double as confidence from g
          union all select 'c_custkey', 'c_mktsegment', count(*), 1.0::double from customer""")
def fd_confidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return dependencies.fd_confidence(c, ["c_nationkey"], "c_mktsegment").union(dependencies.fd_confidence(c, ["c_custkey"], "c_mktsegment"))


_FD_SIDES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
_FD_SETS = [(s, c) for k in (1, 2, 3) for s in combinations(_FD_SIDES, k) for c in _FD_SIDES if c not in s]


def _fd_sql(lhs, rhs):
    columns = ", ".join(lhs)
    return f"""select [{", ".join(f"'{c}'" for c in lhs)}] as l, '{rhs}' as rhs, sum(n)::bigint as n, coalesce(sum(n) filter (one), 0) / sum(n)::double as confidence
               from (select count({rhs}) as n, count(distinct {rhs}) = 1 as one from lineitem group by {columns})"""


@query("with f as (" + " union all ".join(_fd_sql(*x) for x in _FD_SETS) + """), h as (select * from f where confidence >= 0.95)
  select array_to_string(l, ',') as lhs, rhs, n, round(confidence, 9) as confidence from h
  where not exists (select 1 from h t where t.rhs = h.rhs and len(t.l) < len(h.l) and len(list_intersect(t.l, h.l)) = len(t.l))""")
def discover_fds(spark, sf_dir):
    """Minimal dependencies with up to three columns on the left, over stripped partitions."""
    return _rounded(dependencies.discover_fds(table(spark, sf_dir, "lineitem"), list(_FD_SIDES), 3), 9)


@query("""select 'c_custkey' as column, count(*) as n, count(distinct c_custkey) as n_distinct, count(*) = count(distinct c_custkey) as is_unique from customer
          union all select 'c_nationkey', count(*), count(distinct c_nationkey), count(*) = count(distinct c_nationkey) from customer""")
def unique_columns(spark, sf_dir):
    return dependencies.unique_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
