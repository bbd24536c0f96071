"""Queries of joins, predicates, constraints, sources and workload SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import constraints, predicates, relational
from weftspark.operators import synth
from weftspark.plans.registry import Catalog
from weftspark.plans.workload import query_utility, run_workload
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query


def _few_parents(spark, sf_dir):
    """Customers without every seventh one, so that there are orphans."""
    return table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")


def _orders_with_nulls(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("case when o_orderkey % 11 = 0 then null else o_custkey end"))


NULLS = "(select * replace (case when o_orderkey % 11 = 0 then null else o_custkey end as o_custkey) from orders)"
FEW = "(select * from customer where c_custkey % 7 <> 0)"


@query("""select o_orderkey, o_totalprice, c_name, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey
          left join nation on c_nationkey = n_nationkey""")
def join_left_lookup(spark, sf_dir):
    dims = {"customer": (table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"), "nation": (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")}
    wide = relational.lookup(table(spark, sf_dir, "orders"), dims, {"customer": ["c_name", "c_mktsegment", "c_nationkey"], "nation": ["n_name"]})
    return wide.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment", "n_name")


@query(f"select o_orderkey, o_custkey from {NULLS} where o_custkey in (select c_custkey from {FEW})")
def join_semi_fk(spark, sf_dir):
    return relational.covered(_orders_with_nulls(spark, sf_dir), "o_custkey", _few_parents(spark, sf_dir), "c_custkey").select("o_orderkey", "o_custkey")


@query(f"select o_orderkey, o_custkey from {NULLS} o where not exists (select 1 from {FEW} c where c.c_custkey = o.o_custkey)")
def join_anti_orphans(spark, sf_dir):
    return relational.orphans(_orders_with_nulls(spark, sf_dir), "o_custkey", _few_parents(spark, sf_dir), "c_custkey").select("o_orderkey", "o_custkey")


@query(f"""select count(*) as n, count(*) filter (o_custkey in (select c_custkey from {FEW})) as n_covered,
           count(*) filter (o_custkey in (select c_custkey from {FEW})) / count(*)::double as coverage from {NULLS}""")
def join_exists_coverage(spark, sf_dir):
    return relational.fk_coverage(_orders_with_nulls(spark, sf_dir), "o_custkey", _few_parents(spark, sf_dir), "c_custkey")


@query("select degree, count(*) as n_parents from (select c_custkey, count(o_orderkey) as degree from customer left join orders on c_custkey = o_custkey group by 1) group by 1")
def degree_distribution(spark, sf_dir):
    return relational.degree_counts(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("""with d as (select c_custkey, count(o_orderkey) as degree from customer left join orders on c_custkey = o_custkey group by 1),
s as (select count(*) as n, min(degree) as lo, max(degree) as hi, (max(degree) - min(degree))::double as span,
             quantile_cont(degree::double, 0.75) - quantile_cont(degree::double, 0.25) as iqr from d),
w as (select lo, span, greatest(case when iqr > 0 then least(2 * iqr / pow(n::double, 1/3.0::double), span / (log2(n) + 1)) else span / (log2(n) + 1) end, 1.0::double) as width from s),
b as (select lo, span, greatest(ceil(span / width), 1)::integer as bins from w)
select case when span = 0 then 0 else least(floor((degree - lo) * bins / span), bins - 1)::integer end as bin,
       round(lo + (case when span = 0 then 0 else least(floor((degree - lo) * bins / span), bins - 1)::integer end) * span / bins, 6) as low,
       round(lo + (case when span = 0 then 0 else least(floor((degree - lo) * bins / span), bins - 1)::integer end + 1) * span / bins, 6) as high,
       count(*) as n_parents from d, b group by all""")
def degree_histogram(spark, sf_dir):
    out = relational.degree_histogram(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_parents")


@query("""select (select count(*) from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING') as n_joined,
          (select count(*) from orders) as n_base, (select count(*) from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING')::double / (select count(*) from orders) as selectivity""")
def join_selectivity(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return relational.join_selectivity(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), orders)


@query("""select p_partkey, p_brand, p_size from part
          where (p_size >= 10 and p_size < 30 and not p_brand = 'Brand#11') or p_type is null or p_brand in ('Brand#33', 'Brand#44')""")
def pred_tree(spark, sf_dir):
    tree = {"or": [
        {"and": [{"col": "p_size", "op": "ge", "value": 10}, {"col": "p_size", "op": "lt", "value": 30}, {"not": {"col": "p_brand", "op": "eq", "value": "Brand#11"}}]},
        {"col": "p_type", "op": "is_null"}, {"col": "p_brand", "op": "in", "value": ["Brand#33", "Brand#44"]},
    ]}
    return table(spark, sf_dir, "part").where(predicates.condition(tree)).select("p_partkey", "p_brand", "p_size")


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM') and o_orderstatus <> 'F'")
def pred_from_text(spark, sf_dir):
    one = predicates.condition(predicates.read_condition("o_orderpriority in ('1-URGENT', '3-MEDIUM')"))
    two = predicates.condition(predicates.read_condition("o_orderstatus != 'F'"))
    return table(spark, sf_dir, "orders").where(one & two).select("o_orderkey")


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
          select event_id, value from events, q where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)""")
def outliers_iqr(spark, sf_dir):
    return predicates.iqr_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("select event_id from events, (select avg(value) as m, stddev_pop(value) as s from events) where abs(value - m) > 2 * s")
def outliers_zscore(spark, sf_dir):
    return predicates.z_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", 2.0).select("event_id")


def _effect(effect, value, sql_value):
    def fn(spark, sf_dir):
        on = predicates.active("2024-01-10", "2024-01-20", "ts")
        return synth.apply_effect(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", effect, value, on).select("event_id", "value")

    sql = f"""select event_id, case when ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' then {sql_value} else value end as value from events"""
    query(sql, f"event_effect_{effect}")(fn)


_effect("multiply", 1.5, "value * 1.5::double")
_effect("add", 10.0, "value + 10.0::double")
_effect("set", 0.0, "0.0::double")


@query("select event_id, case when event_id >= n * 0.25 and event_id < n * 0.75 then value * 2 else value end as value from events, (select count(*) as n from events)")
def event_effect_share(spark, sf_dir):
    """An effect on the rows from 25% to 75% of the table."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    on = predicates.active("25%", "75%", None, F.col("event_id"), events.count())
    return synth.apply_effect(events, "value", "multiply", 2.0, on)


@query("""select c_custkey, c_nationkey, first_value(c_mktsegment) over w as c_mktsegment, first_value(c_acctbal) over w as c_acctbal
          from customer window w as (partition by c_nationkey order by c_custkey rows between unbounded preceding and unbounded following)""")
def enforce_fd(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return constraints.enforce_fd(df, ["c_nationkey"], ["c_mktsegment", "c_acctbal"], ["c_custkey"])


@query("""select o_orderkey, case when o_orderstatus = 'F' then null else o_orderpriority end as o_orderpriority,
          case when o_totalprice > 200000 then 'P' else o_orderstatus end as o_orderstatus from orders""")
def enforce_implication(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    df = constraints.enforce_implication(df, {"col": "o_orderstatus", "op": "eq", "value": "F"}, "o_orderpriority", "is_null")
    df = constraints.enforce_implication(df, {"col": "o_totalprice", "op": "gt", "value": 200000}, "o_orderstatus", "eq", "P")
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(f"select o_orderkey, coalesce(o_custkey, 0) as o_custkey, coalesce(case when o_orderkey % 3 = 0 then null else o_orderstatus end, '') as o_orderstatus from {NULLS}")
def enforce_not_null(spark, sf_dir):
    df = _orders_with_nulls(spark, sf_dir).withColumn("o_orderstatus", F.expr("case when o_orderkey % 3 = 0 then null else o_orderstatus end"))
    return constraints.enforce_not_null(df, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""with f as (select o_orderkey, o_orderstatus, first_value(o_orderpriority) over (partition by o_orderstatus order by o_orderkey) as o_orderpriority from orders)
          select o_orderkey, o_orderstatus, case when o_orderstatus = 'O' then '' else o_orderpriority end as o_orderpriority from f""")
def enforce_batch(spark, sf_dir):
    """A dependency, then an implication, then NOT NULL."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    implied = {"when": {"col": "o_orderstatus", "op": "eq", "value": "O"}, "column": "o_orderpriority", "effect": "is_null"}
    return constraints.enforce(df, [{"lhs": ["o_orderstatus"], "rhs": ["o_orderpriority"]}], [implied], ["o_orderpriority"], ["o_orderkey"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def check_unique_pk(spark, sf_dir):
    return constraints.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def dedup_keep_first(spark, sf_dir):
    return constraints.dedup_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("select event_type, count(*) as n, round(avg(value), 6) as avg_value from events group by 1")
def workload_group_by(spark, sf_dir):
    return run_workload(spark, sf_dir, "select event_type, count(*) as n, round(avg(value), 6) as avg_value from events group by event_type", ("events",))


@query("select n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def workload_join(spark, sf_dir):
    sql = "select n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"
    return run_workload(spark, sf_dir, sql, ("orders", "customer", "nation"))


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.02")
def workload_filter(spark, sf_dir):
    return run_workload(spark, sf_dir, "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.02", ("lineitem",))


@query("""with a as (select count(*)::double as v from orders where o_totalprice > 100000), b as (select count(*)::double as v from orders where o_totalprice > 100000 and o_orderkey % 2 = 0)
          select 1 - least(1.0::double, abs(b.v - a.v) / a.v) as utility from a, b""")
def workload_query_utility(spark, sf_dir):
    real = {"orders": table(spark, sf_dir, "orders")}
    made = {"orders": real["orders"].where("o_orderkey % 2 = 0")}
    return query_utility(spark, "select count(*) from {orders} where o_totalprice > 100000", real, made)


@query("select o_orderkey, o_custkey from orders union all select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0")
def union_all_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.unionByName(orders.where("o_orderkey % 2 = 0"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
