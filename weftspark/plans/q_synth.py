"""Queries of synthesis: keys, allocation, and invariants of seeded samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import rng
from weftspark.operators import lookups, synth
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query
N = 20_000


_SHUFFLED = (1_000_000, 9_999_999)


def _u(stream, key="o_orderkey", seed=7):
    """SQL of rng.digest01."""
    return f"(cast('0x' || md5('{seed}/{stream}/' || {key})[1:13] as ubigint)::double / 4503599627370496)"


def _z(stream):
    """SQL of rng.normal01 with such draws."""
    return f"(sqrt(-2.0 * ln(1.0 - {_u(stream + '/r')})) * cos(2.0 * pi() * {_u(stream + '/a')}))"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey")


def _drawn(spec, stream):
    """A sampler over orders' keys, with draws that SQL can state."""
    return synth.sampler(spec, 7, stream, F.col("o_orderkey"), rng.digest01)


@query("select row_number() over () as id from orders")
def gen_pk_range(spark, sf_dir):
    """As many keys as there are orders."""
    return synth.key_range(spark, _orders(spark, sf_dir).count())


@query(f"""select {_SHUFFLED[0]} + (i * {synth.walk_step(_SHUFFLED[1] - _SHUFFLED[0] + 1, 7)} + 7) % {_SHUFFLED[1] - _SHUFFLED[0] + 1} as id
           from (select row_number() over () - 1 as i from customer)""")
def gen_pk_shuffled(spark, sf_dir):
    """As many different keys of a range as there are customers."""
    return synth.shuffled_keys(spark, table(spark, sf_dir, "customer").count(), *_SHUFFLED)


FK_SQL = """
with k as (select c_custkey as key, row_number() over (order by c_custkey) - 1 as number from customer),
w as (select *, round(pow((number + 1)::double, -1.2), 12) as w from k),
x as (select *, w / sum(w::decimal(28,12)) over ()::double * (20000 - count(*) over ()) as x from w),
f as (select key, floor(x)::bigint as whole, round(x - floor(x), 9) as rest, (20000 - count(*) over () - sum(floor(x)::bigint) over ())::bigint as lft from x),
r as (select *, row_number() over (order by rest desc, key) - 1 as k from f)
select key, 1 + whole + (k < lft)::bigint as children from r
"""


@query(FK_SQL)
def gen_fk_coverage(spark, sf_dir):
    """Children per key by largest remainder: every key at least once, Zipf beyond; more than N keys lack rows by the same shares."""
    return synth.fk_counts(table(spark, sf_dir, "customer"), "c_custkey", N, lacking=True)


@query(f"select children as degree, count(*) as n_keys from ({FK_SQL}) group by 1")
def gen_zipf_counts(spark, sf_dir):
    """The rows of the allocation, counted back per key; a key without rows counts with what it lacks."""
    rows = synth.expand_counts(synth.fk_counts(table(spark, sf_dir, "customer"), "c_custkey", N, lacking=True))
    degrees = rows.groupBy("key").agg(F.coalesce(F.min("lack"), F.count("*")).alias("degree"))
    return degrees.groupBy("degree").agg(F.count("*").alias("n_keys"))


SPECS = {
    "uniform": {"kind": "uniform", "low": 2.0, "high": 4.0},
    "normal": {"kind": "normal", "mean": 10.0, "std": 2.0},
    "lognormal": {"kind": "lognormal", "mean": 0.0, "sigma": 0.5},
    "pareto": {"kind": "pareto", "alpha": 3.0, "xm": 1.0},
    "exponential": {"kind": "exponential", "scale": 5.0},
    "poisson": {"kind": "poisson", "lam": 4.0},
    "zipf": {"kind": "zipf", "n": 50, "s": 1.1},
}
_ZIPF = [sum(synth.zipf_shares(50, 1.1)[: i + 1]) for i in range(49)]
#: SQL of what each sampler draws.
VALUES = {
    "uniform": f"2.0 + 2.0 * {_u('uniform')}",
    "normal": f"10.0 + 2.0 * {_z('normal')}",
    "lognormal": f"exp(0.5 * {_z('lognormal')})",
    "pareto": f"pow(1 - {_u('pareto')}, -1 / 3.0::double)",
    "exponential": f"-5.0 * ln(1 - {_u('exponential')})",
    "poisson": f"len(list_filter({synth.poisson_marks(4.0)}, lambda x: x <= {_u('poisson')}))",
    "zipf": f"len(list_filter({_ZIPF}, lambda x: x <= {_u('zipf')})) + 1",
}


@query("select o_orderkey, " + ", ".join(f"round(({v})::double, 6) as {k}" for k, v in VALUES.items()) + " from orders")
def gen_sampler_values(spark, sf_dir):
    """What each sampler draws for every order."""
    drawn = [F.round(_drawn(s, k).cast("double"), 6).alias(k) for k, s in SPECS.items()]
    return _orders(spark, sf_dir).select("o_orderkey", *drawn)


@query(" union all ".join(f"select '{k}' as kind, count(*) as n, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std from orders" for k, v in VALUES.items()))
def gen_sampler_means(spark, sf_dir):
    """Mean and deviation of what each sampler draws over the orders' keys."""
    df = _orders(spark, sf_dir).select(*[_drawn(s, k).cast("double").alias(k) for k, s in SPECS.items()])
    row = df.agg(F.count("*").alias("n"), *[f(k).alias(f"{k}_{n}") for k in SPECS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    stacked = ", ".join(f"'{k}', round({k}_mean, 6), round({k}_std, 6)" for k in SPECS)
    return row.selectExpr("n", f"stack({len(SPECS)}, {stacked}) as (kind, mean, std)").select("kind", "n", "mean", "std")


@query(f"select case when u < 0.5 then 'a' when u < 0.8 then 'b' else 'c' end as value, count(*) as n from (select {_u('c')} as u from orders) group by 1")
def gen_categorical(spark, sf_dir):
    spec = {"kind": "categorical", "values": ["a", "b", "c"], "probs": [0.5, 0.3, 0.2]}
    return _orders(spark, sf_dir).groupBy(_drawn(spec, "c").alias("value")).agg(F.count("*").alias("n"))


_SEASON = f"""select o_orderkey, make_date((2020 + floor({_u('s/year')} * 4))::bigint, (case when {_u('s/part')} < 0.7 then 3 else 7 end)::bigint, 1::bigint) + floor({_u('s/day')} * 31)::integer as day from orders"""


@query(f"select o_orderkey, day::timestamp as t from ({_SEASON})")
def gen_seasonal(spark, sf_dir):
    """A time in March or July, of weights 0.7 and 0.3, for every order."""
    spec = {"kind": "seasonal", "by": "month", "weights": {"March": 0.7, "July": 0.3}}
    return _orders(spark, sf_dir).select("o_orderkey", _drawn(spec, "s").alias("t"))


@query(f"""select x < 3 as low, count(*) as n, round(sum(x), 4) as total from (
           select case when {_u('m')} < 0.25 then {_u('m/0')} else 5.0 + {_u('m/1')} end as x from orders) group by 1""")
def gen_mixture(spark, sf_dir):
    spec = {"kind": "mixture", "components": [
        {"weight": 0.25, "dist": {"kind": "uniform", "low": 0.0, "high": 1.0}}, {"weight": 0.75, "dist": {"kind": "uniform", "low": 5.0, "high": 6.0}},
    ]}
    x = _orders(spark, sf_dir).select(_drawn(spec, "m").alias("x"))
    return x.groupBy((F.col("x") < 3).alias("low")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query(f"select parts, (select count(*) from orders) as n, (select round(sum(u), 4) from (select {_u('p')} as u from orders)) as total from (select unnest([1, 3, 7]) as parts)")
def gen_partition_invariant(spark, sf_dir):
    """The same draws whatever the number of partitions."""
    keys, key = _orders(spark, sf_dir), F.col("o_orderkey")
    total = lambda n: keys.repartition(n).agg(F.lit(n).alias("parts"), F.count("*").alias("n"), F.round(F.sum(rng.digest01(7, "p", key)), 4).alias("total"))
    return total(1).union(total(3)).union(total(7))


@query("select 'orders_x' as name, count(*) as n, 0::bigint as n_orphans, true as filled from customer union all select 'shops', count(*), 0, true from nation")
def gen_dataset(spark, sf_dir):
    """A dimension and a fact, of as many rows as two given tables: foreign keys covered, columns filled."""
    from weftspark.plans.examples import SHOP
    from weftspark.plans.generate import generate
    from weftspark.plans.spec import Dataset

    spec = Dataset.from_json(SHOP.to_json())
    for name, like in (("shops", "nation"), ("orders_x", "customer")):
        spec.tables[name].row_count = table(spark, sf_dir, like).count()
    made = generate(spark, spec)
    shops, facts = made["shops"], made["orders_x"]
    lost = facts.join(shops, "shop_id", "left_anti").agg(F.count("*").alias("n_orphans"))
    a = facts.agg(F.lit("orders_x").alias("name"), F.count("*").alias("n"), F.bool_and(F.col("gross").isNotNull() & F.col("spent_7d").isNotNull()).alias("filled"))
    b = shops.agg(F.lit("shops").alias("name"), F.count("*").alias("n"), F.bool_and(F.col("city").isNotNull()).alias("filled"))
    one = a.join(F.broadcast(lost)).select("name", "n", "n_orphans", "filled")
    return one.union(b.select("name", "n", F.lit(0).cast("long").alias("n_orphans"), "filled"))


@query(f"select o_orderkey from orders order by {_u('sample', seed=42)}, o_orderkey limit 100")
def hash_sample(spark, sf_dir):
    """100 orders drawn without replacement, those of least hash."""
    return synth.hash_sample(_orders(spark, sf_dir), 100, ["o_orderkey"], draw=rng.digest01)


_RANGES = """u as (select o_orderkey, cast('0x' || md5('7/{stream}/' || o_orderkey)[1:13] as ubigint)::double / 4503599627370496 as u from orders),
  w as (select *, sum({weight}::decimal(28,9)) over (order by {key}) as upto, sum({weight}::decimal(28,9)) over () as total, {weight}::decimal(28,9) as w from {table} where {weight} > 0),
  r as (select *, (upto - w)::double / total::double as low, case when upto = total then 2 else upto::double / total::double end as high from w)"""


@query("with " + _RANGES.format(stream="lookup", weight="c_acctbal", key="c_custkey", table="customer") + """
  select o_orderkey, c_custkey, c_mktsegment from u left join r on u.u >= r.low and u.u < r.high""")
def lookup_weighted(spark, sf_dir):
    """A customer drawn for every order, by balance."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return lookups.draw_from(rows, "o_orderkey", table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment"], ["c_custkey"], "c_acctbal")


@query("with " + _RANGES.format(stream="orders_x.place", weight="1", key="n_nationkey", table="nation") + """
  select o_orderkey, n_name as place from u left join r on u.u >= r.low and u.u < r.high""")
def lookup_provider(spark, sf_dir):
    """The provider lookup.nation.n_name over the keys of a given table."""
    from weftspark.plans.providers import lookup_columns

    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    asked = {"place": {"name": "lookup.nation.n_name", "config": {"order": ["n_nationkey"]}}}
    return lookup_columns(rows, "o_orderkey", asked, {"nation": table(spark, sf_dir, "nation")}, 7, "orders_x")


@query("with " + _RANGES.format(stream="lookup", weight="n_nationkey", key="n_nationkey", table="nation").replace("o_orderkey", "l").replace("from orders", "from (select unnest(range((select count(*) from customer))) as l)") + """
  select l as draw, n_nationkey, n_name, n_regionkey from u left join r on u.u >= r.low and u.u < r.high""")
def weighted_rows(spark, sf_dir):
    """As many draws of whole rows, by weight and with replacement, as there are customers."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return lookups.sample_from(nation, table(spark, sf_dir, "customer").count(), ["n_nationkey"], "n_nationkey")
