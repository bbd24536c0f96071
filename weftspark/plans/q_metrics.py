"""Queries of fidelity statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import metrics, scores
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 <> 0")


@query("""with c as (select o_custkey, count(*) as c from orders group by 1), r as (select c, row_number() over (order by c desc, o_custkey) as k from c)
          select round(regr_r2(ln(c::double), ln(k::double)), 6) as r2, round(-regr_slope(ln(c::double), ln(k::double)), 6) as exponent, count(*) as n_values from r""")
def zipf_fit(spark, sf_dir):
    return _rounded(metrics.rank_frequency_fit(table(spark, sf_dir, "orders"), "o_custkey"))


@query("""with r as (select o_totalprice as x, row_number() over (order by o_totalprice) as k, count(*) over () as n from orders where o_totalprice > 0)
          select round(2 * sum(k * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n)::double, 6) as gini, max(n) as n from r""")
def gini(spark, sf_dir):
    return _rounded(metrics.gini(table(spark, sf_dir, "orders"), "o_totalprice"))


@query("select round((select sum(x) from (select o_totalprice as x from orders order by 1 desc limit 10)) / (select sum(o_totalprice) from orders), 9) as share")
def top_k_share(spark, sf_dir):
    return _rounded(metrics.top_k_share(table(spark, sf_dir, "orders"), "o_totalprice", 10), 9)


@query("""with c as (select p_brand, count(*) as o from part group by 1), e as (select sum(o) / count(*)::double as e from c)
          select round(sum(pow(o - e, 2) / e), 6) as statistic, count(*) - 1 as freedom from c, e""")
def chi_square_uniform(spark, sf_dir):
    return _rounded(metrics.chi_square(table(spark, sf_dir, "part"), "p_brand"))


@query("""with w(v, p) as (values ('F', 0.5::double), ('O', 0.3), ('P', 0.2)), c as (select o_orderstatus as v, count(*) as o from orders group by 1), n as (select count(*) as n from orders)
          select round(sum(case when coalesce(p, 0) > 0 then pow(coalesce(o, 0) - p * n, 2) / (p * n) else 'inf'::double end), 6) as statistic, count(*) - 1 as freedom
          from c full join w on c.v = w.v, n""")
def chi_square_expected(spark, sf_dir):
    return _rounded(metrics.chi_square(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0.5, "O": 0.3, "P": 0.2}))


_KS = """with v as (select {x} as x, count(*) as c from {t} group by 1), f as (select count(*) as n, min({x}) as lo, max({x}) as hi from {t}),
 r as (select x, c, sum(c) over (order by x) as k from v)
 select round(max(greatest(abs(k / n::double - (x - lo) / (hi - lo)), abs((k - c) / n::double - (x - lo) / (hi - lo)))), 9) as ks, max(n) as n from r, f"""


@query(_KS.format(x="o_totalprice", t="orders"))
def ks_uniform_stat(spark, sf_dir):
    return _rounded(metrics.ks_fitted(table(spark, sf_dir, "orders"), "o_totalprice", "uniform"), 9)


@query("""with x as (select distinct o_totalprice as x from orders), a as (select o_totalprice as v from orders where o_orderkey % 3 = 0), b as (select o_totalprice as v from orders where o_orderkey % 3 <> 0),
 c as (select o_totalprice as x, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1),
 r as (select x, sum(a) over w / sum(a) over ()::double as fa, sum(b) over w / sum(b) over ()::double as fb, lead(x) over w - x as step from c window w as (order by x))
 select round(max(abs(fa - fb)), 9) as ks, round(sum(abs(fa - fb) * step), 4) as wasserstein, round(1 - max(abs(fa - fb)), 9) as ks_complement,
 (select count(*) from a) as n_a, (select count(*) from b) as n_b from r""")
def ks_two_sample_wasserstein(spark, sf_dir):
    out = metrics.two_sample(*_halves(spark, sf_dir), "o_totalprice")
    return out.select(F.round("ks", 9).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"), F.round("ks_complement", 9).alias("ks_complement"), "n_a", "n_b")


@query("""with c as (select o_orderpriority as v, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1),
 t as (select *, sum(a) over () as na, sum(b) over () as nb from c)
 select round(sum(pow(b - a / na::double * nb, 2) / (a / na::double * nb)), 6) as chi2, round(sum(abs(a / na::double - b / nb::double)) / 2, 9) as tv,
 round(1 - sum(abs(a / na::double - b / nb::double)) / 2, 9) as tv_complement, count(*) as k from t""")
def categorical_two_sample(spark, sf_dir):
    out = metrics.categorical_two_sample(*_halves(spark, sf_dir), "o_orderpriority")
    return out.select(F.round("chi2", 6).alias("chi2"), F.round("tv", 9).alias("tv"), F.round("tv_complement", 9).alias("tv_complement"), "k")


@query("""with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a,
                            rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part)
          select round(corr(a, b), 6) as spearman from r""")
def spearman(spark, sf_dir):
    return _rounded(metrics.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"))


@query("""with c as (select o_orderstatus as a, o_orderpriority as b, count(*)::double as c from orders group by 1, 2),
          t as (select *, sum(c) over (partition by a) as ca, sum(c) over (partition by b) as cb, sum(c) over () as n from c)
          select round(sum(c / n * ln(c * n / (ca * cb))), 9) as mi from t""")
def mutual_information(spark, sf_dir):
    return _rounded(metrics.mutual_information(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 9)


@query("""with c as (select o_orderstatus, o_orderpriority, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1, 2),
          t as (select *, sum(a) over () as na, sum(b) over () as nb from c)
          select round(1 - sum(abs(a / na::double - b / nb::double)) / 2, 9) as similarity from t""")
def contingency_similarity(spark, sf_dir):
    return _rounded(metrics.contingency_similarity(*_halves(spark, sf_dir), ("o_orderstatus", "o_orderpriority")), 9)


@query("""with r as (select corr(l_quantity, l_extendedprice) filter (l_orderkey % 3 = 0) as r_a, corr(l_quantity, l_extendedprice) filter (l_orderkey % 3 <> 0) as r_b from lineitem)
          select round(r_a, 6) as r_a, round(r_b, 6) as r_b, round(1 - abs(r_a - r_b) / 2, 6) as similarity from r""")
def correlation_similarity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _rounded(metrics.correlation_similarity(lines.where("l_orderkey % 3 = 0"), lines.where("l_orderkey % 3 <> 0"), ("l_quantity", "l_extendedprice")))


@query("""with a as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer), b as (select min(s_acctbal) as lo, max(s_acctbal) as hi from supplier)
          select round(greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)), 9) as similarity from a, b""")
def range_similarity(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"))
    return _rounded(metrics.range_similarity(a, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x")), "x"), 9)


@query("""with c as (select o_orderpriority, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1),
          t as (select *, sum(a) over () as na, sum(b) over () as nb from c)
          select round(0.5 * (count(*) filter (a > 0 and b > 0) / count(*)::double) + 0.5 * sum(least(a / na::double, b / nb::double)), 9) as similarity from t""")
def domain_similarity(spark, sf_dir):
    return _rounded(metrics.domain_similarity(*_halves(spark, sf_dir), "o_orderpriority"), 9)


@query("""select a.vec_id, round(least(greatest(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 1), 6) as similarity
          from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("v"), F.col("embedding").alias("other"))
    pairs = e.join(other, F.col("vec_id") == F.col("v"))
    return pairs.select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(r"""with w as (select item_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') as w from benchmark)
          select a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double, 9) as similarity
          from w a join w b on b.item_id = a.item_id + 1""")
def jaccard_text_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("v"), F.col("text").alias("other"))
    return b.join(other, F.col("item_id") == F.col("v")).select("item_id", F.round(metrics.word_jaccard(F.col("text"), F.col("other")), 9).alias("similarity"))


@query("""with m as (select round(1 - max(abs(fa - fb)), 9) as s from (
            select sum(a) over w / sum(a) over ()::double as fa, sum(b) over w / sum(b) over ()::double as fb from (
              select o_totalprice as x, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1) window w as (order by x))),
          c as (select 1 - sum(abs(a / na::double - b / nb::double)) / 2 as s from (select *, sum(a) over () as na, sum(b) over () as nb from (
              select o_orderpriority as v, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1))),
          p as (select 1 - sum(abs(a / na::double - b / nb::double)) / 2 as s from (select *, sum(a) over () as na, sum(b) over () as nb from (
              select o_orderstatus, o_orderpriority, count(*) filter (o_orderkey % 3 = 0) as a, count(*) filter (o_orderkey % 3 <> 0) as b from orders group by 1, 2)))
          select round((m.s + c.s) / 2, 6) as marginal, round(p.s, 6) as pairwise, round(0.7 * (m.s + c.s) / 2 + 0.3 * p.s, 6) as fidelity from m, c, p""")
def table_fidelity(spark, sf_dir):
    """0.7 of the mean marginal similarity and 0.3 of the pairwise one."""
    a, b = _halves(spark, sf_dir)
    m = metrics.two_sample(a, b, "o_totalprice").select(F.col("ks_complement").alias("m"))
    c = metrics.categorical_two_sample(a, b, "o_orderpriority").select(F.col("tv_complement").alias("c"))
    p = metrics.contingency_similarity(a, b, ("o_orderstatus", "o_orderpriority"))
    t = m.join(F.broadcast(c)).join(F.broadcast(p))
    marginal, pairwise = (F.col("m") + F.col("c")) / 2, F.col("similarity")
    return _rounded(t.select(marginal.alias("marginal"), pairwise.alias("pairwise"), (0.7 * marginal + 0.3 * pairwise).alias("fidelity")))


_INTRA = ("l_quantity", "l_extendedprice", "l_discount")
_R = "(select corr({a}, {b}) from lineitem where l_returnflag = '{f}')"


@query("select round(1 - (" + " + ".join(f"abs({_R.format(a=a, b=b, f='A')} - {_R.format(a=a, b=b, f='N')})" for i, a in enumerate(_INTRA) for b in _INTRA[i + 1 :]) + ") / 6, 9) as score")
def score_intra(spark, sf_dir):
    """How alike the correlations of lines of two states are."""
    lines = table(spark, sf_dir, "lineitem")
    found = scores.intra_score(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), list(_INTRA))
    return spark.createDataFrame([(round(found, 9),)], "score double")


_DEGREE = """(select n, row_number() over (order by n) as k from (select count(o_custkey)::double as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = '{s}' group by c_custkey))"""


@query(f"""with c as (select count(*) filter (o_orderstatus = 'O' and o_custkey in (select c_custkey from customer)) / count(*) filter (o_orderstatus = 'O')::double as coverage,
  least(count(*) filter (o_orderstatus = 'F'), count(*) filter (o_orderstatus = 'O')) / greatest(count(*) filter (o_orderstatus = 'F'), count(*) filter (o_orderstatus = 'O'))::double as ratio from orders),
  w as (select avg(abs(a.n - b.n)) as w1 from {_DEGREE.format(s='F')} a join {_DEGREE.format(s='O')} b using (k))
  select round(0.4 * coverage + 0.3 / (1 + w1) + 0.3 * (coverage + ratio) / 2, 9) as score from c, w""")
def score_inter(spark, sf_dir):
    """How alike orders of two states hang on customers: coverage, degrees and cardinality."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    sides = [(customer, orders.where(F.col("o_orderstatus") == s)) for s in ("F", "O")]
    return spark.createDataFrame([(round(scores.inter_score(*sides, "c_custkey", "o_custkey"), 9),)], "score double")
