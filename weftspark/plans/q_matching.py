"""Queries of schema matching by data, names and assignment."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from weftspark.operators import data_match, dependencies, matching, structure, trends
from weftspark.plans.from_data import column_type
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query

#: Two real tables with renamed columns of like meaning, their types and roles.
_SIDES = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}
_ROLES = {"c_custkey": "primary_key", "s_suppkey": "primary_key", "c_nationkey": "foreign_key", "s_nationkey": "foreign_key"}
_NUMBERS = ("c_custkey", "s_suppkey", "c_nationkey", "s_nationkey", "c_acctbal", "s_acctbal")
_SIMILAR = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::double"


def _rounded(df, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _inputs(spark, sf_dir):
    """Tables, schemas and dependencies of a single column on each side, of both tables."""
    out = []
    for t, columns in _SIDES.items():
        df = table(spark, sf_dir, t).select(*columns)
        schema = spark.createDataFrame([(t, f.name, column_type(f.dataType), _ROLES.get(f.name, "attribute"), None) for f in df.schema], matching.SCHEMA)
        found = dependencies.discover_fds(df, list(columns), 1, confidence=1.0).select(F.lit(t).alias("tab"), "lhs", "rhs")
        out.append(({t: df}, schema, found))
    (real, real_schema, real_fds), (made, made_schema, made_fds) = out
    return real, made, real_schema, made_schema, real_fds, made_fds


def _trigrams(c):
    return f"list_distinct([substr('##' || replace({c}, '_', '') || '##', i, 3) for i in range(1, length(replace({c}, '_', '')) + 3)])"


_FDS = " union all ".join(
    f"select '{t}' as tab, '{a}' as lhs, '{b}' as rhs where (select bool_and(n = 1) from (select count(distinct {b}) as n from {t} where {a} is not null group by {a} having count({b}) > 0))"
    for t, columns in _SIDES.items() for a, b in permutations(columns, 2)
)
_COLUMNS = " union all ".join(
    f"select '{t}' as tab, '{c}' as col, '{_ROLES.get(c, 'attribute')}' as role, {'true' if c in _NUMBERS else 'false'} as num, "
    + (f"min({c})::double as lo, max({c})::double as hi from {t}" if c in _NUMBERS else "null as lo, null as hi")
    for t, columns in _SIDES.items() for c in columns
)
_DOMAINS = " union all ".join(
    f"(select '{t}' as tab, '{c}' as col, {c} as value, count(*) as n from {t} where {c} is not null group by 3 order by n desc, value limit 100)"
    for t, columns in _SIDES.items() for c in columns if c not in _NUMBERS
)
_SCORES = f"""
with fds as ({_FDS}), cols as ({_COLUMNS}), top as ({_DOMAINS}),
dom as (select *, n / sum(n) over (partition by tab, col) as share, count(*) over (partition by tab, col) as k from top),
c as (select *, {_trigrams('col')} as g, (select count(*) from fds f where f.tab = cols.tab and f.lhs = col) as l, (select count(*) from fds f where f.tab = cols.tab and f.rhs = col) as r from cols),
met as (
  select a.tab as ta, a.col as ca, b.tab as tb, b.col as cb,
         0.5 * count(*) / (max(a.k) + max(b.k) - count(*)) + 0.5 * sum(least(a.share, b.share)) as range
  from dom a join dom b on a.value = b.value and a.tab = 'customer' and b.tab = 'supplier' group by all),
p as (
  select a.tab as r_tab, a.col as r_col, b.tab as m_tab, b.col as m_col, {_SIMILAR.format(a='a.g', b='b.g')} as name,
         case when a.num then greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) else coalesce(met.range, 0) end as range,
         case when a.role <> b.role then 0 when a.role = 'primary_key' then 1 when a.role = 'foreign_key' then 0.8 else 0.5 end::double as role,
         exp(-0.5 * abs(a.l - b.l) - 0.5 * abs(a.r - b.r)) as dependency
  from c a join c b on a.num = b.num and a.tab = 'customer' and b.tab = 'supplier' left join met on met.ca = a.col and met.cb = b.col),
s as (select *, 0.1 * name + 0.4 * range + 0.3 * role + 0.2 * dependency as score from p)
"""


@query(_SCORES + "select r_tab, r_col, m_tab, m_col, " + ", ".join(f"round({c}, 9)::double as {c}" for c in ("name", "range", "role", "dependency", "score")) + " from s")
def match_column_scores(spark, sf_dir):
    """Names, ranges, roles and dependencies of every fitting pair of columns of two tables."""
    return _rounded(data_match.column_scores(*_inputs(spark, sf_dir)))


#: The signature of one table's dependencies, all of a single column on each side.
_SIGNATURE = "[n, 1, 1, k, 1, 1, 1, 1, n, n]::double[]"
#: Number columns and text columns of the two tables make two assignments: all orders are tried.
_ASSIGNED = """
num as (select max(a.score + b.score + c.score) as total from s a, s b, s c
  where a.r_col < b.r_col and b.r_col < c.r_col and a.m_col not in (b.m_col, c.m_col) and b.m_col <> c.m_col and a.r_col in {n} and b.r_col in {n} and c.r_col in {n}),
txt as (select max(score) as total from s where r_col not in {n}),
sig as (select tab, count(*)::double as n, (select count(distinct c) from (select tab as t, lhs as c from fds union all select tab, rhs from fds) where t = tab)::double as k from fds group by tab)
""".format(n=_NUMBERS)  # noqa: UP032


@query(_SCORES + ", " + _ASSIGNED + f"""
select 'customer' as r_tab, 'supplier' as m_tab, round(name, 9) as name, round(al, 9) as columns, round(card, 9) as cardinality, round(dep, 9) as dependency,
       round(0.1 * name + 0.6 * al + 0.1 * card + 0.1 * dep, 9) as score
from (select (select {_SIMILAR.format(a=_trigrams("'customer'"), b=_trigrams("'supplier'"))}) as name, (num.total + txt.total) / 5 as al,
             exp(-0.4 * abs(ln((select count(*) from customer) + 1) - ln((select count(*) from supplier) + 1))) as card,
             case when a.n is null and b.n is null then 1 when a.n is null or b.n is null then 0
                  else list_cosine_similarity({_SIGNATURE.replace('n', 'a.n').replace('k', 'a.k')}, {_SIGNATURE.replace('n', 'b.n').replace('k', 'b.k')}) end::double as dep
      from num, txt, (select 1) left join (select * from sig where tab = 'customer') a on true left join (select * from sig where tab = 'supplier') b on true)""")
def match_table_scores(spark, sf_dir):
    """Name, aligned columns, cardinality and dependency signature of a pair of tables."""
    given = _inputs(spark, sf_dir)
    return _rounded(data_match.table_scores(data_match.column_scores(*given), *given))


_NAMES = "('customer', 'supplier', 'nation')"


@query(f"""with c as (select table_name as t, column_name as c from information_schema.columns where table_name in {_NAMES}),
  p as (select a.c as a, b.c as b from c a join c b on a.t < b.t),
  l as (select a, b, (select max(len(s)) from (select unnest(flatten([[a[i:j] for j in range(i, len(a) + 1)] for i in range(1, len(a) + 1)])) as s) where contains(b, s)) as n from p),
  n as (select *, regexp_replace(regexp_replace(a, '[^a-z0-9]', '', 'g'), 's+$', '') as pa, regexp_replace(regexp_replace(b, '[^a-z0-9]', '', 'g'), 's+$', '') as pb from l)
  select a, b, coalesce(n, 0)::integer as common, round(coalesce(n, 0) / greatest(len(a), len(b))::double, 9) as ratio,
         pa = pb or coalesce(n, 0) / greatest(len(a), len(b))::double >= 0.6 as compatible from n""")
def common_substrings(spark, sf_dir):
    """Longest common substring and compatibility of every pair of column names of three tables."""
    rows = [(t, f.name) for t in ("customer", "supplier", "nation") for f in table(spark, sf_dir, t).schema]
    c = spark.createDataFrame(rows, "t string, c string")
    pairs = c.select(F.col("t").alias("ta"), F.col("c").alias("a")).join(c.select(F.col("t").alias("tb"), F.col("c").alias("b")), F.col("ta") < F.col("tb"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", matching.common_substring(a, b).alias("common"), F.round(matching.common_ratio(a, b), 9).alias("ratio"), matching.name_compatible(a, b, 0.6).alias("compatible"))


#: What is matched, and the dependencies of the second table in the first one's names.
_MATCHED = {"c_custkey": "s_suppkey", "c_name": "s_name", "c_nationkey": "s_nationkey", "c_acctbal": "s_acctbal"}
_RENAMED = "case {c} " + " ".join(f"when '{m}' then '{r}'" for r, m in _MATCHED.items()) + " end"


@query(f"""with recursive fds as ({_FDS}), g as (select lhs, rhs from fds where tab = 'customer'),
  m as (select {_RENAMED.format(c='lhs')} as lhs, {_RENAMED.format(c='rhs')} as rhs from fds where tab = 'supplier'),
  rg as (select lhs, rhs from g union select rg.lhs, g.rhs from rg join g on g.lhs = rg.rhs), rm as (select lhs, rhs from m union select rm.lhs, m.rhs from rm join m on m.lhs = rm.rhs),
  k as (select 'primary_key' as kind, 2 as n_gold, 2 as n_made, 1 as n_common, 1 as hm, 1 as hg union all select 'foreign_key', 1, 1, 1, 1, 1
        union all select 'dependency', (select count(*) from g), (select count(*) from m), c, c, c from (select count(*) as c from g join m using (lhs, rhs))
        union all select 'implied', (select count(*) from g), (select count(*) from m), least(x, y), x, y
        from (select (select count(*) from m where (lhs, rhs) in (select lhs, rhs from rg) or lhs = rhs) as x, (select count(*) from g where (lhs, rhs) in (select lhs, rhs from rm)) as y)),
  s as (select *, coalesce(hm / nullif(n_made, 0)::double, 0) as p, coalesce(hg / nullif(n_gold, 0)::double, 0) as r from k)
  select kind, n_gold, n_made, n_common, round(p, 9) as precision, round(r, 9) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1 from s""")
def structure_scores(spark, sf_dir):
    """F1 of keys, foreign keys and dependencies of two tables, compared as sets and by closure."""
    _, _, real, made, real_fds, made_fds = _inputs(spark, sf_dir)
    keyed = lambda df, c: df.withColumn("ref", F.when(F.col("col") == c, f"nation.{c}"))
    nation = spark.createDataFrame([("nation", c, "INT", "attribute", None) for c in ("c_nationkey", "s_nationkey")], matching.SCHEMA)
    real, made = keyed(real, "c_nationkey").union(nation.where("col = 'c_nationkey'")), keyed(made, "s_nationkey").union(nation.where("col = 's_nationkey'"))
    match = structure.match_frame(spark, [("customer", "supplier", 1.0, [(r, m, 1.0) for r, m in _MATCHED.items()])]).union(
        structure.match_frame(spark, [("nation", "nation", 1.0, [("c_nationkey", "s_nationkey", 1.0)])]))
    return _rounded(structure.structure_scores(real, made, match, real_fds, made_fds))


_LIKE = "{a} as (select column_name as c, case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'n' else data_type end as k from information_schema.columns where table_name = '{t}')"


@query(f"""with recursive {_LIKE.format(a='r', t='customer')}, {_LIKE.format(a='m', t='supplier')},
  p as (select r.c as a, m.c as b from r join m on r.k = m.k and r.c in {_SIDES['customer']} and m.c in {_SIDES['supplier']}),
  e as (select a, b from (select a, b, (select max(len(s)) from (select unnest(flatten([[a[i:j] for j in range(i, len(a) + 1)] for i in range(1, len(a) + 1)])) as s) where contains(b, s)) as n from p)
        where n / greatest(len(a), len(b))::double >= 0.3),
  o as (select a, row_number() over (order by a) as i from (select distinct a from e)),
  t(i, used) as (select 0::bigint, []::varchar[] union all
    select t.i + 1, u.used from t join o on o.i = t.i + 1, lateral (select t.used union all select list_append(t.used, e.b) from e where e.a = o.a and not list_contains(t.used, e.b)) u(used))
  select 'customer' as r_tab, 'supplier' as m_tab, max(len(used))::integer as n_pairs, round(2 * max(len(used)) / 9::double, 9) as f1 from t""")
def match_by_options(spark, sf_dir):
    """The most pairs of compatible columns of two tables, one to one, and their F1."""
    _, _, real, made, _, _ = _inputs(spark, sf_dir)
    return _rounded(matching.match_by_options(real, made, 0.3).drop("mapping"))


_JOINED = "select c_acctbal as x, c_mktsegment as g, o_totalprice as y, o_orderpriority as p, o_orderstatus as s from customer join orders on c_custkey = o_custkey where o_orderstatus in ('F', 'O')"
_BIN = "greatest(least(floor(({x} - {lo}) / (({hi} - {lo}) / 10)), 9), 0)"
_BX = _BIN.format(x="x", lo="(select min(c_acctbal) from customer)", hi="(select max(c_acctbal) from customer)")
_BY = _BIN.format(x="y", lo="(select min(o_totalprice) from orders where o_orderstatus = 'F')", hi="(select max(o_totalprice) from orders where o_orderstatus = 'F')")
_SHARES = """select '{p}' as parent_col, '{c}' as child_col, 'contingency' as metric, round(1 - sum(abs(f - o)) / 2, 9) as similarity from (
  select a, b, count(*) filter (s = 'F') / (select count(*) from j where s = 'F')::double as f, count(*) filter (s = 'O') / (select count(*) from j where s = 'O')::double as o
  from (select {a} as a, {b} as b, s from j) group by all)"""


@query(f"with j as ({_JOINED}) select 'c_acctbal' as parent_col, 'o_totalprice' as child_col, 'correlation' as metric, "
       "round(1 - abs((select corr(x, y) from j where s = 'F') - (select corr(x, y) from j where s = 'O')) / 2, 9) as similarity union all "
       + " union all ".join(_SHARES.format(p=p, c=c, a=a, b=b) for p, c, a, b in (
           ("c_acctbal", "o_orderpriority", _BX, "p"), ("c_mktsegment", "o_totalprice", "g", _BY), ("c_mktsegment", "o_orderpriority", "g", "p"))))
def intertable_trends(spark, sf_dir):
    """How customers' and orders' columns go together, for orders of two states."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    sides = [(customer, orders.where(F.col("o_orderstatus") == s)) for s in ("F", "O")]
    return _rounded(trends.intertable_trends(*sides, "c_custkey", "o_custkey", ["c_acctbal", "c_mktsegment"], ["o_totalprice", "o_orderpriority"]))
