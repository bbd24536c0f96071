"""Queries of dependencies, keys, fits and schema comparison."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from weftspark.operators import dependencies, evaluate, matching, metrics
from weftspark.operators.windows import Frame, WindowSpec, add_windows
from weftspark.plans.from_data import column_type
from weftspark.plans.registry import Catalog
from weftspark.session import TABLES, table

CATALOG = Catalog()
query = CATALOG.query


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_FD = """select '{a}' as lhs, '{b}' as rhs, sum(n)::bigint as n, round(coalesce(sum(n) filter (one), 0) / sum(n)::double, 9) as confidence
         from (select {a}, count(*) as n, count(distinct {b}) = 1 as one from {t} group by 1)"""
_FD_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("select * from (" + " union all ".join(_FD.format(a=a, b=b, t="customer") for a, b in permutations(_FD_COLUMNS, 2)) + ") where confidence >= 0.9")
def discover_fds_single(spark, sf_dir):
    return _rounded(dependencies.discover_fds(table(spark, sf_dir, "customer"), list(_FD_COLUMNS), 1, confidence=0.9), 9)


_PAIR = """select '{l}' as lhs, '{b}' as rhs, sum(n)::bigint as n, round(coalesce(sum(n) filter (one), 0) / sum(n)::double, 9) as confidence
           from (select {l}, count(*) as n, count(distinct {b}) = 1 as one from lineitem group by {l})"""


@query(" union all ".join(_PAIR.format(l=s, b=b) for s in ("l_orderkey,l_linenumber", "l_orderkey,l_partkey") for b in ("l_quantity", "l_shipdate")))
def fd_confidence_pairs(spark, sf_dir):
    """Left sides of two columns; those of one left side share its grouping."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = (dependencies.fd_confidences(lines, ["l_orderkey", c], ["l_quantity", "l_shipdate"]) for c in ("l_linenumber", "l_partkey"))
    return _rounded(a.union(b), 9)


@query(" union all ".join(f"select '{t}' as tab, '{c}' as key from (select count(*) = count(distinct {c}) as u from {t}) where u" for t, cs in (
    ("nation", ("n_nationkey", "n_name", "n_regionkey")), ("supplier", ("s_suppkey", "s_name", "s_nationkey")), ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))) for c in cs))
def candidate_keys(spark, sf_dir):
    """Keys of one column: what determines all others by the discovered dependencies, or is unique."""
    rows = []
    for t, columns in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("supplier", ["s_suppkey", "s_name", "s_nationkey"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])):
        df = table(spark, sf_dir, t).select(*columns)
        found = [({r["lhs"]}, {r["rhs"]}) for r in dependencies.discover_fds(df, columns, 1, confidence=1.0).collect()]
        unique = [r["column"] for r in dependencies.unique_columns(df).where("is_unique").collect()]
        rows += [(t, ",".join(k)) for k in dependencies.candidate_keys(columns, found, unique, 1)]
    return spark.createDataFrame(rows, "tab string, key string")


_NORMAL = """(case when z >= 0 then 1 - tail else tail end)"""
_KS_NORMAL = """select '{family}' as family, round(max(greatest(abs(k / n::double - {cdf}), abs((k - c) / n::double - {cdf}))), 6) as ks, max(n) as n from (
  select *, exp(-a * a / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) as tail from (
  select *, abs(z) as a, 1 / (1 + 0.2316419 * abs(z)) as t from (
  select x, c, sum(c) over (order by x) as k, n, (x - m) / s as z from (select {x} as x, count(*) as c from orders group by 1),
  (select count(*) as n, avg({x}) as m, stddev_pop({x}) as s from orders))))"""
_KS_OTHER = """select '{family}' as family, round(max(greatest(abs(k / n::double - {cdf}), abs((k - c) / n::double - {cdf}))), 6) as ks, max(n) as n from (
  select x, c, sum(c) over (order by x) as k, n, m, lo, lm from (select o_totalprice as x, count(*) as c from orders group by 1),
  (select count(*) as n, avg(o_totalprice) as m, min(o_totalprice) as lo, avg(ln(o_totalprice)) as lm from orders))"""


@query(" union all ".join([
    _KS_NORMAL.format(family="normal", x="o_totalprice", cdf=_NORMAL), _KS_NORMAL.format(family="lognormal", x="ln(o_totalprice)", cdf=_NORMAL),
    _KS_OTHER.format(family="exponential", cdf="(1 - exp(-x / m))"), _KS_OTHER.format(family="pareto", cdf="(1 - pow(lo / x, 1 / (lm - ln(lo))))"),
]))
def ks_families(spark, sf_dir):
    """KS distance of a column to four families fitted to it, in one pass."""
    return _rounded(metrics.ks_of_families(table(spark, sf_dir, "orders"), "o_totalprice", ["normal", "lognormal", "exponential", "pareto"]))


@query(_KS_NORMAL.format(family="normal", x="o_totalprice", cdf=_NORMAL) + " union all " + _KS_NORMAL.format(family="lognormal", x="ln(o_totalprice)", cdf=_NORMAL))
def ks_normal_stat(spark, sf_dir):
    """KS distance to fitted normal and lognormal."""
    orders = table(spark, sf_dir, "orders")
    one = metrics.ks_fitted(orders, "o_totalprice", "normal").withColumn("family", F.lit("normal"))
    return _rounded(one.unionByName(metrics.ks_fitted(orders, "o_totalprice", "lognormal").withColumn("family", F.lit("lognormal"))))


@query("""with recursive v as (select l_linenumber as x, count(*) as c from lineitem group by 1), f as (select count(*) as n, avg(l_linenumber) as m from lineitem),
  p as (select 0 as i, exp(-m) as p, exp(-m) as s from f union all select i + 1, p * m / (i + 1), s + p * m / (i + 1) from p, f where i < 40),
  r as (select x, c, sum(c) over (order by x) as k, n from v, f)
  select round(max(greatest(abs(k / n::double - least(a.s, 1)), abs((k - c) / n::double - coalesce(b.s, 0)))), 6) as ks, max(n) as n
  from r join p a on a.i = r.x left join p b on b.i = r.x - 1""")
def ks_poisson(spark, sf_dir):
    return _rounded(metrics.ks_fitted(table(spark, sf_dir, "lineitem"), "l_linenumber", "poisson"))


@query("""with a as (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_returnflag = 'A'),
  b as (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_returnflag = 'N')
  select round(0.4 * greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo))
    + 0.3 * (1 - least(1, abs(a.m - b.m) / greatest(abs(a.m), abs(b.m)))) + 0.3 * (1 - least(1, abs(a.s - b.s) / greatest(abs(a.s), abs(b.s)))), 6) as similarity from a, b""")
def moment_similarity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _rounded(metrics.moment_similarity(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), "l_extendedprice"))


@query("select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval '36 hours' preceding and current row), 4) as price from orders")
def win_bare_column(spark, sf_dir):
    """A window over a column alone is its mean; the span is given in hours."""
    spec = WindowSpec("o_totalprice", "o_orderdate", ("o_custkey",), Frame("RANGE", "36 hours"))
    return add_windows(table(spark, sf_dir, "orders"), {"price": spec}).select("o_orderkey", F.round("price", 4).alias("price"))


@query("""select event_id, sum(event_id) over (order by ts range between interval '45 minutes' preceding and interval '15 minutes' following) as around,
          count(*) over (order by ts range between interval '2 hours' preceding and current row) as n from events""")
def win_global_slabs(spark, sf_dir):
    """RANGE windows over all rows, cut into slabs of time with their frames' halos."""
    specs = {"around": WindowSpec("sum(event_id)", "ts", (), Frame("RANGE", "45min", "15min")), "n": WindowSpec("count(*)", "ts", (), Frame("RANGE", "2 hours"))}
    return add_windows(table(spark, sf_dir, "events").select("event_id", "ts"), specs).select("event_id", "around", "n")


#: An order that tells lines apart in all that the queries read.
_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
_LINES = f"order by l_shipdate, {', '.join(_TIE)}"


@query(f"""select l_orderkey, l_linenumber, sum(l_linenumber) over ({_LINES} rows between 49 preceding and 5 following) as around,
           round(avg(l_quantity) over ({_LINES} rows between 6 preceding and current row), 6) as mean7 from lineitem""")
def win_global_rows(spark, sf_dir):
    """ROWS windows over all rows, in slabs of numbered rows."""
    by = {"order_by": "l_shipdate", "tiebreak": _TIE}
    specs = {"around": WindowSpec("sum(l_linenumber)", frame=Frame("ROWS", 50, 5), **by), "mean7": WindowSpec("l_quantity", frame=Frame("ROWS", 7), **by)}
    out = add_windows(table(spark, sf_dir, "lineitem").select(*_TIE, "l_shipdate"), specs)
    return out.select("l_orderkey", "l_linenumber", "around", F.round("mean7", 6).alias("mean7"))


@query(f"""select l_orderkey, l_linenumber, lag(l_partkey, 3) over ({_LINES}) as before, lead(l_partkey) over ({_LINES}) as next,
           lead(l_partkey) over ({_LINES}) - lag(l_partkey, 3) over ({_LINES}) as gap, sum(l_partkey) over ({_LINES} rows between 1 preceding and current row) as two from lineitem""")
def win_global_lag(spark, sf_dir):
    """lag and lead over all rows, and a window over a column that such windows made."""
    by = {"order_by": "l_shipdate", "tiebreak": _TIE}
    specs = {"before": WindowSpec("lag(l_partkey, 3)", **by), "next": WindowSpec("lead(l_partkey)", **by), "two": WindowSpec("sum(l_partkey)", frame=Frame("ROWS", 2), **by)}
    out = add_windows(table(spark, sf_dir, "lineitem").select(*_TIE, "l_shipdate"), specs)
    return out.select("l_orderkey", "l_linenumber", "before", "next", (F.col("next") - F.col("before")).alias("gap"), "two")


@query("""with a as (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as last3 from orders)
  select o_orderkey, round(last3, 4) as last3, round(avg(last3) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 1 preceding and current row), 4) as smooth from a""")
def win_of_a_window(spark, sf_dir):
    """A window that reads the column an earlier one made."""
    by = {"order_by": "o_orderdate", "partition_by": ("o_custkey",), "tiebreak": ("o_orderkey",)}
    specs = {"last3": WindowSpec("sum(o_totalprice)", frame=Frame("ROWS", 3), **by), "smooth": WindowSpec("mean(last3)", frame=Frame("ROWS", 2), **by)}
    out = add_windows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), specs)
    return out.select("o_orderkey", F.round("last3", 4).alias("last3"), F.round("smooth", 4).alias("smooth"))


#: Column names of the two sides without their tables' letters.
_SIDES = """r as (select distinct substr(column_name, 3) as c from information_schema.columns where table_name = 'customer'),
            m as (select distinct substr(column_name, 3) as c from information_schema.columns where table_name = 'supplier')"""


def _side(spark, sf_dir, name):
    role = lambda c: "primary_key" if c in ("custkey", "suppkey") else "foreign_key" if c == "nationkey" else "attribute"
    rows = [("t", c, column_type(f.dataType), role(c), "n.nationkey" if c == "nationkey" else None) for f in table(spark, sf_dir, name).schema for c in [f.name[2:]]]
    return spark.createDataFrame(rows, matching.SCHEMA)


@query(f"""with {_SIDES}, h as (select count(*) as n from r join m using (c)), x as (select h.n / (select count(*) from m)::double as p, h.n / (select count(*) from r)::double as q from h),
  k as (select unnest(['primary_key', 'foreign_key']) as kind, unnest([['custkey', 'suppkey'], ['nationkey']]) as names),
  y as (select kind, (select count(*) from r where c in (select unnest(names))) as r, (select count(*) from m where c in (select unnest(names))) as m,
               (select count(*) from r join m using (c) where c in (select unnest(names))) as n from k)
           select 'column' as kind, p as precision, q as recall, 2 * p * q / (p + q) as f1 from x union all select 'table', 1, 1, 1
           union all select kind, n / m::double, n / r::double, 2 * n / (m + r)::double from y""")
def schema_coverage(spark, sf_dir):
    """Precision, recall and F1 of one schema's names against another's: tables, columns, keys."""
    return matching.coverage(_side(spark, sf_dir, "customer"), _side(spark, sf_dir, "supplier"))


_KIND = "case when data_type in ('BIGINT', 'INTEGER') then 'INT' when data_type = 'DOUBLE' then 'FLOAT' when data_type like 'TIMESTAMP%' then 'DATETIME' else 'TEXT' end"
_NUMBER, _TIME = "('INT', 'FLOAT')", "('DATE', 'DATETIME')"


@query(f"""with c as (select table_name as t, column_name as c, {_KIND} as k from information_schema.columns where table_name in ('orders', 'lineitem', 'events'))
           select a.c as a, b.c as b, case when a.k = b.k then 1.0::double when a.k in {_NUMBER} and b.k in {_NUMBER} or a.k in {_TIME} and b.k in {_TIME} then 0.8 else 0.0 end as similarity
           from c a join c b on a.t < b.t""")
def type_similarity(spark, sf_dir):
    """Similarity of the types of every column pair of three tables."""
    rows = [(t, f.name, column_type(f.dataType)) for t in ("orders", "lineitem", "events") for f in table(spark, sf_dir, t).schema]
    c = spark.createDataFrame(rows, "t string, c string, k string")
    a, b = c.withColumnsRenamed({"t": "ta", "c": "a", "k": "ka"}), c.withColumnsRenamed({"t": "tb", "c": "b", "k": "kb"})
    return a.join(b, F.col("ta") < F.col("tb")).select("a", "b", matching.type_similarity(F.col("ka"), F.col("kb")).alias("similarity"))


@query(f"""with g(t, c) as (select distinct table_name, column_name from information_schema.columns where table_name in {TABLES}),
  tri as (select t, c, list_distinct([substr('##' || lower(replace(c, '_', '')) || '##', i, 3) for i in range(1, length(replace(c, '_', '')) + 3)]) as g from g)
  select a.c as a, b.c as b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::double, 9) as similarity
  from tri a join tri b on a.t = 'customer' and b.t in ('supplier', 'nation')""")
def trigram_similarity(spark, sf_dir):
    """Trigram Jaccard of column names."""
    names = lambda *ts: spark.createDataFrame([(f.name,) for t in ts for f in table(spark, sf_dir, t).schema], "c string")
    a, b = names("customer").withColumnRenamed("c", "a"), names("supplier", "nation").withColumnRenamed("c", "b")
    return a.join(b, F.lit(True)).select("a", "b", F.round(matching.trigram_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"""with {_SIDES}, c as (select substr(column_name, 3) as c, {_KIND} as k, table_name as t from information_schema.columns where table_name in ('customer', 'supplier')),
  f as (select 2.0 * (select count(*) from r join m using (c)) / ((select count(*) from r) + (select count(*) from m)) as f1),
  y as (select count(*) filter (a.k = b.k) / count(*)::double as y from c a join c b on a.c = b.c and a.t = 'customer' and b.t = 'supplier')
  , v as (select 'column_f1' as metric, f1::double as value from f union all select 'table_f1', 1 union all select 'type_accuracy', y from y
        union all select 'primary_key_f1', (select count(*) from r join m using (c) where c in ('custkey', 'suppkey')) union all select 'foreign_key_f1', (select count(*) from r join m using (c) where c = 'nationkey')
        union all select 'key_accuracy', count(*) filter (c in (select c from m)) / count(*)::double from r where c in ('custkey', 'nationkey'))
  select metric, round(value, 9) as value from v union all select 'mean', round(avg(value), 9) from v""")
def schema_report(spark, sf_dir):
    """Scores of schemas alone: names, types and keys, and their mean."""
    return _rounded(evaluate.schema_report(_side(spark, sf_dir, "customer"), _side(spark, sf_dir, "supplier")), 9)


@query("""with z as (select regr_r2(ln(c::double), ln(k::double)) as r2 from (select c, row_number() over (order by c desc) as k from (select count(*) as c from orders group by o_custkey)))
          select 'orders' as tab, 'o_custkey' as col, 'fk_coverage' as metric, count(*) filter (o_custkey in (select c_custkey from customer)) / count(*)::double as value,
          count(*) filter (o_custkey in (select c_custkey from customer)) / count(*)::double > 0.999 as passed from orders
          union all select 'orders', null, 'row_share', 1, true
          union all select 'customer', null, 'row_share', (select count(*) from customer) / (select count(*) from orders)::double, (select count(*) from customer) >= 0.999 * (select count(*) from orders)
          union all select 'orders', 'o_custkey', 'zipf_r2', round(r2, 6), r2 >= 0.92 from z""")
def evaluate_tables(spark, sf_dir):
    """The single-table evaluator over two real tables, one with fewer rows than declared: coverage, row counts and a Zipf law."""
    from weftspark.plans.spec import Column, Dataset, ForeignKey, Rule, Table

    made = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    spec = Dataset({
        "customer": Table("customer", [Column("c_custkey", "INT")], row_count=made["orders"].count(), primary_key=["c_custkey"]),
        "orders": Table("orders", [Column("o_custkey", "INT")], row_count=made["orders"].count(), foreign_keys=[ForeignKey("o_custkey", "customer", "c_custkey")]),
    }, [Rule("orders", "o_custkey", {"kind": "zipf", "n": 10})])
    return evaluate.single_tables(spark, spec, made).withColumn("value", F.when(F.col("metric") == "zipf_r2", F.round("value", 6)).otherwise(F.col("value")))
