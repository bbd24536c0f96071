"""Queries of text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import text_diversity
from weftspark.plans import nuances
from weftspark.plans.examples import SHOP
from weftspark.plans.registry import Catalog
from weftspark.session import table

CATALOG = Catalog()
query = CATALOG.query

_STOP = ("the", "of", "and", "to", "in", "is", "it")
_TERMS = r"""t as (select item_id as doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from benchmark),
  c as (select doc, term, count(*)::double as tf from t {where} group by all)"""


@query("with " + _TERMS.replace("{where}", f"where term not in {_STOP}") + """,
  n as (select doc, sum(tf * tf) as n from c group by doc),
  m as (select a.doc as a, b.doc as b, sum(a.tf * b.tf) as dot, sum(a.tf * a.tf) as ia, sum(b.tf * b.tf) as ib from c a join c b on a.term = b.term and a.doc < b.doc group by all),
  s as (select m.a, m.b, dot / sqrt((ia + pow(ln(1.5::double) + 1, 2) * (x.n - ia)) * (ib + pow(ln(1.5::double) + 1, 2) * (y.n - ib))) as similarity
        from m join n x on x.doc = m.a join n y on y.doc = m.b)
  select a, b, round(similarity, 9) as similarity from s where similarity > 0.2""")
def text_pairs_by_pair(spark, sf_dir):
    """Pairs of texts above a cosine, terms weighted within each pair, without stop words."""
    found = text_diversity.similar_texts(table(spark, sf_dir, "benchmark"), "item_id", "text", 0.2, "pair", _STOP)
    return found.withColumn("similarity", F.round("similarity", 9))


@query("with " + _TERMS.replace("{where}", "") + """,
  f as (select term, count(*) as df from c group by term), w as (select doc, term, tf * (ln((1 + (select count(distinct doc) from c)) / (1 + df)::double) + 1) as w from c join f using (term)),
  n as (select doc, sum(w * w) as n from w group by doc),
  s as (select a.doc as a, b.doc as b, sum(a.w * b.w) / sqrt(max(x.n) * max(y.n)) as similarity
        from w a join w b on a.term = b.term and a.doc < b.doc join n x on x.doc = a.doc join n y on y.doc = b.doc group by all)
  select a, b, round(similarity, 9) as similarity from s where similarity > 0.15""")
def text_pairs_by_corpus(spark, sf_dir):
    """Pairs of texts above a cosine, terms weighted by their document frequency."""
    found = text_diversity.similar_texts(table(spark, sf_dir, "benchmark"), "item_id", "text", 0.15, "corpus")
    return found.withColumn("similarity", F.round("similarity", 9))


@query("with " + _TERMS.replace("{where}", "") + """,
  n as (select doc, sum(tf * tf) as n from c group by doc),
  m as (select a.doc as a, b.doc as b, sum(a.tf * b.tf) as dot, sum(a.tf * a.tf) as ia, sum(b.tf * b.tf) as ib from c a join c b on a.term = b.term and a.doc < b.doc group by all),
  s as (select m.a, m.b, dot / sqrt((ia + pow(ln(1.5::double) + 1, 2) * (x.n - ia)) * (ib + pow(ln(1.5::double) + 1, 2) * (y.n - ib))) as similarity
        from m join n x on x.doc = m.a join n y on y.doc = m.b)
  select count(*) = 0 as diverse, count(*) as pairs, (select count(distinct doc) from c) as texts from s where similarity > 0.4""")
def text_diversity_check(spark, sf_dir):
    """Whether all texts are diverse, and how many pairs are not."""
    texts = table(spark, sf_dir, "benchmark")
    n = text_diversity.term_counts(texts, "item_id", "text").agg(F.count_distinct("doc").alias("texts"))
    return text_diversity.similar_texts(texts, "item_id").agg((F.count("*") == 0).alias("diverse"), F.count("*").alias("pairs")).join(n)


_COVERED = nuances.constructs(SHOP)
_FAMILY = "select '{f}' as family, count(*) filter ({found}) as n, {covered} as covered from (select lower(text) as t from documents)"


@query(" union all ".join(_FAMILY.format(f=f, found=" or ".join(f"contains(t, '{k}')" for k in keywords), covered="true" if needs & _COVERED else "false")
                          for f, (keywords, needs) in nuances.FAMILIES.items()))
def keyword_families(spark, sf_dir):
    """How many texts mention each family of keywords, and whether a spec has what it asks for."""
    return nuances.family_counts(table(spark, sf_dir, "documents"), "doc_id", "text", SHOP)
