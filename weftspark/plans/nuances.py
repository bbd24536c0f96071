"""What descriptions mention, by families of keywords, and whether a spec generates it.

A description is searched in one expression: a pattern of all keywords tells whether there is
anything to look for, and then every family lists its keywords that the text holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.plans.spec import Dataset

# Families of keywords in lower case, and the constructs of which a spec must have one.
FAMILIES: dict[str, tuple[list[str], set[str]]] = {
    "rolling": (["rolling", "rolling mean", "rolling average", "rolling sum", "rolling count", "moving average", "moving window"], {"window"}),
    "window": (["window", "sliding window", "moving window", "last n days", "last 7 days", "last 30 days"], {"window"}),
    "lag": (["lag", "previous value", "prior value"], {"lag_lead"}),
    "lead": (["lead", "next value", "following value"], {"lag_lead"}),
    "incident": (["incident", "event", "disruption", "outage", "failure", "storm", "campaign"], {"event"}),
    "heavy_tail": (["heavy tail", "heavy-tailed", "heavy tailed", "right-skewed", "right skewed", "skewed"], {"lognormal", "pareto"}),
    "log-normal": (["log-normal", "lognormal", "log normal"], {"lognormal"}),
    "pareto": (["pareto", "power-law", "power law", "80/20", "80-20", "80 20"], {"pareto"}),
    "mixture": (["mixture", "multi-modal", "multimodal", "base traffic + spikes", "normal + incident"], {"mixture"}),
    "zipf": (["zipf", "zipfian"], {"zipf"}),
    "proration": (["proration", "prorate", "overlap", "interval"], {"proration"}),
    "pay-day": (["pay-day", "payday", "pay day", "salary day", "15th", "1st of month"], {"seasonal"}),
    "surge": (["surge", "peak", "spike", "burst", "traffic spike"], {"mixture", "event"}),
    "churn": (["churn", "cancellation", "attrition", "within 30 days"], {"condition"}),
    "fraud": (["fraud", "fraudulent", "anomaly", "anomalous"], {"mixture", "event"}),
    "seasonal": (["seasonal", "seasonality", "holiday", "weekend"], {"seasonal"}),
}
#: Parts of an expression that make a construct.
IN_EXPRESSIONS = {
    "window": ("rolling_mean", "rolling_sum", "rolling_count", "lag(", "lead("), "lag_lead": ("lag(", "lead("), "lognormal": ("lognormal(",), "pareto": ("pareto(",),
    "proration": ("overlap_days", "prorate", "interval"), "seasonal": ("day_of_month", "day_of_week"),
}
CONDITIONS = ("where(", "if", "days(")


def constructs(spec: Dataset) -> set[str]:
    """What a spec has of the constructs that families ask for."""
    found = {"event"} if spec.events else set()
    for rule in spec.rules:
        kind = (rule.distribution or {}).get("kind")
        expression = str((rule.distribution or {}).get("expression", "")).lower()
        if kind in ("window", "lognormal", "pareto", "mixture", "zipf", "seasonal"):
            found.add(kind)
        found |= {name for name, parts in IN_EXPRESSIONS.items() if any(p in expression for p in parts)}
        if kind == "derived" and any(c in expression for c in CONDITIONS):
            found.add("condition")
    return found


def mentioned(text: Column) -> Column:
    """An array of (family, keywords): every family of which a text holds a keyword, letters of either case alike."""
    low = F.lower(text)
    any_of = "|".join(sorted({re.escape(k) for keywords, _ in FAMILIES.values() for k in keywords}))
    each = [F.struct(F.lit(f).alias("family"), F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)).alias("keywords")) for f, (keywords, _) in FAMILIES.items()]
    found = F.filter(F.array(*each), lambda x: F.size(x["keywords"]) > 0)
    return F.when(low.rlike(any_of), found).otherwise(F.array().cast("array<struct<family:string,keywords:array<string>>>"))


def mentions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, family, keywords): a row for each family a text mentions; null texts mention none."""
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(mentioned(F.col(text_col))).alias("m"))
    return rows.select("id", "m.family", "m.keywords")


def uncovered(texts: DataFrame, id_col: str, text_col: str, spec: Dataset) -> DataFrame:
    """(id, family, keywords, needs): mentioned families for which ``spec`` has no construct."""
    has = constructs(spec)
    rows = [(f, sorted(needs), bool(needs & has)) for f, (_, needs) in FAMILIES.items()]
    families = texts.sparkSession.createDataFrame(rows, "family string, needs array<string>, covered boolean")
    return mentions(texts, id_col, text_col).join(F.broadcast(families), "family").where("not covered").select("id", "family", "keywords", "needs")  # a row a family


def family_counts(texts: DataFrame, id_col: str, text_col: str, spec: Dataset) -> DataFrame:
    """(family, n, covered): how many texts mention each family, 0 included, and whether ``spec`` covers it."""
    has = constructs(spec)
    families = texts.sparkSession.createDataFrame([(f, bool(needs & has)) for f, (_, needs) in FAMILIES.items()], "family string, covered boolean")
    counts = mentions(texts, id_col, text_col).groupBy("family").agg(F.count("*").alias("n"))
    return families.join(counts, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"), "covered")
