"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over text features, fitted on a bounded sample of labelled rows, gives
each document its evidence. Sums of its probabilities per host and per path make beta
posteriors: a path is shrunk toward its host, a host toward the global rate, the more the
fewer documents it has; how strongly, the spread between hosts (paths) tells. A document's
posterior is its own evidence on top of the prior of its site, from which it is left out.

Features are Column expressions. Sites are grouped aggregates, two numbers a site; the table
of sites is written, so Spark knows its size and broadcasts it only below its threshold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import UPPER, join_null_safe, written

SYMBOLS = "*#$%&|<>{}[]=+_~^@\\"
DIGITS = "0123456789"
FEATURES = ("chars", "upper", "digits", "symbols", "bangs", "word_kinds", "line_kinds", "word_length", "lines")
#: Log-odds are kept within this.
MOST = 30.0


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_q_x``, an array of the features in the order of FEATURES."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = "A" * len(UPPER) + "0" * len(DIGITS) + "#" * len(SYMBOLS)
    df = docs.withColumns({
        "_q_t": F.translate(text, UPPER + DIGITS + SYMBOLS, marks),
        "_q_w": F.split(text, r"[\x20\x09-\x0D]+"),
        "_q_l": F.split(text, "\n"),
    })
    df = df.withColumns({
        "_q_n": F.greatest(F.char_length("_q_t"), F.lit(1)).cast("double"),
        "_q_nw": F.size("_q_w").cast("double"),
        "_q_nl": F.size("_q_l").cast("double"),
    })
    n = F.col("_q_n")
    share = lambda mark: (n - F.char_length(F.replace(F.col("_q_t"), F.lit(mark), F.lit("")))) / n
    x = F.array(
        F.log(n), share("A"), share("0"), share("#"), share("!"),
        F.size(F.array_distinct("_q_w")) / F.col("_q_nw"), F.size(F.array_distinct("_q_l")) / F.col("_q_nl"),
        F.least(n / F.col("_q_nw"), F.lit(100.0)), F.log("_q_nl"),
    )
    return df.withColumn("_q_x", x).drop("_q_t", "_q_w", "_q_l", "_q_n", "_q_nw", "_q_nl")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, float]:
    """Weights (constant first) over the features, and the log-odds of the label in the sample.

    The sample is the ``sample`` labelled ids of least hash: a bound on what reaches the driver.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_q_id"), F.col(label_col).cast("double").alias("_q_y")
    )
    ids = ids.orderBy(F.xxhash64("_q_id"), "_q_id", "_q_y").limit(sample)
    rows = with_features(docs.select(F.col(id_col).alias("_q_id"), F.col(text_col)).join(F.broadcast(ids), "_q_id"), text_col)
    rows = rows.orderBy(F.xxhash64("_q_id"), "_q_id", "_q_y", "_q_x")  # repeated ids can go beyond the bound
    data = rows.select("_q_y", "_q_x").limit(2 * sample).toPandas()
    y = data["_q_y"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(FEATURES) + 1), 0.0
    x = np.stack(data["_q_x"].to_list()).astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums shall not differ
    x, y = x[order], y[order]
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.5] * len(FEATURES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -MOST, MOST)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / deviation
    return np.concatenate([[w[0] - (slopes * mean).sum()], slopes]), math.log(y.mean() / (1 - y.mean()))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(rate: float, n: float, squares: float, groups: float) -> float:
    """Pseudo-documents of a beta prior of mean ``rate``, by moments.

    ``squares``: sum over groups of size * (mean - prior mean)^2. The spread that sampling
    alone gives, about rate * (1 - rate) a group, is taken off.
    """
    noise = rate * (1 - rate)
    between = max((squares - noise * max(groups - 1, 0)) / max(n, 1.0), 1e-9)
    return min(max(noise / between - 1, 1.0), 1e4)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    sample: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """All columns of ``docs`` with ``evidence`` (log-odds of the text alone), ``site_prior``,
    ``posterior`` and ``keep`` (posterior >= threshold).

    * A null or empty text has features like any other and is judged by them.
    * Null hosts and paths are sites like others. Ids may be null or repeated: rows are judged
      one by one; a repeated label counts as often as it stands.
    * Without labels of both classes the evidence is 0 and the prior decides: all are kept.
    * An empty table gives an empty table.
    """
    weights, base = fit(docs, labels, id_col, text_col, label_col, sample)
    made = ("evidence", "site_prior", "posterior", "keep")
    names = [c for c in docs.columns if c not in made]
    score = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        score = score + F.get("_q_x", F.lit(i)) * float(w)
    scored = with_features(docs.select(*names), text_col).withColumns({
        "evidence": F.least(F.greatest(score, F.lit(-MOST)), F.lit(MOST)),
        "_q_host": F.col(host_col), "_q_path": F.col(path_col),
    }).drop("_q_x").withColumn("_q_p", 1 / (1 + F.exp(-F.col("evidence"))))

    paths = written(scored.groupBy("_q_host", "_q_path").agg(F.count("*").alias("_q_n"), F.sum("_q_p").alias("_q_s")), "quality-paths")
    hosts = paths.groupBy("_q_host").agg(F.sum("_q_n").alias("_q_hn"), F.sum("_q_s").alias("_q_hs"))
    n, s = paths.agg(F.sum("_q_n"), F.sum("_q_s")).first()
    rate = min(max((s or 0.0) / (n or 1), 1e-6), 1 - 1e-6)
    off = lambda s, n, m: n * F.pow(s / n - m, F.lit(2.0))
    squares, groups = hosts.agg(F.sum(off(F.col("_q_hs"), F.col("_q_hn"), F.lit(rate))), F.count("*")).first()
    k_host = _strength(rate, n or 0, squares or 0.0, groups)
    hosts = hosts.withColumn("_q_hm", (F.col("_q_hs") + k_host * rate) / (F.col("_q_hn") + k_host))
    sites = join_null_safe(paths, hosts.select("_q_host", "_q_hm"), ["_q_host"])
    squares, groups = sites.agg(F.sum(off(F.col("_q_s"), F.col("_q_n"), F.col("_q_hm"))), F.count("*")).first()
    k_path = _strength(rate, n or 0, squares or 0.0, groups)
    sites = written(sites, "quality-sites")

    judged = join_null_safe(scored, sites, ["_q_host", "_q_path"])
    others = (F.col("_q_s") - F.col("_q_p") + k_path * F.col("_q_hm")) / (F.col("_q_n") - 1 + k_path)
    judged = judged.withColumn("site_prior", F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)))
    odds = F.col("evidence") - base + _logit(F.col("site_prior"))
    judged = judged.withColumn("posterior", 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-MOST)), F.lit(MOST)))))
    return judged.select(*names, *made[:3], (F.col("posterior") >= threshold).alias("keep"))
