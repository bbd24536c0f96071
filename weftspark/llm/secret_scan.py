"""Secret scans: fixed patterns, and a randomness test battery for token-like strings.

Base spans come from three patterns. The method then looks at every long token that holds
letters and digits and overlaps no base span, infers its encoding, and puts it through three
tests: chi-squared uniformity of the symbols over that alphabet, number of runs of its two
halves (digits and capitals, small letters), and lag-1 serial correlation.

Each test is asked two things. Does the token differ from a random string? If one test says so,
it is none. Could it be a natural one, a name or an identifier? There the null is a natural
token, whose symbols are as uneven or whose halves change as seldom as those of words; the greater
of the two p-values stands for both, and a Benjamini-Hochberg step over all tokens of the corpus,
weighted by length, says which ones are no natural tokens. These are reported as spans of kind
``random``, so what the step bounds is the share of natural tokens among them.

Everything is Column expressions; what is gathered for the step is a histogram of p-values of
at most P_BINS rows. Work on a text grows with its length, however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, as Java patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Base kinds in the order in which spans with one start are listed, then the method's kind.
KINDS = ("assign", "access", "hex", "random")

#: A token for the battery: long, of one of the alphabets, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
_LOWER, _CAPITAL, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings in the order in which they are tried: the two halves of the alphabet,
# a pattern, and how uneven natural symbols are: k * sum(q^2) - 1, with the sum over the letters
# of English words (0.066; 0.048 with a capital in six letters) or, for the hexadecimal ones, over
# decimal digits (0.1).
ENCODINGS = (
    ("hex", _DIGIT, "abcdef", r"^[0-9a-f]+$", 0.6),
    ("HEX", _DIGIT, "ABCDEF", r"^[0-9A-F]+$", 0.6),
    ("base32", "234567", _CAPITAL, r"^[A-Z2-7]+$", 1.1),
    ("base36", _DIGIT, _LOWER, r"^[0-9a-z]+$", 1.4),
    ("base62", _DIGIT + _CAPITAL, _LOWER, r"^[0-9A-Za-z]+$", 2.0),
    ("base64", _DIGIT + _CAPITAL + "+/-_", _LOWER, r"^[0-9A-Za-z+/_-]+$", 2.1),
)
#: A natural token goes over to the other half at this share of the places where a random one does.
SELDOM = 0.4
#: A token for which a test of randomness has a p-value below this is not random.
VETO = 0.001
P_BINS, BINS_PER_HALVING = 1024, 16
#: Matches of a text up to which their places are added up one by one; beyond, a mask of the text
#: tells them, which costs the same for any number.
FEW = 64


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, even where ``use`` reads it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end) in code points.

    The pieces between matches give the places: start k is the length of the first k + 1
    pieces and the first k matches. ``least``: matches whose ``group`` is shorter are dropped.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else found
    steps = F.arrays_zip(
        F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(found)).alias("skip"),
        F.transform(found, F.char_length).alias("len"),
        F.transform(inner, F.char_length).alias("inner"),
    )
    none = F.array().cast("array<struct<start:int,len:int,inner:int>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def placed(start: Column, x: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), x["len"].alias("len"), x["inner"].alias("inner"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(placed(start, x))).alias("out"))

    # A byte per code point, 1 where a match starts: a look-up by position costs the same anywhere.
    marks = F.transform(steps, lambda x: F.concat(F.repeat(F.lit("0"), x["skip"]), F.lit("1"), F.repeat(F.lit("0"), x["len"] - 1)))
    mask = F.array_join(marks, "").cast("binary")
    all_places = lambda m: F.sequence(F.lit(0), F.octet_length(m) - 1)
    starts = _once(mask, lambda m: F.filter(all_places(m), lambda i: F.substring(m, i + 1, F.lit(1)) == F.lit(b"1")))
    few = F.aggregate(steps, empty, step, lambda acc: acc["out"])
    places = F.when(F.size(found) <= FEW, few).otherwise(F.zip_with(starts, steps, placed))
    places = F.when(F.regexp_like(text, F.lit(pattern)), places).otherwise(none)
    if least:
        places = F.filter(places, lambda x: x["inner"] >= least)
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + x["len"]).alias("end")))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that no span of one base kind overlaps; both in the order of their starts.

    The spans of a kind as a mask: a byte per code point up to the last one's end, 1 inside.
    """
    before = lambda b, i: F.when(i > 0, F.get(b, i - 1)["end"]).otherwise(F.lit(0))
    ones = lambda s: F.repeat(F.lit("1"), s["end"] - s["start"])
    runs = _once(base, lambda b: F.transform(b, lambda s, i: F.concat(F.repeat(F.lit("0"), s["start"] - before(b, i)), ones(s))))
    mask = F.array_join(runs, "").cast("binary")
    inside = lambda m, s: F.substring(m, s["start"] + 1, s["end"] - s["start"]).cast("string")
    free = _once(mask, lambda m: F.filter(tokens, lambda s: ~F.contains(inside(m, s), F.lit("1"))))
    return F.when(F.size(base) > 0, free).otherwise(tokens)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to 7.5e-8 (the polynomial of Abramowitz and Stegun, 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + a * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(encoding: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(encoding == name, F.lit(value)).otherwise(out)
    return out


def battery(tokens: Column) -> Column:
    """Over an array of structs with a field ``token``: adds encoding, length and p-values.

    p_uniform, p_runs and p_serial are small where the token is no random string; ``p`` is small
    where it is no natural one either, and 1 where one of the three is below VETO.
    """
    letters = {name: a + b for name, a, b, _, _ in ENCODINGS}
    halves = {name: "0" * len(a) + "1" * len(b) for name, a, b, _, _ in ENCODINGS}

    def encoding(x: Column) -> Column:
        out = F.lit(ENCODINGS[-1][0])
        for name, _, _, pattern, _ in reversed(ENCODINGS[:-1]):
            out = F.when(F.regexp_like(x["token"], F.lit(pattern)), F.lit(name)).otherwise(out)
        return out

    def bits(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, own in letters.items():
            out = F.when(x["encoding"] == name, F.translate(x["token"], own, halves[name])).otherwise(out)
        return out

    def squares(x: Column) -> Column:  # of the symbols' counts
        count = lambda c: x["length"] - F.char_length(F.replace(x["token"], c, F.lit("")))
        return F.aggregate(F.array_distinct(x["symbols"]), F.lit(0.0), lambda acc, c: acc + F.pow(count(c).cast("double"), F.lit(2.0)))

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def z_chi(x: Column) -> Column:  # the cube-root rule of Wilson and Hilferty
        v = 2 / (9 * (x["k"] - 1))
        return (F.pow(x["chi"] / (x["k"] - 1), F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)

    def z_runs(x: Column) -> Column:
        n, n1 = x["length"].cast("double"), x["ones"].cast("double")
        mean = 2 * n1 * (n - n1) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, F.abs(x["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.sqrt(n))

    def lag(x: Column) -> Column:
        last = x["length"] - 1
        pairs = F.zip_with(F.slice(x["away"], 1, last), F.slice(x["away"], 2, last), lambda a, b: a * b)
        return sums(pairs)

    def z_serial(x: Column) -> Column:
        n = x["length"].cast("double")
        return F.when(x["ss"] > 0, F.abs(x["lag"] / F.greatest(x["ss"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

    def natural_uniform(x: Column) -> Column:  # a smaller chi-squared than that of natural symbols, which is not central
        off = x["length"] * x["uneven"]
        return _upper_tail((x["k"] - 1 + off - x["chi"]) / F.sqrt(2 * (x["k"] - 1) + 4 * off))

    def natural_runs(x: Column) -> Column:  # more changes of the half than a natural token has
        places = x["length"] - 1
        return _upper_tail((x["runs"] - 1.5 - places * x["change"]) / F.sqrt(places * x["change"] * (1 - x["change"])))

    def combined(x: Column) -> Column:
        natural = F.greatest(x["natural_uniform"], x["natural_runs"])
        return F.when(F.least(x["p_uniform"], x["p_runs"], x["p_serial"]) < VETO, 1.0).otherwise(natural)

    share = {name: len(a) / len(a + b) for name, a, b, _, _ in ENCODINGS}
    fields = (
        ("encoding", encoding),
        ("length", lambda x: F.char_length(x["token"])),
        ("letters", lambda x: _pick(x["encoding"], letters)),
        ("k", lambda x: _pick(x["encoding"], {name: float(len(own)) for name, own in letters.items()})),
        ("uneven", lambda x: _pick(x["encoding"], {name: u for name, _, _, _, u in ENCODINGS})),
        ("change", lambda x: _pick(x["encoding"], {name: SELDOM * 2 * q * (1 - q) for name, q in share.items()})),
        ("symbols", lambda x: F.split(x["token"], "")),
        ("squares", squares),
        ("chi", lambda x: F.greatest(x["squares"] * x["k"] / x["length"] - x["length"], F.lit(0.0))),
        ("bits", bits),
        ("ones", lambda x: F.char_length(F.replace(x["bits"], F.lit("0"), F.lit("")))),
        ("runs", lambda x: F.char_length(F.regexp_replace(F.regexp_replace(x["bits"], "0+", "a"), "1+", "b"))),
        ("at", lambda x: F.transform(x["symbols"], lambda c: F.position(c, x["letters"]).cast("double"))),
        ("mean", lambda x: sums(x["at"]) / x["length"]),
        ("away", lambda x: F.transform(x["at"], lambda v: v - x["mean"])),
        ("ss", lambda x: F.aggregate(x["away"], F.lit(0.0), lambda acc, v: acc + v * v)),
        ("lag", lag),
        ("p_uniform", lambda x: _upper_tail(z_chi(x))),
        ("p_runs", lambda x: 2 * _upper_tail(z_runs(x))),
        ("p_serial", lambda x: 2 * _upper_tail(z_serial(x))),
        ("natural_uniform", natural_uniform),
        ("natural_runs", natural_runs),
        ("p", combined),
    )
    def adding(name: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: x.withField(name, value(x))

    for name, value in fields:
        tokens = F.transform(tokens, adding(name, value))
    work = ("letters", "k", "uneven", "change", "symbols", "squares", "chi", "bits", "ones", "runs", "at", "mean", "away", "ss", "lag")
    return F.transform(tokens, lambda x: x.dropFields(*work))


def length_weight(length: Column) -> Column:
    """Weight of a token's hypothesis: long tokens, whose tests have power, get more of alpha."""
    return F.when(length < 32, 0.5).when(length < 64, 1.0).otherwise(2.0)


def false_discovery_cut(tested: DataFrame, alpha: float) -> float:
    """Largest weighted p-value that the Benjamini-Hochberg step rejects, from a histogram.

    p / weight is rounded up to a bin (16 bins to a halving), so the cut is never too wide;
    weights are scaled to a mean of 1. Returns 0.0 where nothing is rejected.
    """
    w = length_weight(F.col("length"))
    halvings = F.floor(-F.log2(F.greatest(F.col("p") / w, F.lit(2.0**-63))) * BINS_PER_HALVING)
    at = F.greatest(F.least(halvings, F.lit(P_BINS - 1)), F.lit(-2 * BINS_PER_HALVING))
    bins = tested.where("p is not null").groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    rows = sorted((tuple(r) for r in bins.collect()), reverse=True)  # one row per bin
    total, weight = sum(r[1] for r in rows), sum(r[2] for r in rows)
    cut, below = 0.0, 0
    for b, n, _ in rows:
        below += n
        p = 2.0 ** (-b / BINS_PER_HALVING)
        if p * weight / total <= alpha * below / total:
            cut = p
    return cut


def token_spans(text: Column) -> Column:
    """Structs (start, rank, end, token) of the tokens to be tested."""
    spans = F.transform(
        _spans(text, TOKEN, 3), lambda s: s.withField("token", F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    )
    return F.filter(spans, lambda s: F.regexp_like(s["token"], F.lit("[0-9]")) & F.regexp_like(s["token"], F.lit("[A-Za-z]")))


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``base`` and ``_ss_tokens``, the tokens that no base span overlaps."""
    df = docs.withColumn("_ss_text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("_ss_text")
    df = df.withColumns({
        "_ss_0": _spans(text, ASSIGN, 0, group=2, least=12),
        "_ss_1": _spans(text, ACCESS, 1),
        "_ss_2": _spans(text, HEX, 2),
        "_ss_tokens": token_spans(text),
    })
    kinds = ("_ss_0", "_ss_1", "_ss_2")
    tokens = F.col("_ss_tokens")
    for kind in kinds:
        tokens = _apart(tokens, F.col(kind))
    tokens = F.when(F.size("_ss_tokens") > 0, tokens).otherwise(F.col("_ss_tokens"))
    return df.withColumns({"base": F.array_sort(F.concat(*kinds)), "_ss_tokens": tokens}).drop("_ss_text", *kinds)


def scan_secrets(docs: DataFrame, text_col: str = "text", alpha: float = 0.01) -> DataFrame:
    """All columns of ``docs`` and two arrays: ``base`` and ``found``, structs (start, rank, end).

    ``rank`` counts KINDS from 0; arrays are ordered by start, then rank. ``base`` holds the
    fixed patterns' spans, ``found`` also a ``random`` span for every token that overlaps no
    base span and that the battery takes for random, at most a share ``alpha`` of them wrongly
    as far as natural tokens are like its null.

    * A null or empty text has no spans. Ids are not looked at, so they may be null or repeated;
      rows repeated whole have equal spans, and count as often in the step.
    * Tokens without a letter or without a digit are not tested.
    * Very long texts are scanned whole, in time that grows with their length.
    * Other columns keep their names and values; ``base`` and ``found`` are replaced, and names
      that begin with ``_ss_`` are the operator's own.
    * An empty table gives an empty table.
    """
    tested = _with_spans(docs.select(F.col(text_col).alias("text")), "text")
    tested = tested.select(F.explode(battery(F.col("_ss_tokens"))).alias("t")).select("t.*")
    cut = false_discovery_cut(tested, alpha)

    df = _with_spans(docs, text_col)
    weighted = lambda t: t["p"] / length_weight(t["length"])
    secret = F.transform(
        F.filter(battery(F.col("_ss_tokens")), lambda t: weighted(t) <= cut),
        lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end")),
    )
    found = F.when(F.size("_ss_tokens") > 0, F.array_sort(F.concat("base", secret))).otherwise(F.col("base"))
    return df.withColumn("found", found).drop("_ss_tokens")


def listed(spans: Column | str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
