"""Fill-in-middle transformation: texts cut at unit boundaries, their pieces put in another order.

A unit grammar says where a unit ends by the two characters about the cut: the one before is of
one class, the one behind of another. As a regular expression that is a boundary without width,
``(?<=[before])(?=[behind])``, at which Spark's ``split`` cuts without losing a character. A
boundary has a character on both sides, so no piece is empty; an empty text would still split
into one empty piece, and has its own branch with no piece at all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels of the output: prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Grammar(NamedTuple):
    """``unit``: the units as a pattern of whole matches, left to right; ``before`` and ``behind``:
    the classes of the characters about a cut between two units. Both state the same units."""

    unit: str
    before: str
    behind: str


_ANY, _WS = r"\s\S", r"\x20\x09-\x0D"
GRAMMARS = {
    "line": Grammar(r"[^\n]*\n|[^\n]+", r"\n", _ANY),
    "word": Grammar(rf"[^{_WS}]+[{_WS}]*|[{_WS}]+", _WS, rf"^{_WS}"),
    "sentence": Grammar(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", r".!?\n", r"^.!?\n"),
    "char": Grammar(rf"[{_ANY}]", _ANY, _ANY),
}


def boundary(grammar: Grammar) -> str:
    """The zero-width pattern (Java) between two units."""
    return rf"(?<=[{grammar.before}])(?=[{grammar.behind}])"


def pieces(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _drawn(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers of an id, from SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _between(text: Column, left: str, right: str) -> Column:
    """What stands between two sentinels, each of which the text holds once."""
    return F.substring_index(F.substring_index(text, right, 1), left, -1)


def restore(output: Column, form: Column) -> Column:
    """The text, from its output and form."""
    middle = F.substring_index(output, MIDDLE, -1)
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def fill_in_middle(docs: DataFrame, grammar: str | Grammar = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for every row of ``docs``.

    Of ``n`` units two cuts are drawn by the id. ``rate`` percent of the texts are transformed,
    of these ``spm_rate`` percent with the suffix first (spm), the others prefix first (psm).

    * A null text counts as empty. Empty texts, and texts that hold a sentinel, are plain: their
      output is the text, and prefix, middle and suffix are null.
    * Draws hang on the id alone, so rows that repeat an id and a text get equal results. A null
      id is drawn as the empty string.
    * Cuts may coincide or lie at an end: then prefix, middle or suffix is empty.
    * Very long texts are split whole in one row. Other columns, whatever their names, are not
      looked at. An empty table gives an empty table.
    """
    grammar = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.select("doc_id", "text", pieces(F.col("text"), grammar).alias("units"))
    h1, h2, h3, h4 = _drawn(F.col("doc_id"), seed)
    n = F.size("units").cast("long")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    drawn = cut.select("*", n.alias("n"), form.alias("form"), (h1 % (n + 1)).cast("int").alias("c1"), (h2 % (n + 1)).cast("int").alias("c2"))
    first, last = F.least("c1", "c2"), F.greatest("c1", "c2")

    def joined(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))

    parts = drawn.select(
        "doc_id", "text", "n", "form", joined(F.lit(0), first).alias("prefix"),
        joined(first, last - first).alias("middle"), joined(last, F.size("units") - last).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(mark), part) for mark, part in ((PREFIX, F.col("prefix")), (SUFFIX, F.col("suffix")), (MIDDLE, F.col("middle"))))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
