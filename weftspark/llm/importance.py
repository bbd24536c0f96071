"""Target-distribution importance resampling by hashed n-gram features.

Every partition of texts goes through a DuckDB connection of its own: SQL unnests the words,
a window puts 1, 2 and 3 consecutive ones together, a registered function takes the CRC-32 of
each, and a grouping counts a row's buckets. These counts are spilled to Parquet, with one more
row of sums for each task, so texts are read once. Spark merges the sums of both corpora to one
gain a bucket, scores the spilled counts by the gains and draws the highest scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.llm.shared import LOWER, UPPER, Scratch

#: A word of a text whose A-Z are lower-cased: digits, a-z and what is not ASCII. (Fixed value.)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of texts that one SQL query takes, and words of a piece of a longer text.
SLICE_BYTES, PIECE_WORDS = 1 << 19, 50_000
MEMORY = "500MB"

_COUNTS = f"""
with texts as (select row, own, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from piece),
words as (select row, own, least(len(w), own) as n_words, unnest(w) as w, unnest(range(len(w))) as pos from texts),
runs as (
  select row, own, n_words, pos, w, lead(w) over along as w2, lead(w, 2) over along as w3
  from words window along as (partition by row order by pos)),
features as (select row, n_words, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) as feature from runs where pos < own),
counted as (
  select row, n_words, cast(crc32(feature) % $buckets as integer) as bucket, count(*) as n
  from features where feature is not null group by all)
select row, n_words, list(bucket) as bucket, list(n) as n from counted group by row, n_words order by row
"""


def _crc32(features: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of every string's UTF-8 bytes."""
    features = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    found = map(zlib.crc32, features.cast(pa.binary()).to_numpy(zero_copy_only=False))
    return pa.array(np.fromiter(found, np.uint32, len(features)))


class _Counter:
    """A DuckDB connection that counts buckets of pieces of texts."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.con = buckets, duckdb.connect()
        self.con.execute(f"set threads = 1; set memory_limit = '{MEMORY}'; set temp_directory = ''")
        self.con.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")

    def _counts(self, rows: list[int], own: int, texts: pa.Array) -> pa.Table:
        self.con.register("piece", pa.table({"row": pa.array(rows, pa.int64()), "own": pa.array([own] * len(rows), pa.int64()), "text": texts}))
        found = self.con.sql(_COUNTS.replace("$buckets", str(self.buckets))).to_arrow_table().combine_chunks()
        self.con.unregister("piece")
        return found

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Words and number of buckets of every text, and all their buckets and counts, row by row."""
        found = self._counts(list(range(len(texts))), 1 << 62, texts)
        words, length = np.zeros((2, len(texts)), np.int64)
        row, lists = found.column("row").to_numpy(), found.column("bucket").combine_chunks()
        words[row], length[row] = found.column("n_words").to_numpy(), pc.list_value_length(lists).to_numpy()
        return words, length, lists.flatten().to_numpy(), found.column("n").combine_chunks().flatten().to_numpy()

    def long(self, text: str, words: int, chars: int) -> tuple[np.ndarray, ...]:
        """The same of one text, whose pieces are counted one by one."""
        held, n_words = np.zeros(self.buckets, np.int64), 0
        for piece, own in cut(text, words, chars):
            found = self._counts([0], own, pa.array([piece]))
            held[found.column("bucket").combine_chunks().flatten().to_numpy()] += found.column("n").combine_chunks().flatten().to_numpy()
            n_words += found.column("n_words")[0].as_py()
        at = np.flatnonzero(held)
        return np.array([n_words]), np.array([len(at)]), at, held[at]


def cut(text: str, words: int, chars: int) -> list[tuple[str, int]]:
    """A long text as (piece, own): ``own`` words, so many or as many as reach ``chars``, and the two that come next."""
    out: list[tuple[str, int]] = []
    ended: list[list[int]] = []  # start, own, words that still belong to it
    start, own = None, 0
    for m in _RAW_WORD.finditer(text):
        for piece in ended:
            piece[2] -= 1
            if not piece[2]:
                out.append((text[piece[0] : m.end()], piece[1]))
        ended = [p for p in ended if p[2]]
        if start is None:
            start, own = m.start(), 0
        own += 1
        if own == words or m.end() - start >= chars:
            ended.append([start, own, 2])
            start = None
    out += [(text[p[0] :], p[1]) for p in ended]
    return out if start is None else [*out, (text[start:], own)]


def bucket_counts(docs: DataFrame, buckets: int, slice_bytes: int = SLICE_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(sums, doc_id, n_words, bucket, n): of every row (doc_id, text) its buckets and their counts,
    and of every task one row (``sums``) with those of all its rows."""

    def batch(sums: bool, ids: pa.Array, words, length, bucket, n) -> pa.RecordBatch:
        ends = pa.array(np.r_[0, np.cumsum(length)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (n, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([sums] * len(ids)), ids, pa.array(words, pa.int64()), *lists], names=["sums", "doc_id", "n_words", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = _Counter(buckets), np.zeros(buckets, np.int64)
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            ends = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())]
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + slice_bytes, "right")) - 1)
                if ends[stop] - ends[start] > slice_bytes:
                    found = count.long(texts[start].as_py(), piece_words, slice_bytes)
                else:
                    found = count.rows(texts.slice(start, stop - start))
                np.add.at(total, found[2], found[3])
                yield batch(False, ids.slice(start, stop - start), *found)
                start = stop
        at = np.flatnonzero(total)
        yield batch(True, pa.array([None], pa.int64()), [0], [len(at)], at, total[at])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "sums boolean, doc_id long, n_words long, bucket array<int>, n array<long>")


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the sums of all tasks."""
    each = counts.where("sums").select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).select("x.bucket", "x.n")
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(counts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the smoothed share in the target over that in the corpus)."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_merged(counts, "s"), "bucket", "left").join(_merged(target, "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    share = (F.col("t") + 1) * (F.lit(all_s) + buckets) / ((F.col("s") + 1) * (F.lit(all_t) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def _numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with ``number`` (from 1) in an order of all rows, and how many there are.

    Rows are range-partitioned by the whole order, so ties of its first column spread too. A row's
    number is its place in its partition and what the partitions before hold.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.keep(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sizes = scratch.keep(sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "sizes")
    number = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    out = placed.join(F.broadcast(sizes), "_part").select(*rows.columns, number.alias("number"))
    return out, sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``.

    ``weight`` sums the gains of a text's features, ``score`` adds Gumbel noise drawn by the id, so
    the highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the N
    rows with at least ``least_words`` words floor(percent * N / 100) get a rank, the others null.

    * A null or empty text, and one without words, has no feature: its weight is 0.
    * Ties of score go to the smaller id, nulls last, then to fewer features and lower weight;
      rows equal in all of these take the next ranks in any order.
    * Rows that repeat an id have the same noise. A null id is drawn as the empty string.
    * Texts over ``slice_bytes`` go through SQL in pieces of ``piece_words`` words, or of fewer that
      reach ``slice_bytes`` characters, and the two words that follow. Their counts are added: whole
      texts count, in memory that a piece bounds.
    * Other columns, whatever their names, are not looked at. Without ``docs`` the result is empty;
      without ``target`` its shares are even ones.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    corpus = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wished = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text"))
    counts, wanted = (scratch.keep(bucket_counts(df, buckets, slice_bytes, piece_words), name) for df, name in ((corpus, "counts"), (wished, "target")))
    gains = [r.gain for r in bucket_gains(counts, wanted, buckets).orderBy("bucket").collect()]  # ``buckets`` numbers
    gain = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    weight = F.aggregate(F.zip_with("bucket", "n", lambda b, n: gain[b] * n), F.lit(0).cast("long"), lambda a, x: a + x)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    features = F.greatest(F.lit(0), F.col("n_words")) + F.greatest(F.lit(0), F.col("n_words") - 1) + F.greatest(F.lit(0), F.col("n_words") - 2)
    scored = counts.where("not sums").select("doc_id", "n_words", features.alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    scored = scratch.keep(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")), "scored")
    scratch.drop("counts", "target")

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    named = ["doc_id", "n_features", "weight", "score"]
    ranked, n = _numbered(scored.where(F.col("n_words") >= least_words).select(*named), order, scratch)
    ranked = ranked.select(*named, F.when(F.col("number") <= percent * n // 100, F.col("number")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*named, F.lit(None).cast("long").alias("rank")))
