"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but 16-bit token ids, documents one after another, each ended by the
end-of-document id. ``write_token_files`` makes such files; ``scan_token_files`` counts without
any index: a file is cut into blocks at fixed byte places, each task searches its blocks for
the separator with one vectorised comparison, and a prefix scan over the blocks stitches what
blocks cut apart: the number of separators before a block numbers its documents, and the
tokens since the last separator before it belong to its first document.

A block yields a row per document that ends in it, and one row for the block; the prefix scan
runs over block rows, per file. Files are reached by URI through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.llm.shared import fresh_path, written

TOKEN = np.dtype("<u2")
#: Bytes of a block, and of a file after which a task begins another one.
BLOCK_BYTES, FILE_BYTES = 4 << 20, 256 << 20


@lru_cache(maxsize=4)
def encoder(ranks_path: str):
    """A byte-level BPE from a file of ranks; one per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _open(uri: str, out: bool):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if out:
        files.create_dir(path.rpartition("/")[0], recursive=True)
        return files.open_output_stream(path)
    return files.open_input_file(path)


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises ``docs`` (id, text) into files; returns (file, bytes, ordinal, doc_id) by document.

    Attempts write under names of their own, so a repeated task leaves unread files at most.
    A text never holds ``end_id``: the encoder has no special tokens.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, code = TaskContext.get(), encoder(ranks_path)
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([end_id], TOKEN).tobytes()
        out, size, ordinal, number = None, 0, 0, 0
        for batch in batches:
            keys, names, ordinals = batch.column(0), [], []
            for text in batch.column(1):
                if out is None:
                    uri = f"{stem}-{number:04d}.tokens"
                    out, size, ordinal, number = _open(uri, True), 0, 0, number + 1
                data = np.array(code.encode_ordinary(text.as_py()), TOKEN).tobytes() + end
                out.write(data)
                size += len(data)
                names.append(uri)
                ordinals.append(ordinal)
                ordinal += 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), keys], names=["file", "ordinal", "doc_id"]
            )
        if out is not None:
            out.close()

    return rows.mapInArrow(run, "file string, ordinal long, doc_id long")


def block_plan(spark: SparkSession, files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block): the blocks of each file of ``files`` (file, tokens or more columns)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            lengths = [_open(uri, False).size() for uri in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["file", "bytes"])

    sized = files.select("file").mapInArrow(sizes, "file string, bytes long").where("bytes > 0")
    last = F.floor((F.col("bytes") - 1) / block_bytes).cast("int")
    return sized.select("file", F.explode(F.sequence(F.lit(0), last)).alias("block"))


def scan_token_files(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens): tokens of every document of the files, the separator not counted.

    ``files`` has a column ``file`` of URIs. Documents are numbered from 0 in each file. Tokens
    behind the last separator are a document that was not ended: it is listed if it has any.
    """
    if block_bytes % TOKEN.itemsize:
        raise ValueError("a block holds whole tokens")
    spark = files.sparkSession
    blocks = block_plan(spark, files, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block one row: lengths of the documents that end in it, and of what is left over.
        The first length lacks what earlier blocks hold of that document."""
        for batch in batches:
            lengths, ends, tails = [], [], []
            for uri, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(uri, False) as file:
                    file.seek(block * block_bytes)
                    tokens = np.frombuffer(file.read(block_bytes), TOKEN)
                at = np.flatnonzero(tokens == end_id)
                lengths.append(np.diff(at, prepend=-1) - 1)
                ends.append(len(at))
                tails.append(len(tokens) - (at[-1] + 1 if len(at) else 0))
            offsets = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(ends, out=offsets[1:])
            flat = pa.array(np.concatenate(lengths) if lengths else np.empty(0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(ends, pa.int64()), pa.array(tails, pa.int64())],
                names=["file", "block", "lengths", "ends", "tail"],
            )

    found = blocks.mapInArrow(search, "file string, block int, lengths array<long>, ends long, tail long")
    found = written(found, "token-blocks")
    # The scan: documents ended before a block, and tokens since the last separator before it.
    order = W.partitionBy("file").orderBy("block")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    scan = found.select("file", "block", "ends", "tail").withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(upto))
    # Within a run of blocks that starts at one with a separator, tails add up.
    held = F.sum("tail").over(W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    scan = scan.withColumn("held", held)
    scan = scan.select(
        "file", "block", "held",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.lag("held").over(order), F.lit(0)).alias("carried"),
        (F.lead("block").over(order).isNull()).alias("last"),
    )
    placed = found.join(scan, ["file", "block"])
    whole = placed.select("file", "ended", "carried", F.posexplode("lengths").alias("i", "n")).select(
        "file", (F.col("ended") + F.col("i")).alias("ordinal"),
        (F.col("n") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"),
    )
    rest = placed.where("last and held > 0").select("file", (F.col("ended") + F.col("ends")).alias("ordinal"), F.col("held").alias("n_tokens"))
    return whole.union(rest)


def count_tokens(docs: DataFrame, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal): writes ``docs`` as token files and counts by scanning them.

    * A null or empty text has 0 tokens. Ids may be null or repeated: every row is a document.
    * Very long texts are encoded whole, and their tokens may span blocks. Other columns, whatever
      their names, are not looked at.
    * An empty table writes no file and gives an empty table.
    """
    spark = docs.sparkSession
    listing = written(write_token_files(docs, fresh_path(spark, "tokens"), ranks_path, end_id, id_col, text_col), "token-listing")
    counts = scan_token_files(listing.select("file").distinct(), end_id, block_bytes)
    return listing.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
