"""Media columns in archives: a Spark data source over archive directories.

An archive is a ZIP file whose members are stored PNG images of 8-bit samples, 64 a row; its
central directory at the end lists names, offsets and lengths. ``write_archives`` lets every
task write archives into the shared folder. The data source ``media_archive`` plans its partitions
as shares of a listing of byte ranges, which Spark makes from the archives' sizes; a task reads
the directories of its archives, takes the members whose offset lies in its ranges and streams
their bytes in Arrow batches. A member that can't be read, or whose checksum is wrong, is read
again by its offset, on its own.

Files are reached through pyarrow's file systems by URI, so the shared folder may be any store.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftspark.llm.shared import fresh_path, written

WIDTH = 64
#: Bytes after which a task begins another archive, and bytes a partition of the source covers.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 32 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """The payload as a grey image of WIDTH samples a row, without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The payload of an image made by ``png``; ValueError where a checksum or the form is wrong."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body, shape = 8, b"", None
    while at + 8 <= len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + data)) != image[at + 8 + size : at + 12 + size]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another form of PNG")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], WIDTH + 1)
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and mean step between neighbours of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"{x.mean():.4f},{x.std():.4f},{-(share * np.log2(share)).sum():.4f},{step:.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Archive:
    """One archive being written: stored members, then the directory."""

    def __init__(self, uri: str) -> None:
        files, path = _filesystem(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.at, self.listing = uri, files.open_output_stream(path), 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: bytes, data: bytes) -> None:
        fixed = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(name), 0)
        self.listing.append((name, fixed, self.at))
        self._write(b"PK\3\4" + fixed + name)
        self._write(data)

    def close(self) -> tuple[str, int, int]:
        start = self.at
        for name, fixed, at in self.listing:
            self._write(b"PK\1\2" + struct.pack("<H", 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
        count = len(self.listing)
        # Archives stay far below the 64-bit limits; the count wraps as the format has 16 bits for it.
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count & 0xFFFF, count & 0xFFFF, self.at - start, start, 0))
        self.out.close()
        return self.uri, self.at, count


def write_archives(payloads: DataFrame, folder: str) -> DataFrame:
    """Writes (id, text) rows as media into archives; returns (archive, bytes, members).

    Every attempt of a task writes under names of its own, and only archives in the returned
    rows count, so lost or repeated attempts leave unread files at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        archive, closed, n = None, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if archive is None:
                    archive = _Archive(f"{stem}-{len(closed):04d}.zip")
                archive.add(f"{n}_{'' if key is None else key}_{len(data)}.png".encode(), png(padded(data)))
                n += 1
                if archive.at >= ARCHIVE_BYTES:
                    closed.append(archive.close())
                    archive = None
        if archive is not None:
            closed.append(archive.close())
        columns = list(zip(*closed, strict=True)) if closed else [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["archive", "bytes", "members"])

    return payloads.mapInArrow(run, "archive string, bytes long, members long")


class Share(InputPartition):
    """One share of the byte ranges in a listing."""

    def __init__(self, listing: str, number: int) -> None:
        self.listing, self.number = listing, number


def directory(file, size: int) -> list[tuple[bytes, int, int, int]]:
    """(name, offset, length, checksum) of the members of an archive, from its end."""
    tail = file.read_at(22, size - 22)
    sign, _, _, _, _, length, start, _ = struct.unpack("<4sHHHHIIH", tail)
    if sign != b"PK\5\6":
        raise ValueError("no archive directory")
    listing, at, out = file.read_at(length, start), 0, []
    while at < length:
        crc, _, stored, n_name, n_extra, n_note = struct.unpack("<IIIHHH", listing[at + 16 : at + 34])
        (offset,) = struct.unpack("<I", listing[at + 42 : at + 46])
        out.append((listing[at + 46 : at + 46 + n_name], offset, stored, crc))
        at += 46 + n_name + n_extra + n_note
    return out


def read_member(open_file, name: bytes, offset: int, length: int, crc: int, pause: float = 0.2) -> bytes:
    """A member's bytes; tried TRIES times, each time with a newly opened file."""
    for attempt in range(TRIES):
        try:
            file = open_file(attempt)
            data = file.read_at(length, offset + 30 + len(name))
            if len(data) == length and zlib.crc32(data) == crc:
                return data
            raise OSError(f"member {name!r} at {offset}: wrong checksum")
        except OSError:
            if attempt == TRIES - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    """Plans a partition for each share of the listing; the driver knows no more than their number."""

    def __init__(self, options: dict) -> None:
        self.listing, self.shares = options["listing"], int(options["shares"])

    def partitions(self) -> list[Share]:
        return [Share(self.listing, i) for i in range(self.shares)]

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        if partition is None:  # without archives, Spark still asks once
            return
        files, path = _filesystem(partition.listing)
        listing = ds.dataset(path, filesystem=files, format="parquet")
        own = listing.to_table(filter=ds.field("share") == partition.number).sort_by([("archive", "ascending"), ("start", "ascending")])
        uri, members = None, []
        for row in own.to_pylist():
            if row["archive"] != uri:
                uri = row["archive"]
                files, path = _filesystem(uri)
                members = directory(files.open_input_file(path), row["bytes"])
            yield from _members(files, path, uri, [m for m in members if row["start"] <= m[1] < row["end"]])


def _members(files, path: str, uri: str, members: list[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
    opened: list = []

    def open_file(attempt: int):
        if attempt or not opened:
            opened[:] = [files.open_input_file(path)]
        return opened[0]

    names, offsets, media, size = [], [], [], 0
    for name, offset, length, crc in members:
        data = read_member(open_file, name, offset, length, crc)
        names.append(name.decode())
        offsets.append(offset)
        media.append(data)
        size += length
        if size >= BATCH_BYTES:
            yield _batch(uri, names, offsets, media)
            names, offsets, media, size = [], [], [], 0
    if names:
        yield _batch(uri, names, offsets, media)


def _batch(archive: str, names: list, offsets: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([archive] * len(names)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())],
        names=["archive", "name", "offset", "media"],
    )


class MediaArchives(DataSource):
    """Format ``media_archive``. Options: ``listing``, a table of byte ranges (archive, bytes, start,
    end, share), and ``shares``, into how many shares it deals them."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, name string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def byte_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, bytes, start, end): the ranges of archives (archive, bytes, ...)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    ranges = archives.select("archive", "bytes", F.explode(starts).alias("start"))
    return ranges.withColumn("end", F.col("start") + range_bytes)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, name, offset, media): all members of the given archives (archive, bytes, ...).

    Their byte ranges are written as a listing beside the archives, numbered in the order of the
    archives (one row for RANGE_BYTES goes through that window); a share is one range.
    """
    spark = archives.sparkSession
    spark.dataSource.register(MediaArchives)
    ranges = written(byte_ranges(archives, range_bytes), "media-ranges")
    shares = ranges.count()
    if not shares:
        return spark.createDataFrame([], "archive string, name string, offset long, media binary")
    listing = fresh_path(spark, "media-listing")
    dealt = ranges.withColumn("share", F.row_number().over(W.orderBy("archive", "start")) - 1)
    dealt.repartitionByRange("share").sortWithinPartitions("share").write.parquet(listing)
    return spark.read.format("media_archive").option("listing", listing).option("shares", shares).load()


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored form shows: payload and media lengths, digests, feature."""
    import hashlib

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                _, key, n_bytes = name.removesuffix(".png").split("_")
                payload = samples(image)
                rows.append((
                    int(key) if key else None, int(n_bytes), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload),
                ))
            types = [pa.string() if n.endswith("sha256") or n == "feature" else pa.int64() for n in names]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return media.select("name", "media").mapInArrow(run, schema)


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text of ``docs`` as media in archives, reads them back and describes them.

    * A null or empty text is stored as WIDTH samples 0, with n_bytes 0.
    * Ids may be null or repeated: every row is a member of its own. Other columns are not looked at.
    * Very long texts are members like others; a member is held whole in memory.
    * An empty table writes no archive and gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    made = written(write_archives(rows, fresh_path(spark, "media")), "media-archives")
    return media_features(read_archives(made))
