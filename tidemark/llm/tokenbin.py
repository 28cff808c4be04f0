"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

A file is a header, the compressed documents one after the other, an offset index and a footer, all numbers
little-endian:

    header   8 bytes magic, 32 bytes SHA-256 of the dictionary
    frames   a zstandard frame per document: its ids as unsigned 32-bit integers
    index    per document: key (long), null flag (byte), start (long), ids (long), place and bytes of the frame (long)
    footer   place of the index (long), documents (long), 8 bytes magic

So a document is read with three small reads: footer, index, frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import files
from tidemark.llm.common import arrow_rows, column, staged
from tidemark.llm.tokens import encoder
from tidemark.plans.session import shared_dir

MAGIC = b"TKNBIN01"
HEADER = len(MAGIC) + 32
FOOTER = struct.Struct("<qq8s")
ENTRY = np.dtype([("key", "<i8"), ("null", "<u1"), ("start", "<i8"), ("ids", "<i8"), ("place", "<i8"), ("bytes", "<i8")])
END_ID = 2
DICTIONARY_BYTES = 64 * 1024
SAMPLE = 2000  # documents that the dictionary is trained on
SAMPLE_IDS = 4096  # ids of each of them
FILE_BYTES = 64 * 1024 * 1024  # a file is closed beyond this size
LEVEL = 3


def train_dictionary(samples: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of serialized id arrays; empty if there is too little to learn from."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


class Codec:
    """Compresses and restores id arrays with one dictionary."""

    def __init__(self, dictionary: bytes):
        shared = {}
        if dictionary:
            shared["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            shared["dict_data"].precompute_compress(level=LEVEL)  # else it is digested for every document
        self.hash = dictionary_hash(dictionary)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **shared).compress
        self.unpack = zstandard.ZstdDecompressor(**shared).decompress


class Writer:
    """Writes one file; ``start`` counts the ids of all documents before, from ``first`` on."""

    def __init__(self, folder: str, name: str, codec: Codec, first: int):
        self.address, self.stream = files.create(folder, name)
        self.codec, self.start, self.first = codec, first, first
        self.place = self.stream.write(MAGIC + codec.hash)
        self.entries: list[tuple] = []

    def add(self, key: int | None, ids: bytes) -> None:
        frame = self.codec.pack(ids)
        self.stream.write(frame)
        n = len(ids) // 4
        self.entries.append((key or 0, key is None, self.start, n, self.place, len(frame)))
        self.place += len(frame)
        self.start += n

    def close(self) -> tuple[str, int, int, int]:
        """Address, documents, ids and bytes of the file."""
        index = np.array(self.entries, ENTRY).tobytes()
        self.stream.write(index + FOOTER.pack(self.place, len(self.entries), MAGIC))
        self.stream.close()
        return self.address, len(self.entries), self.start - self.first, self.place + len(index) + FOOTER.size


class Reader:
    """Reads one file: all documents in order, or one by its number in the file."""

    def __init__(self, address: str, dictionary: bytes):
        self.codec = Codec(dictionary)
        self.file = files.open_random(address)
        if self.file.read(HEADER) != MAGIC + self.codec.hash:
            raise ValueError(f"{address}: no token file, or written with another dictionary")
        self.file.seek(self.file.size() - FOOTER.size)
        self.place, self.count, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{address}: cut off")

    def index(self) -> np.ndarray:
        self.file.seek(self.place)
        return np.frombuffer(self.file.read(self.count * ENTRY.itemsize), ENTRY)

    def document(self, number: int) -> tuple[np.void, bytes]:
        """Index entry and ids of one document, without reading the others."""
        self.file.seek(self.place + number * ENTRY.itemsize)
        entry = np.frombuffer(self.file.read(ENTRY.itemsize), ENTRY)[0]
        return entry, self._ids(entry)

    def _ids(self, entry: np.void) -> bytes:
        self.file.seek(int(entry["place"]))
        ids = self.codec.unpack(self.file.read(int(entry["bytes"])))
        if len(ids) != 4 * entry["ids"]:
            raise ValueError("a document is not as long as its index says")
        return ids

    def __iter__(self) -> Iterator[tuple[np.void, bytes]]:
        for entry in self.index():
            yield entry, self._ids(entry)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
) -> tuple[DataFrame, bytes]:
    """Write all texts to token files in ascending order of the key; the list of files and the dictionary.

    Files (address, task, number, documents, ids, bytes, before): ``before`` is the number of ids in
    all earlier files. Within a file starts count from its first document, so files are written
    without knowing the others. NULL keys come first; equal keys are ordered by text. Text NULL is
    empty: the end id alone. An empty table gives no files.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).alias("text"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids = [own[: 4 * SAMPLE_IDS] for own in encode.many(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    chosen = rows.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("order"), "doc_id")
    limit = chosen.orderBy("order").limit(SAMPLE).agg(F.max("order")).first()[0]
    # At most SAMPLE documents unless hashes collide, of SAMPLE_IDS ids each.
    sample = rows.filter(F.xxhash64("doc_id", "text") <= (limit or 0)).filter("text IS NOT NULL").limit(SAMPLE)
    found = sample.mapInArrow(ids_of, "ids binary").collect()
    dictionary = train_dictionary(sorted(bytes(r["ids"]) for r in found))
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(tokenizer), Codec(shared.value)
        task = TaskContext.get().partitionId()
        done: list[tuple] = []
        writer = None
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for name, own in zip(keys, encode.many(batch.column("text").to_pylist()), strict=True):
                if writer is None:
                    writer = Writer(folder, f"tokens-{task:06d}", codec, 0)
                writer.add(name, own + end)
                if writer.place > FILE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        address, n, ids, size = zip(*done, strict=True) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(address, pa.string()), pa.array([task] * len(done), pa.int32()),
                pa.array(range(len(done)), pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(size, pa.int64()),
            ],
            names=["address", "task", "number", "documents", "ids", "bytes"],
        )

    # The range bounds come from the keys alone; nothing is encoded for them.
    with arrow_rows(spark, 2000):
        listed = staged(
            rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
                write, "address string, task int, number int, documents long, ids long, bytes long"
            ),
            "files",
        )
    # A line per file of up to FILE_BYTES; the driver adds up one number for each task.
    sums = listed.groupBy("task").agg(F.sum("ids").alias("ids")).orderBy("task").collect()
    before, at = [], 0
    for row in sums:
        before.append((row["task"], at))
        at += row["ids"]
    earlier = spark.createDataFrame(before, "task int, task_before long")
    own = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (
        listed.join(F.broadcast(earlier), "task")
        .withColumn("before", F.col("task_before") + F.coalesce(F.sum("ids").over(own), F.lit(0)))
        .drop("task_before"),
        dictionary,
    )


def read_tokens(spark: SparkSession, listed: DataFrame, dictionary: bytes) -> DataFrame:
    """Rows (doc_id, start, ids) of the files, ``ids`` as little-endian unsigned 32-bit integers."""
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, before in zip(
                batch.column("address").to_pylist(), batch.column("before").to_pylist(), strict=True
            ):
                keys, starts, ids, size = [], [], [], 0
                for entry, own in Reader(address, shared.value):
                    keys.append(None if entry["null"] else int(entry["key"]))
                    starts.append(before + int(entry["start"]))
                    ids.append(own)
                    size += len(own)
                    if size > 16 << 20:
                        yield _batch(keys, starts, ids)
                        keys, starts, ids, size = [], [], [], 0
                yield _batch(keys, starts, ids)

    return listed.select("address", "before").repartition(max(1, listed.count())).mapInArrow(
        run, "doc_id long, start long, ids binary"
    )


def _batch(keys: list, starts: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "ids"],
    )


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and read them back."""
    spark = docs.sparkSession
    listed, dictionary = write_tokens(docs, tokenizer, shared_dir(spark, "tokens"), key, text)
    return read_tokens(spark, listed, dictionary)
