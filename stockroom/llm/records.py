r"""Token ids in length-delimited binary records, with a separate offset index.

A data file is a row of records::

    length of the payload   8 bytes, little-endian
    masked checksum of it   4 bytes: CRC-32 of the 8 bytes, rotated right by 15, plus a constant
    payload
    masked checksum of it   4 bytes

The payload holds a flag byte (1: the document has a key, 2: ids are 4 bytes wide, else
2), the key (8 bytes) and the ids, little-endian.  Documents are range-partitioned by key,
so files and records follow ascending keys; every task streams its partition into files of
at most ``FILE_BYTES`` (or one record).  The index is a Parquet table with file, offset
and length of every record.  It is also the commit: a task that is run again writes files
of other names, and only the files that the index names belong to the set.

``read_records`` reads whole files in order, ``read_shuffled`` single records by the
index, in the order of a keyed hash.  Both verify both checksums of every record.

Texts are encoded by the tokenizers library from a vocabulary file (its path is a
parameter): every distinct pre-token once per task, and as whole texts where a text has
characters whose class depends on the library's Unicode version or one of the
vocabulary's special strings.  A task keeps the ids of a bounded number of pre-tokens;
others are encoded again, so the bound changes no ids.

Defined results: a null or empty text has the end id alone; a null key comes first; rows
of equal key follow the order of their texts' hash; repeated rows each have a record; an
empty table gives an empty set; other input columns are not read.  Rows equal in key and
text share one partition (streamed, in bounded memory).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.llm.common import few
from stockroom.llm.tokens import byte_symbols
from stockroom.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FILE_BYTES = 256 * 1024 * 1024
CACHE_WORDS = 600_000
# Records handed to Spark at a time, and the ids (in bytes) they may hold.
BATCH_RECORDS, BATCH_BYTES = 5_000, 16 * 1024 * 1024
# Tasks that read, at most; a task reads several files beyond that.
READ_TASKS = 20_000
# Files whose totals are broadcast; above it they are joined by a shuffle.
FILES_BROADCAST = 100_000

# Fixed values of the format.
HAS_KEY, WIDE = 1, 2
MASK_ADD = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
KEY = struct.Struct("<Bq")

# The byte-level splitting rule, with its classes spelled out for the characters up to
# U+017F, on which all Unicode versions agree.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\\t-\\r \x85\xa0"
_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
                    f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_BEYOND = re.compile("[ƀ-\U0010ffff]")


def masked(data: bytes) -> int:
    """CRC-32, masked: a checksum stored beside checksummed data is not one of its own data."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def unframe(read, where: str) -> bytes | None:
    """The next payload of ``read(n)``, None at the end; raises if a byte is wrong."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError(f"{where}: cut off in a record's length")
    length, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError(f"{where}: wrong checksum of a record's length")
    body = read(length + TAIL.size)
    if len(body) < length + TAIL.size or masked(body[:length]) != TAIL.unpack(body[length:])[0]:
        raise ValueError(f"{where}: wrong checksum of a record")
    return body[:length]


def payload(key: int | None, ids: bytes, width: int) -> bytes:
    return KEY.pack((WIDE if width == 4 else 0) | (0 if key is None else HAS_KEY), key or 0) + ids


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """Key and ids of a payload."""
    flags, key = KEY.unpack_from(data)
    ids = np.frombuffer(data, dtype="<u4" if flags & WIDE else "<u2", offset=KEY.size)
    return (key if flags & HAS_KEY else None), ids


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.width = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        split = spec["pre_tokenizer"]
        self.by_words = (split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
                         and spec["normalizer"] is None)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        # the same model over words that are split and mapped to byte symbols already
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", behavior="removed")
        self.words.no_truncation()
        self.words.no_padding()
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 2_000):
            part = new[i:i + 2_000]
            line = "\n".join(w.encode("utf-8").decode("latin-1").translate(self.symbols) for w in part)
            got = self.words.encode(line, add_special_tokens=False)
            ids = np.array(got.ids, dtype=self.width).tobytes()
            ends = np.cumsum(np.bincount(got.word_ids, minlength=len(part))) * self.width.itemsize
            start = 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.known[w] = ids[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of the encoder's width."""
        plain = [self.by_words and not _BEYOND.search(t) and not (self.special and self.special.search(t)) for t in texts]
        words = [_SPLIT.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        self.learn(list(set().union(*words) - self.known.keys()))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) if p else
                np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=self.width).tobytes()
                for t, p, w in zip(texts, plain, words, strict=True)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


@dataclass
class RecordSet:
    """A written set of records: the folder of its data files and its index table."""

    folder: str
    index: str

    def rows(self, spark: SparkSession) -> DataFrame:
        """part, file, path, record, doc_id, offset, length, n_tokens of every record."""
        return spark.read.parquet(self.index)


INDEX = "part int, file int, path string, record long, doc_id long, offset long, length long, n_tokens long"


def open_files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(file:)?/+", "file:///", uri))


def write_records(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id",
                  vocabulary: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> RecordSet:
    """Encodes every text, appends ``end_id`` and writes the records by ascending key to a
    shared ``folder`` (by default one under the session's checkpoint folder)."""
    folder = (folder or scratch_path(docs.sparkSession, "records")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or default_path())
        end = np.array([end_id], dtype=enc.width).tobytes()
        files, base = open_files(f"{folder}/data")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, file, record, offset, name = None, -1, 0, 0, ""
        for batch in batches:
            rows = []
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(keys), 200):
                ids = enc.encode([values[j].as_py() or "" for j in range(i, min(i + 200, len(keys)))])
                for k, found in zip(keys[i:i + 200], ids, strict=True):
                    data = frame(payload(k, found + end, enc.width.itemsize))
                    if out is None or offset and offset + len(data) > file_bytes:
                        if out is not None:
                            out.close()
                        file, record, offset = file + 1, 0, 0
                        name = f"part-{part:06d}-{file:04d}-{attempt}.rec"
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(f"{base}/{name}", buffer_size=1 << 22)
                    out.write(data)
                    rows.append((part, file, f"{folder}/data/{name}", record, k, offset, len(data),
                                 len(found) // enc.width.itemsize + 1))
                    record, offset = record + 1, offset + len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES) \
                if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _INDEX_TYPES], names=_INDEX_NAMES)
        if out is not None:
            out.close()

    # ranges by key; a hash of the text parts rows that share a key
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    laid_out = (rows.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h")
                .sortWithinPartitions("k", "h").select("k", "t"))
    laid_out.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return RecordSet(folder, f"{folder}/index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types, self.rows, self.size = names, types, [], 0

    def full(self) -> bool:
        return len(self.rows) >= BATCH_RECORDS or self.size >= BATCH_BYTES

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in self.types]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)],
                                          names=self.names)


def file_totals(records: RecordSet, spark: SparkSession) -> DataFrame:
    """part, file, path, n_records, n_tokens and before (ids of all files before) of every file."""
    files = (records.rows(spark).groupBy("part", "file", "path")
             .agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens")))
    # one row a part, then one a file of a part: no window holds all files
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part_before"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return (files.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(parts, "part").withColumn("before", (F.col("_part_before") + F.col("_inside")).cast("long"))
            .drop("_inside", "_part_before"))


def read_records(spark: SparkSession, records: RecordSet) -> DataFrame:
    """part, file, record, doc_id, start (ids of all records before), n_tokens, ids
    (little-endian unsigned 32-bit) of every record, from the data files."""
    names = ["part", "file", "record", "doc_id", "start", "n_tokens", "ids"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(names, types)
        for batch in batches:
            for f in batch.to_pylist():
                files, path = open_files(f["path"])
                record, start = 0, f["before"]
                with files.open_input_stream(path, buffer_size=1 << 22) as stream:
                    while (data := unframe(stream.read, f["path"])) is not None:
                        key, ids = parsed(data)
                        out.add((f["part"], f["file"], record, key, start, len(ids), ids.astype("<u4").tobytes()), 4 * len(ids))
                        record, start = record + 1, start + len(ids)
                        if out.full():
                            yield out.take()
                if (record, start) != (f["n_records"], f["before"] + f["n_tokens"]):
                    raise ValueError(f"{f['path']}: {record} records, but the index has {f['n_records']}")
        yield out.take()

    files, n = few(file_totals(records, spark).checkpoint(), FILES_BROADCAST)
    return (files.repartition(max(1, min(n, READ_TASKS)), "part", "file")
            .mapInArrow(read, "part int, file int, record long, doc_id long, start long, n_tokens long, ids binary"))


def read_shuffled(spark: SparkSession, records: RecordSet, seed: int, partitions: int) -> DataFrame:
    """doc_id, ids of every record in a shuffled order, read one by one by their offsets:
    the index is dealt over ``partitions`` and ordered by a hash keyed by ``seed``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, opened = _Out(["doc_id", "ids"], [pa.int64(), pa.binary()]), {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    files, path = open_files(r["path"])
                    opened[r["path"]] = files.open_input_file(path)
                data = pa.BufferReader(opened[r["path"]].read_at(r["length"], r["offset"]))
                key, ids = parsed(unframe(data.read, r["path"]))
                out.add((key, ids.astype("<u4").tobytes()), 4 * len(ids))
                if out.full():
                    yield out.take()
        yield out.take()

    order = F.xxhash64(F.lit(seed), "part", "file", "record")
    return (records.rows(spark).select("path", "offset", "length", order.alias("_order"))
            .repartition(partitions, "_order").sortWithinPartitions("_order")
            .mapInArrow(read, "doc_id long, ids binary"))


# --- the query ------------------------------------------------------------------


def op12_documents(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return read_records(spark, write_records(docs)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
