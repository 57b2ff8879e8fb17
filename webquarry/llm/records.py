"""Length-delimited binary records of token ids, with a separate offset index.

File format, one record after another, little-endian:

    u64 payload length | u32 masked CRC of the length | payload | u32 masked CRC of the payload | end byte 0x0A

payload = i64 document id, u8 id-is-null flag, then the token ids as u16 (vocabularies up to
65,536) or u32, as the file set's ``dtype`` says. CRC is CRC-32 (zlib), masked as
rotate-right-15 plus 0xA282EAD8 so that a CRC over data holding CRCs stays sound. The numbers in the files'
names follow the document ids; records are in ascending id order in and across files.

Files are written through Spark's own file commit protocol (the frames travel as raw bytes of a
text column; the end byte is the writer's line separator), so that any Hadoop file system
works, a repeated task leaves no second copy, and nothing is written to local disks.
The index (Parquet, own folder) holds for each record: file, offset, length, doc_id, n_ids, the
file-local start and a checksum of the ids; with it readers fetch records in any order.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, settings
from .token_count import WORDS, Cut, WordTable, byte_symbols, cut_at_spaces

END_BYTE = b"\n"
ROWS = 500  # records decoded at a time
AT_ONCE = 100  # words joined to one text for the library
FILE_BYTES = 24 << 20  # text bytes that one file takes about
BATCH = "2000"  # rows of an Arrow batch
TASKS = 20_000  # writing tasks at most; beyond, a task writes several files
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<qB")
_CRC = struct.Struct("<I")


class DamagedRecord(ValueError):
    """A frame whose length or payload doesn't match its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A framed record without its end byte."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _CRC.pack(masked(size)), payload, _CRC.pack(masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises DamagedRecord."""
    if len(data) < at + _HEAD.size:
        raise DamagedRecord(f"cut off at {at}")
    size, crc = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise DamagedRecord(f"length at {at}")
    begin = at + _HEAD.size
    end = begin + size
    if len(data) < end + 5:
        raise DamagedRecord(f"cut off at {at}")
    payload = data[begin:end]
    if _CRC.unpack_from(data, end)[0] != masked(payload) or data[end + 4 : end + 5] != END_BYTE:
        raise DamagedRecord(f"payload at {at}")
    return payload, end + 5


def document_frame(doc_id: int | None, ids: bytes) -> bytes:
    return frame(_ID.pack(doc_id or 0, doc_id is None) + ids)


def scan_records(name: str, data: bytes, dtype: str) -> list[tuple]:
    """(file, offset, length, doc_id, n_ids, local_start, ids_crc32) of each record, both checksums verified."""
    at, start, rows = 0, 0, []
    while at < len(data):
        payload, after = unframe(data, at)
        doc, none = _ID.unpack_from(payload)
        ids = np.frombuffer(payload, dtype=dtype, offset=_ID.size).astype("<u4")
        rows.append((name, at, after - at, None if none else doc, len(ids), start, zlib.crc32(ids)))
        at = after
        start += len(ids)
    return rows


def fetch_record(data: bytes, offset: int, dtype: str) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the record at an index entry's offset."""
    payload, _ = unframe(data, offset)
    doc, none = _ID.unpack_from(payload)
    return None if none else doc, np.frombuffer(payload, dtype=dtype, offset=_ID.size)


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Columns of strings (the first) and longs."""
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class WordEncoder:
    """Token ids of whole texts from the tokenizers library, a word at a time.

    Byte-level BPE never merges over a pre-token's edge, and a word with the space before it is whole
    pre-tokens (see ``cut_at_spaces``), so the library encodes each distinct word once and its ids are memoised as
    bytes. Texts with special strings or with runs of white space go to the library whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype, self.code = dtype, {"<u2": "H", "<u4": "I"}[dtype]
        if sys.byteorder != "little":
            raise NotImplementedError("records are little-endian")
        self.after_space = WordTable(WORDS, pa.binary())
        space = byte_symbols()[ord(" ")]
        self.begins = np.array([self.library.id_to_token(i).startswith(space) for i in range(self.library.get_vocab_size())])

    def encoded(self, texts: list[str]) -> pa.Array:
        """What the library gives for each text."""
        return pa.array([array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)], pa.binary())

    def words(self, words: list[str]) -> pa.Array:
        """Ids of each word with a space before it. Words are encoded some at a time: one begins at each token with a space."""
        out = [pa.array([], pa.binary())]
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            if any(not w or w[0].isspace() or w[-1].isspace() for w in some):
                out.append(self.encoded([" " + w for w in some]))
                continue
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            places = np.append(np.flatnonzero(self.begins[ids]), len(ids)).astype(np.int32) * ids.itemsize
            out.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(places), pa.py_buffer(ids)]))
        return pa.concat_arrays(out)

    def ids(self, cut: Cut) -> Iterator[bytes]:
        """Ids of each text of a cut."""
        entries = pa.concat_arrays([self.after_space.of(cut.words, self.words), self.encoded(cut.heads)])
        parts = cut.parts.copy()
        parts[cut.first[:-1]] = len(cut.words) + np.arange(len(cut.heads))
        flat = entries.take(pa.array(parts))
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int32)[: len(flat) + 1][cut.first].tolist()
        data = flat.buffers()[2]
        for a, b in zip(ends, ends[1:]):
            yield data[a:b].to_pybytes()


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(*key: str) -> WordEncoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append ``end_id`` and write record files under ``path``; returns ``path``.

    Null and empty texts give a record that holds the end id alone. Null ids sort first; rows of one id
    lie in the order of their texts' hashes, so that an id that many rows share is split over tasks.
    One shuffle: a range partition by id, so that files follow the ids' order (see ``placed``). A file
    takes a bounded number of records, whatever rows its task gets.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, rows = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    files = max(1, -(-total // FILE_BYTES))
    tail = np.array([end_id], dtype=dtype).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, dtype)
        for batch in batches:
            at = 0
            for cut in cut_at_spaces(batch.column(1), words.specials):
                keys = batch.column(0).slice(at, len(cut.heads)).to_pylist()
                at += len(keys)
                out = [document_frame(k, ids + tail) for k, ids in zip(keys, words.ids(cut))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
            pa.default_memory_pool().release_unused()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = slim.repartitionByRange(int(min(files, TASKS)), *order).sortWithinPartitions(*order, F.col("text"))
    frames = ordered.mapInArrow(encoded, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # Small Arrow batches: the sort fills the heap, and batches lie outside it, in the JVM and in Python.
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        frames.write.option("lineSep", END_BYTE.decode()).option("maxRecordsPerFile", 2 * max(1, -(-rows // files))).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record file: ``file`` (name) and ``content``; files are of bounded size (see write_records)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


INDEX = "file string, offset long, length long, doc_id long, n_ids long, local_start long, ids_crc32 long"


def build_index(spark: SparkSession, path: str, index_path: str, dtype: str = "<u2") -> DataFrame:
    """Read the record files at ``path`` back, write their offset index, and return it.

    Both checksums of every record are verified; a damaged record raises DamagedRecord. The index also holds
    the CRC-32 of each record's ids as u32, so that shuffled readers can check what they decode.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if rows := scan_records(name, data.as_buffer().to_pybytes(), dtype):
                    yield as_batch(rows, [c.split()[0] for c in INDEX.split(", ")])

    _files(spark, path).mapInArrow(records, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def file_order(file: Column) -> tuple[Column, Column]:
    """A file name's task number and its number among that task's files; names alone don't sort past 99,999."""
    return tuple(F.regexp_extract(file, p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)[^-]*$"))


def placed(index: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all records before), ``n_tokens``, ``ids_crc32`` of each record."""
    part, turn = file_order(F.col("file"))
    totals = index.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", "n", part.alias("part"), turn.alias("turn"))
    # A row for each writing task, at most TASKS of them: the only window that isn't partitioned.
    tasks = totals.groupBy("part").agg(F.sum("n").alias("of_part")).withColumn("parts_before", F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part"))
    before = totals.join(tasks, "part").select("file", (F.col("parts_before") + F.sum("n").over(Window.partitionBy("part").orderBy("turn")) - F.col("n")).alias("base"))
    return index.join(before, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int, dtype: str = "<u2") -> DataFrame:
    """``file``, ``doc_id``, ``ids`` of all records, by their offsets, in an order drawn from the seed within each file."""
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "offset").alias("h"), "offset")))
    wanted = index.groupBy("file").agg(order.alias("o")).select("file", F.transform("o", lambda x: x["offset"]).alias("offsets"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = data.as_buffer().to_pybytes()
                for at in range(0, len(offsets), ROWS):
                    got = [fetch_record(data, o, dtype) for o in offsets[at : at + ROWS]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array([d for d, _ in got], pa.int64()), pa.array([i.tolist() for _, i in got], pa.list_(pa.int64()))], names=["file", "doc_id", "ids"])

    return _files(spark, path).join(wanted, "file").select("file", "content", "offsets").mapInArrow(records, "file string, doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write record files in the shared folder, read them back into their index, and return each record's place."""
    spark = docs.sparkSession
    path = write_records(docs, new_path(spark, "records"), tokenizer, **kw)
    return placed(build_index(spark, path, new_path(spark, "records-index")))
