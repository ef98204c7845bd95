"""Token ids in binary blocks with one zstandard dictionary (operator 3).

Layout of a store, a folder on any file system that Spark writes:

* ``dictionary``: one row ``(dict_hash, width, dictionary)``; the dictionary is
  trained on serialized id arrays, the hash is the SHA-256 of its bytes.
* ``blocks``: rows ``(shard, block, first_id, last_id, start, n_ids, dict_hash, ids,
  n_tokens, ends, payload)``.  ``payload`` is the concatenation of one zstandard
  frame per document, ``ends`` the offset index of the frames, ``start`` the
  number of ids before the block within its shard.  Shards, and blocks within
  them, follow the ascending document ids.

A document is read by its block's ``ids`` and ``ends`` alone; no other frame is
opened.  Blocks are written by Spark's own committer, so a lost executor only
repeats its tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arrays import text_chunks
from .rank_merge import ENCODE_BYTES, RankEncoder, byte_letters, load_tables

#: Documents whose ids the dictionary is trained on, about; chosen by a hash of their ids and texts, equal rows once.
SAMPLE_DOCUMENTS = 1000
#: Bytes of one training sample, and samples of one document at most, spread over all of it.
SAMPLE_BYTES, SAMPLES_EACH = 8192, 4
DICTIONARY_BYTES = 65536
#: A block ends with the document that takes it over this many bytes or documents.
BLOCK_BYTES, BLOCK_DOCUMENTS = 1 << 20, 1024


class LibraryEncoder(RankEncoder):
    """Texts are cut into pre-tokens by arrays; the ids of each distinct pre-token are the tokenizers library's."""

    def __init__(self, path: str):
        super().__init__(path, ids=True)
        self.library = Tokenizer.from_file(path).model
        self.letters = {i: c for i, c in enumerate(byte_letters())}

    def _merge_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [[t.id for t in self.library.tokenize(raw[a:b].decode("latin-1").translate(self.letters))] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> LibraryEncoder:
    """One encoder for all tasks of a Python worker."""
    return LibraryEncoder(path)


def encoded(batches, path: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches, each with the ids of its second column's texts."""
    encoder = shared_encoder(path)
    tail = np.empty(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
    for batch in batches:
        for row, data, offsets in text_chunks(batch.column(1), ENCODE_BYTES):
            ids, counts = encoder.encode(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
            yield batch.slice(row, len(counts)), [np.concatenate([ids[a:b], tail]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str, text_col: str, width: int, sample: int = SAMPLE_DOCUMENTS) -> zstandard.ZstdCompressionDict:
    """Dictionary of at most DICTIONARY_BYTES from about ``sample`` documents; empty if there is too little to learn from."""
    every = max(1, docs.count() // sample)
    some = docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("h")).where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"]).select(id_col, text_col)

    def run(batches):
        for _, arrays in encoded(batches, tokenizer_path, end_id):
            out = []
            for ids in arrays:
                raw = ids.astype(f"<u{width}").tobytes()
                blocks = [raw[i : i + SAMPLE_BYTES] for i in range(0, len(raw), SAMPLE_BYTES)]
                out += blocks[:: -(-len(blocks) // SAMPLES_EACH)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["sample"])

    samples = sorted(bytes(r[0]) for r in some.mapInArrow(run, "sample binary").collect())
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 4096:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_from(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_id", id_type), T.StructField("last_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("dict_hash", T.StringType())]
        + [T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())]
    )


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> None:
    """Encodes every whole text and writes a store.

    Documents go in ascending id order, nulls first; rows of one id go by their
    text.  A null text counts as empty, an empty table gives a store without
    blocks, other columns are ignored.  Memory: one document and one block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    width = 2 if len(load_tables(tokenizer_path).labels) <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    raw = train_dictionary(docs, tokenizer_path, end_id, "id", "text", width).as_bytes()
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, width, bytearray(raw))], "dict_hash string, width int, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    schema = block_schema(docs.schema["id"].dataType)
    id_type = pa.list_(pa.int64())

    def run(batches):
        shard = TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=dictionary_from(raw), write_content_size=True, write_dict_id=False)
        block = start = 0
        ids, tokens, ends, frames, size, arrow_ids = [], [], [], [], 0, id_type

        def close():
            column = pa.array([ids], pa.list_(arrow_ids))
            edge = [pa.array([ids[0]], arrow_ids), pa.array([ids[-1]], arrow_ids)]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *edge, pa.array([start], pa.int64()), pa.array([sum(tokens)], pa.int64()), pa.array([name]), column, pa.array([tokens], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())],
                names=schema.fieldNames(),
            )

        for batch, arrays in encoded(batches, tokenizer_path, end_id):
            arrow_ids = batch.column(0).type
            for key, one in zip(batch.column(0).to_pylist(), arrays, strict=True):
                frame = squeeze.compress(one.astype(f"<u{width}").tobytes())
                size += len(frame)
                ids.append(key)
                tokens.append(len(one))
                ends.append(size)
                frames.append(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield close()
                    block, start = block + 1, start + sum(tokens)
                    ids, tokens, ends, frames, size = [], [], [], [], 0
        if ids:
            yield close()

    # hashes of the texts deal out an id that many rows share; equal rows are alike in any order
    ordered = docs.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def load_dictionary(spark: SparkSession, folder: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not match its hash")
    return row["dict_hash"], row["width"], raw


def read_store(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store: ``doc_id, start, n_tokens, ids_crc32`` and, with_ids, ``ids``.

    ``start`` counts the ids of all documents before it.
    """
    name, width, raw = load_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    id_type = blocks.schema["first_id"].dataType
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)

    def run(batches):
        open_ = zstandard.ZstdDecompressor(dict_data=dictionary_from(raw))
        for batch in batches:
            for shard, start, known, ids, tokens, ends, payload in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
                if known != name:
                    raise ValueError("a block was written with another dictionary")
                view = memoryview(payload.as_buffer())
                arrays = [np.frombuffer(open_.decompress(view[a:b]), dtype=f"<u{width}").astype("<u4") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                if [len(a) for a in arrays] != tokens:
                    raise ValueError("a frame does not hold as many ids as its index says")
                at = np.cumsum([start, *tokens[:-1]])
                columns = [pa.array([shard] * len(ids), pa.int32()), pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(at, pa.int64()), pa.array(tokens, pa.int64()), pa.array([zlib.crc32(a) for a in arrays], pa.int64())]
                if with_ids:
                    columns.append(pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = blocks.select("shard", "start", "dict_hash", "ids", "n_tokens", "ends", "payload").mapInArrow(run, schema)
    # one row a shard: a running sum over so few rows may use one task
    before = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = rows.join(before.select("shard", "before"), "shard")
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def fetch(spark: SparkSession, folder: str, doc_id) -> list[list[int]]:
    """Ids of every document with this id; opens only its own frames of the blocks that can hold it (null ids come first, so a block may begin with one)."""
    _, width, raw = load_dictionary(spark, folder)
    open_ = zstandard.ZstdDecompressor(dict_data=dictionary_from(raw))
    blocks = spark.read.parquet(f"{folder}/blocks").where((F.col("first_id").isNull() | (F.col("first_id") <= F.lit(doc_id))) & (F.col("last_id") >= F.lit(doc_id)) & F.array_contains("ids", F.lit(doc_id)))
    places = blocks.orderBy("shard", "block").select(F.posexplode("ids").alias("i", "id"), "ends", "payload").where(F.col("id") == F.lit(doc_id))
    begin = F.when(F.col("i") > 0, F.element_at("ends", F.col("i"))).otherwise(F.lit(0))
    frames = places.select(F.substring("payload", begin.cast("int") + 1, (F.element_at("ends", F.col("i") + 1) - begin).cast("int")))
    return [np.frombuffer(open_.decompress(bytes(r[0])), dtype=f"<u{width}").tolist() for r in frames.collect()]
