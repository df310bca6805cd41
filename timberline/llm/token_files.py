"""Token ids in binary files: frequency-ranked, byte-aligned, separate control bytes.

A token's code is its rank by frequency in the corpus, so that frequent tokens take
one byte. A folder holds ``ranks.bin`` (the token id of every rank, unsigned
32-bit) and numbered shards, which hold the documents in ascending order of id.
A shard is a sequence of blocks, all integers little-endian:

* header of five unsigned 64-bit integers: documents, tokens, control bytes, data
  bytes, and 1 if the ids are integers (0: UTF-8 text);
* per document the number of tokens, unsigned 32-bit, then whether its id is null,
  a byte, then the ids (signed 64-bit; text ids as 32-bit lengths and bytes);
* control bytes: two bits for each token, four tokens a byte, the first in the low
  bits, saying how many bytes the code has less one;
* data bytes: the codes one after the other, low byte first.

Decoding looks the four lengths of every control byte up in a table and gathers the
data bytes with numpy; no loop runs over tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.vocab import forget, public_path, vocabulary
from timberline.llm.words import pieces
from timberline.operators.ordering import with_prefix
from timberline.session import checkpointed, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 4_000_000
BLOCK_TOKENS = 500_000
ORDER_BYTES = 32
_HEADER = 5

# Lengths of the four codes that a control byte stands for.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    codes = np.ascontiguousarray(codes, "<u4")
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    width = int(extra.max(initial=0)) + 1
    used = np.arange(width) <= extra[:, None]
    return control.tobytes(), codes.view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` codes of :func:`pack`."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(length) - length
    raw = np.frombuffer(data, np.uint8)
    codes = raw[start].astype(np.uint32)
    for byte in range(1, 4):
        longer = np.flatnonzero(length > byte)
        codes[longer] |= raw[start[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return codes


def _encoded(path: str, end_id: int):
    """The ids of every text, end id included, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for piece in pieces(batches):
            ids, first = vocab.ids(piece.column("text"))
            n = np.diff(first)
            out = np.full(len(ids) + len(n), end_id, vocab.dtype)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            borders = ((first + np.arange(len(first))) * vocab.dtype.itemsize).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(borders), pa.py_buffer(out)])
            yield pa.record_batch({"_id": piece.column("_id"), "n": pa.array(n + 1, pa.int64()), "ids": raw})

    return run


def _frequencies(size: int, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(ids, dtype), minlength=size)
        met = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(met, pa.int64()), "count": pa.array(total[met], pa.int64())})

    return run


def _id_bytes(ids: list, whole: bool) -> bytes:
    if whole:
        return np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    raw = [str("" if i is None else i).encode() for i in ids]
    return np.array([len(x) for x in raw], "<u4").tobytes() + b"".join(raw)


def _block(ids: list, counts: list[int], codes: np.ndarray, whole: bool) -> bytes:
    control, data = pack(codes)
    head = np.array([len(ids), len(codes), len(control), len(data), whole], "<u8").tobytes()
    nulls = np.array([i is None for i in ids], np.uint8).tobytes()
    return head + np.array(counts, "<u4").tobytes() + nulls + _id_bytes(ids, whole) + control + data


def _write_shards(folder: str, rank_of: np.ndarray, dtype: np.dtype, whole: bool):
    """One file for the rows of a task, in their order; the file appears whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        forget()
        shard = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        documents = tokens = 0
        ids: list = []
        counts: list[int] = []
        held: list[bytes] = []

        def flush(out):
            if ids:
                out.write(_block(ids, counts, rank_of[np.frombuffer(b"".join(held), dtype)], whole))
                ids.clear(), counts.clear(), held.clear()

        with files.open_output_stream(draft) as out:
            waiting = 0
            for batch in batches:
                for one, raw in zip(batch.column("_id").to_pylist(), batch.column("ids").to_pylist()):
                    n = len(raw) // dtype.itemsize
                    if waiting and waiting + n > BLOCK_TOKENS:
                        flush(out)
                        waiting = 0
                    ids.append(one), counts.append(n), held.append(raw)
                    waiting += n
                    documents, tokens = documents + 1, tokens + n
            flush(out)
        files.move(draft, f"{root}/shard-{shard:08d}.bin")
        yield pa.record_batch({"shard": [shard], "documents": [documents], "tokens": [tokens]})

    return run


def read_blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, tokens of each, codes) of every block of a shard."""
    view, at = memoryview(content), 0
    while at < len(view):
        documents, tokens, control, data, whole = (int(x) for x in np.frombuffer(view, "<u8", _HEADER, at))
        at += 8 * _HEADER
        counts = np.frombuffer(view, "<u4", documents, at).astype(np.int64)
        at += 4 * documents
        nulls = np.frombuffer(view, np.uint8, documents, at).astype(bool)
        at += documents
        if whole:
            ids = np.frombuffer(view, "<i8", documents, at).tolist()
            at += 8 * documents
        else:
            sizes = np.frombuffer(view, "<u4", documents, at)
            at += 4 * documents
            ids = []
            for size in sizes.tolist():
                ids.append(bytes(view[at : at + size]).decode())
                at += size
        ids = [None if null else one for one, null in zip(ids, nulls.tolist())]
        yield ids, counts, unpack(view[at : at + control], view[at + control : at + control + data], tokens)
        at += control + data


def _read_shards(folder: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{root}/ranks.bin") as file:
            token_of = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard, start = int(path.rsplit("-", 1)[1].split(".")[0]), 0
                for ids, counts, codes in read_blocks(content.as_buffer()):
                    tokens = token_of[codes].astype("<u4")
                    ends = np.cumsum(counts)
                    raw = [tokens[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]
                    yield pa.record_batch(
                        {
                            "_id": pa.array(ids, id_type),
                            "shard": pa.array(np.full(len(ids), shard), pa.int64()),
                            "inside": pa.array(start + ends - counts, pa.int64()),
                            "n_tokens": pa.array(counts, pa.int64()),
                            "tokens": pa.array(raw, pa.binary()),
                        }
                    )
                    start += int(ends[-1])

    return run


def _whole(df: DataFrame) -> bool:
    return df.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long")


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the token ids of every whole text below ``folder`` (a new folder that
    driver and executors share) and return (``shard``, ``documents``, ``tokens``).

    Null and empty texts have the end id alone. Documents are in ascending
    order of id, null ids last, rows of equal id in the order of the first 32 bytes of
    their ids, then of a hash of all. Other columns are not read. An empty table gives a folder with a rank
    table and one empty shard. Texts are encoded once: the ids lie in the shared scratch
    folder while frequencies are counted and shards are laid out.
    """
    path = vocabulary_path or public_path(VOCABULARY)
    spark, vocab = docs.sparkSession, vocabulary(path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    if not _whole(rows):
        rows = rows.withColumn("_id", F.col("_id").cast("string"))
    id_type = rows.schema["_id"].dataType.simpleString()
    scratch = scratch_path(spark, "token-ids")
    rows.mapInArrow(_encoded(path, end_id), f"_id {id_type}, n bigint, ids binary").write.parquet(scratch)
    encoded = spark.read.parquet(scratch)

    # At most one row for every token of the vocabulary.
    counts = (
        encoded.select("ids").mapInArrow(_frequencies(vocab.size, vocab.dtype), "token bigint, count bigint")
        .groupBy("token").agg(F.sum("count").alias("count")).toPandas()
    )
    total = np.zeros(vocab.size, np.int64)
    total[counts["token"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    token_of = np.lexsort((np.arange(vocab.size), -total)).astype("<u4")
    rank_of = np.empty(vocab.size, np.uint32)
    rank_of[token_of] = np.arange(vocab.size, dtype=np.uint32)

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(token_of.tobytes())
    shards = max(1, -(-int(total.sum()) // shard_tokens))
    # Spark samples the order's values on the driver: they are of bounded size, and spread rows of equal id.
    order = [F.col("_id").asc_nulls_last(), F.substring("ids", 1, ORDER_BYTES), F.xxhash64("ids")]
    laid = encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids")
    written = laid.select("_id", "ids").mapInArrow(
        _write_shards(folder, rank_of, vocab.dtype, _whole(rows)), "shard bigint, documents bigint, tokens bigint"
    )
    return checkpointed(written)


def read_token_files(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """The documents of a folder: (``_id``, ``shard``, ``inside`` (tokens before it
    in its shard), ``n_tokens``, ``tokens`` (ids as little-endian unsigned 32-bit integers))."""
    kind = pa.int64() if id_type == "bigint" else pa.string()
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).select("path", "content")
        .mapInArrow(_read_shards(folder, kind), f"_id {id_type}, shard bigint, inside bigint, n_tokens bigint, tokens binary")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(raw.as_buffer()) for raw in batch.column("tokens")]
        kept = [n for n in batch.schema.names if n != "tokens"]
        yield pa.record_batch({**{n: batch.column(n) for n in kept}, "ids_crc32": pa.array(sums, pa.int64())})


def token_file_digest(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(``id_col``, ``start``, ``n_tokens``, ``ids_crc32``) of every document, from the files."""
    found = checkpointed(
        read_token_files(spark, folder, id_type).mapInArrow(
            _digests, f"_id {id_type}, shard bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
        )
    )
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    starts = with_prefix(shards, [F.col("shard")], sums={"tokens": "before"}).select("shard", "before")
    return found.join(starts, "shard").select(
        F.col("_id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write token files to ``folder`` (default: a new one in the shared scratch
    folder) and return the digest read back from them; see :func:`write_token_files`."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    write_token_files(docs, folder, id_col, text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    return token_file_digest(spark, folder, id_col, "bigint" if whole else "string")
