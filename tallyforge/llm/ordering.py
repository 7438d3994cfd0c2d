"""Training-order materialisation of token ids.

Texts are tokenised and cut into sequences of fixed length. A sequence's place in a fixed index space comes from a hash of its document and its number; a keyed Feistel
permutation with cycle-walking moves that place to another of the same space. Ranges of the permuted space are the shards: one task sorts a range and writes
its records, all of one stride, to one flat file. The slots 0 .. N-1 are the records in the order of the shards, so a reader that knows the next slot knows file and byte.
Neither the number of sequences nor an order of the input files is needed, so slots don't depend on how files are split.
"""
import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import Scratch

#: Tokens of a sequence, bytes of text for a shard, and the id that fills up a document's last sequence (free in the 50,256 id vocabularies).
LENGTH, SHARD_BYTES, PAD = 512, 64 << 20, 50256
#: Size of the index space, no power of four, so that the permutation walks its cycles.
SPACE = 3 << 60
#: What follows the 16-bit ids of a record: number of ids in use, whether there is a doc_id, doc_id, seq_no, shard, record; then a line feed. All little-endian.
TAIL = np.dtype([("n_tokens", "<u2"), ("has_id", "u1"), ("doc_id", "<i8"), ("seq_no", "<i4"), ("shard", "<i4"), ("record", "<i4"), ("end", "u1")])
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: each bit of x and key changes about half the bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. n-1, another for each key. A Feistel network permutes the least power of four that holds n; what falls outside goes through it again until it is inside."""
    x = np.asarray(index, "u8").copy()
    if n <= 1 or not len(x):
        return x.astype("i8")
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    todo = np.arange(len(x))
    while len(todo):
        x[todo] = network(x[todo])
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype("i8")


_CODERS: dict = {}
#: Texts with runs like these are left to the encoder of `bpe`: the library's regular expressions overflow its stack on them.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def _encode(path: str, pattern: str, text: str) -> np.ndarray:
    if LONG_RUN.search(text):
        return next(iter(bpe(path, pattern).encode_texts([text]))).astype("<u2")
    if (path, pattern) not in _CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _CODERS[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return np.array(_CODERS[path, pattern].encode_ordinary(text), "<u2")


INDEX = "shard int, record long, byte_offset long, doc_id long, seq_no int, n_tokens int, ids_sha256 string"


def stride(length: int = LENGTH) -> int:
    return 2 * length + TAIL.itemsize


def sequences(docs: DataFrame, path: str, pattern: str, length: int, shards: int, key: int) -> DataFrame:
    """at (place in the permuted space), shard, doc_id, seq_no, n_tokens, ids (16-bit little-endian, zstandard)."""
    width = -(-SPACE // shards)

    def run(batches):
        c = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                row, no, n, ids = [], [], [], []
                for k, text in enumerate(part.column(1)):
                    got = _encode(path, pattern, text.as_py() or "")
                    for j in range(0, len(got), length):
                        row.append(k), no.append(j // length), n.append(min(length, len(got) - j)), ids.append(c.compress(got[j : j + length].tobytes()))
                row, no = np.array(row, "i8"), np.array(no, "i8")
                with np.errstate(over="ignore"):
                    index = (part.column(2).to_numpy().view("u8")[row] + no.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SPACE)
                at = permute(index, SPACE, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array((at // width).astype("i4")), part.column(0).take(pa.array(row)), pa.array(no.astype("i4")), pa.array(n, pa.int32()), pa.array(ids, pa.binary())],
                    ["at", "shard", "doc_id", "seq_no", "n_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(run, "at long, shard int, doc_id long, seq_no int, n_tokens int, ids binary")


def write_shards(docs: DataFrame, path: str, pattern: str, out: str, key: int = 1, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, pad: int = PAD) -> int:
    """Writes the flat files out/shard=k/part-* and returns the number of ranges. Spark's committer makes each file appear whole or not at all."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    made = sequences(docs, path, pattern, length, shards, key)
    ranged = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "at", "doc_id", "seq_no", "ids")

    def records(batches):
        d, last, pos = zstandard.ZstdDecompressor(), -1, 0
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                shard, n = part.column(1).to_numpy(), part.num_rows
                full = np.zeros(n, np.dtype([("ids", "<u2", length), ("tail", TAIL)]))
                full["ids"] = pad
                for k, x in enumerate(part.column(5)):
                    got = np.frombuffer(d.decompress(x.as_buffer()), "<u2")
                    full["ids"][k, : len(got)] = got
                tail = full["tail"]
                tail["n_tokens"], tail["seq_no"], tail["shard"], tail["end"] = part.column(4).to_numpy(), part.column(3).to_numpy(), shard, 10
                tail["has_id"] = part.column(2).is_valid().to_numpy(zero_copy_only=False)
                tail["doc_id"] = part.column(2).fill_null(0).to_numpy()
                for s in np.unique(shard):  # sorted; one shard but where fewer partitions were made
                    here = np.flatnonzero(shard == s)
                    pos = pos if s == last else 0
                    tail["record"][here] = np.arange(pos, pos + len(here))
                    last, pos = s, pos + len(here)
                raw = full.tobytes()
                step = full.dtype.itemsize
                yield pa.RecordBatch.from_arrays([pa.array([raw[k * step : (k + 1) * step - 1] for k in range(n)], pa.binary()), part.column(1)], ["record", "shard"])

    # the text writer puts out a record's bytes as they are, and the line feed that each record ends with
    lines = ranged.mapInArrow(records, "record binary, shard int").select(F.col("record").cast("string").alias("record"), "shard")
    lines.write.option("compression", "none").option("lineSep", "\n").partitionBy("shard").text(out)
    return shards


def read_index(spark: SparkSession, out: str, length: int = LENGTH) -> DataFrame:
    """One row per record of the flat files: shard, record, byte_offset, doc_id, seq_no, n_tokens, ids_sha256 (of its ids without padding)."""
    step = stride(length)

    def rows(records):
        for r in records:
            t = np.frombuffer(r, TAIL, 1, 2 * length)[0]
            n, record = int(t["n_tokens"]), int(t["record"])
            yield int(t["shard"]), record, record * step, int(t["doc_id"]) if t["has_id"] else None, int(t["seq_no"]), n, hashlib.sha256(r[: 2 * n]).hexdigest()

    found = spark.sparkContext.binaryRecords(f"{out}/shard=*", step).mapPartitions(rows)  # splits files between records
    return spark.createDataFrame(found, INDEX, verifySchema=False)


def materialise(docs: DataFrame, path: str, pattern: str, key: int = 1, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, pad: int = PAD, out: str | None = None) -> DataFrame:
    """Writes the shards and returns one row per sequence: slot, shard, record, byte_offset, doc_id, seq_no, n_tokens, ids_sha256 (of its ids without padding).

    A document gives one sequence for every `length` tokens begun, a null or empty text none; the last one is padded. Slots follow from the documents' ids and texts and the key
    alone, however files are split. Shard k is a flat file in out/shard=k (a folder of the shared scratch if not given); record r starts at byte r * stride(length) and holds `length` 16-bit
    ids and the fields of TAIL. Repeated rows are sequences of their own, next to each other; other columns are not read; an empty table gives no file and no row. doc_id must be an integer column.
    """
    spark = docs.sparkSession
    out = out or Scratch(spark, "ordering").path()
    write_shards(docs, path, pattern, out, key, length, shard_bytes, pad)
    starts, upto = [], 0
    for shard, _, size in _files(spark, out):  # one a shard
        starts.append((shard, upto))
        upto += size // stride(length)
    start = spark.createDataFrame(starts, "shard int, start long")
    index = read_index(spark, out, length) if starts else spark.createDataFrame([], INDEX)
    return index.join(F.broadcast(start), "shard").select((F.col("start") + F.col("record")).alias("slot"), *index.columns)


def _files(spark: SparkSession, out: str) -> list[tuple[int, str, int]]:
    """(shard, file, bytes) of the flat files, by shard."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{out}/shard=*/part-*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted((int(re.search(r"shard=(\d+)/", f.getPath().toString())[1]), f.getPath().toString(), int(f.getLen())) for f in found)


def read_from(spark: SparkSession, out: str, slot: int = 0, length: int = LENGTH, chunk: int = 4096):
    """Yields (slot, token ids without padding) in training order from a slot on: a seek into the file that holds it, then sequential reads."""
    step, first = stride(length), 0
    jvm = spark._jvm
    for _, name, size in _files(spark, out):
        n = size // step
        at = max(0, slot - first)
        if at < n:
            p = jvm.org.apache.hadoop.fs.Path(name)
            stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
            try:
                stream.seek(at * step)
                while at < n:
                    m = min(chunk, n - at)
                    raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, m * step))
                    for k in range(m):
                        used = int(np.frombuffer(raw, TAIL, 1, k * step + 2 * length)[0]["n_tokens"])
                        yield first + at + k, np.frombuffer(raw, "<u2", used, k * step)
                    at += m
            finally:
                stream.close()
        first += n
