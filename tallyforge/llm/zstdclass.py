"""Quality classifier by compression: a text is compressed with a dictionary of good and with one of bad text, and the normalised
difference of the sizes, calibrated by logistic regression, is its score."""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Bounds of the sample that a classifier is fitted on: labelled documents for each class and purpose, bytes of their whole texts together, bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 2000, 8 << 20, 262_144
#: Texts are compressed in pieces of so many bytes, each with a fresh dictionary; else a long text soon compresses by itself alone.
PIECE = 1024


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    level: int = 3
    fitted: bool = False

    def difference(self):
        """A function from UTF-8 bytes to (size with the bad dictionary - size with the good one) / number of bytes, over all pieces; 0 for no bytes.

        Divided by the bytes, not by the compressed sizes: text that repeats itself compresses to next to nothing either way, and so stays near 0.
        """

        def sizer(d: bytes):
            kind = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
            kind.precompute_compress(level=self.level)
            c = zstandard.ZstdCompressor(level=self.level, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            return lambda parts: sum(len(c(p)) for p in parts)

        good, bad = sizer(self.good), sizer(self.bad)

        def of(data: bytes) -> float:
            parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            if not parts:
                return 0.0
            return (bad(parts) - good(parts)) / len(data)

        return of

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))


def bucket(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Intercept and slope (not below 0). The ridge, on the slope alone, keeps scores near the share of label 1 where there are few labels; thousands outweigh it."""
    pull = np.diag([1e-6, ridge])
    scale = float(np.std(x)) or 1.0
    a = np.stack([np.ones_like(x), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + pull
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(w[0]), float(max(w[1], 0.0) / scale)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from labelled documents whose bucket isn't 2: dictionaries from buckets 0 and 1, calibration from bucket 3.

    The sample has at most `sample` documents and `sample_bytes` bytes of whole texts for each class and purpose, in the order of a hash of the id; a text that is longer than what is
    left is passed over. So 4 x sample ids bound the broadcast and 4 x sample_bytes what comes to the driver. Texts are never cut. With only one class or no labels the score is the
    share of label 1 (0.5 for none), and the model isn't `fitted`. Null labels and ids, and ids with both labels, are left out; of a repeated label one counts.
    """
    b = bucket()
    use = F.when(b == 3, 1).when(b != 2, 0)
    said = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    rows = said.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality", use.alias("use")).where("use is not null").withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for q in (0, 1):
        for u in (0, 1):
            part = rows.where((F.col("quality") == q) & (F.col("use") == u)).orderBy("h", "doc_id").limit(sample)
            picked = part if picked is None else picked.union(part)
    sizes = docs.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id").where("n is not null").groupBy("h", "doc_id", "quality", "use").agg(F.sum("n").alias("n"))
    room = {(q, u): sample_bytes for q in (0, 1) for u in (0, 1)}
    chosen = []
    for r in sizes.orderBy("h", "doc_id").collect():  # 4 x sample at most
        if r["n"] <= room[r["quality"], r["use"]]:
            room[r["quality"], r["use"]] -= r["n"]
            chosen.append((r["doc_id"], r["quality"], r["use"], r["h"]))
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([labels.schema["doc_id"], *(T.StructField(n, T.IntegerType()) for n in ("quality", "use")), T.StructField("h", T.LongType())]))
    got = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").where("text is not null").select("h", "doc_id", "quality", "use", "text").collect() if chosen else []
    got.sort(key=lambda r: (r["h"], r["doc_id"], r["text"]))
    data = {(q, u): [r["text"].encode() for r in got if (r["quality"], r["use"]) == (q, u)] for q in (0, 1) for u in (0, 1)}
    n1, n = sum(r["quality"] for r in got), len(got)
    prior = (n1 + 0.5) / (n + 1) if n else 0.5
    flat = [float(np.log(prior / (1 - prior))), 0.0]

    def dictionary(texts: list[bytes]) -> bytes:
        parts, size = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)], DICT_BYTES
        while size >= 1024:
            try:
                return zstandard.train_dictionary(size, parts, level=3).as_bytes()
            except zstandard.ZstdError:  # too little text for so large a dictionary
                size //= 2
        return b"".join(texts) or b"\0" * 8  # too little for any: the texts themselves, whole

    model = Model(dictionary(data[1, 0]), dictionary(data[0, 0]), flat)
    if data[0, 0] and data[1, 0] and data[0, 1] and data[1, 1]:
        of = model.difference()
        x = np.array([of(t) for q in (0, 1) for t in data[q, 1]])
        y = np.array([q for q in (0, 1) for _ in data[q, 1]], float)
        model.weights, model.fitted = _logistic(x, y), True
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and a double column, 0 to 1. Only the whole text is an input; null counts as empty, and an empty text gets the score of no difference."""

    def run(batches):
        of = model.difference()
        for b in batches:
            x = np.fromiter((of((t.as_py() or "").encode()) for t in text_of(b, text_col)), "f8", b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= threshold). Repeated rows get the same score each; a null doc_id isn't held out."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(bucket() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
