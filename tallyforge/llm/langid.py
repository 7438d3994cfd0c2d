"""Language identification by nearest centroids of normalised TF-IDF vectors of character n-grams."""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, text_of

#: Hashed n-gram dimensions, centroids of a language, and the bounds of the sample that centroids are fitted on: rows of a language, and rows in all (about both); but of
#: each language so many at least, if it has them, however many languages there are.
DIMS, CENTROIDS, SAMPLE_ROWS, SAMPLE_ALL, SAMPLE_LEAST = 1 << 13, 4, 400, 20_000, 8
#: A table of so many languages (under 100 bytes each) is broadcast at most; more are joined without a hint.
BROADCAST_LANGS = 100_000
UNKNOWN = "und"


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the whole text's letters, lower case, with runs of anything else as one space. None without letters."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le"), "u4")
    big = int(code.max(initial=0)) + 1
    letter = _letters(max(big, 0x250))[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    code = np.concatenate([[32], code[keep], [32]]).astype("u4")
    with np.errstate(over="ignore"):
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (code[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    return sum(np.bincount(h >> shift, minlength=DIMS) for h in (one, two, three))


_TABLE = np.zeros(0, bool)


def _letters(size: int) -> np.ndarray:
    """Whether a code point is a letter, for all below size."""
    global _TABLE
    if size > len(_TABLE):
        size = 1 << (size - 1).bit_length()
        _TABLE = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    return _TABLE


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # of each dimension
    centroids: np.ndarray  # rows of unit length
    lang_of: np.ndarray  # of each centroid
    floor: np.ndarray  # least cosine accepted, by bit length of the number of n-grams

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows).astype("f4") * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, rows: np.ndarray):
        """Of rows of counts: index of the language (-1: no language was learned), score 0 to 1, whether the nearest centroid is too far away."""
        if not self.langs:
            return np.full(len(rows), -1), np.zeros(len(rows)), np.ones(len(rows), bool)
        sims = self.vectors(rows) @ self.centroids.T
        best = np.full((len(rows), len(self.langs)), -1.0)
        for k, lang in enumerate(self.lang_of):
            best[:, lang] = np.maximum(best[:, lang], sims[:, k])
        top = best.argmax(1)
        near = best[np.arange(len(rows)), top]
        e = np.exp((best - near[:, None]) * 20)
        bits = np.minimum(np.log2(np.maximum(rows.sum(1), 1)).astype(int), len(self.floor) - 1)
        return top, np.clip(1 / e.sum(1), 0, 1), near < self.floor[bits]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Unit centroids of unit rows; starts with the row nearest the mean, then with rows farthest from the centroids so far."""
    first = int((x @ x.mean(0)).argmax())
    cent = x[[first]]
    near = x @ cent[0]
    while len(cent) < min(k, len(x)):
        cent = np.concatenate([cent, x[[int(near.argmin())]]])
        near = np.maximum(near, x @ cent[-1])
    for _ in range(rounds):
        home = (x @ cent.T).argmax(1)
        new = np.stack([x[home == j].mean(0) if (home == j).any() else cent[j] for j in range(len(cent))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.abs(new - cent).max() < 1e-6:
            break
        cent = new
    return cent


def bucket(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, per_lang: int = SAMPLE_ROWS, most: int = SAMPLE_ALL, least: int = SAMPLE_LEAST) -> Model:
    """Learns from text and non-null lang of documents whose bucket isn't 0.

    Document frequencies count all of these documents, one distributed sum of DIMS counters. Centroids come from a sample: of each language those rows with the least hashes of
    doc_id, about `per_lang` of them, fewer where many languages would make more than `most` in all, but `least`, and one at least. Every language is learned. Count vectors are made by tasks
    from whole texts; only sparse vectors of the sample come to the driver. A model takes 128 KiB a language.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    rows = docs.select("doc_id", "text", "lang").where((bucket() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", h)
    sizes = [(r["lang"], r["n"], r["first"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).collect()]  # a row for each language, as the model has
    low, high = least, max(least, per_lang)
    while low < high:  # the largest quota with at most `most` rows
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) for _, n, _ in sizes) <= most else (low, mid - 1)
    shares = spark.createDataFrame([(lang, min(1.0, low / n), first) for lang, n, first in sizes], "lang string, share double, first double")
    marked = rows.join(F.broadcast(shares) if len(sizes) <= BROADCAST_LANGS else shares, "lang").select("lang", "text", ((F.col("h") < F.col("share")) | (F.col("h") <= F.col("first"))).alias("picked"))

    def run(batches):
        df, n = np.zeros(DIMS, "i8"), 0
        for b in batches:
            langs, at, val = [], [], []
            for lang, text, picked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                c = counts(text.as_py())
                if c is not None:
                    i = np.flatnonzero(c)
                    df[i] += 1
                    n += 1
                    if picked:
                        langs.append(lang), at.append(i.astype("u2").tobytes()), val.append(c[i].astype("u4").tobytes())
            m = len(langs)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(val, pa.binary()), pa.array([None] * m, pa.list_(pa.int64())), pa.array([0] * m, pa.int64())], ["lang", "at", "val", "df", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([df], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["lang", "at", "val", "df", "n"])

    seen = scratch.cut(marked.mapInArrow(run, "lang string, at binary, val binary, df array<long>, n long"))
    df, n = np.zeros(DIMS), int(seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    for r in seen.where("df is not null").select(F.posexplode("df").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():  # DIMS rows
        df[r["k"]] = r["x"]
    got: dict[str, list] = {}
    for r in sorted(seen.where("df is null").select("lang", "at", "val").collect(), key=lambda r: (bytes(r["at"]), bytes(r["val"]))):
        got.setdefault(r["lang"], []).append(r)
    scratch.release(seen)
    langs = sorted(got, key=lambda s: s.encode())
    if not langs:
        return Model([], np.ones(DIMS, "f4"), np.zeros((0, DIMS), "f4"), np.zeros(0, int), np.zeros(33))
    model = Model(langs, np.log((n + 1) / (df + 1)).astype("f4") + np.float32(0.05), np.zeros((0, DIMS), "f4"), np.zeros(0, int), np.zeros(33))
    cents, lang_of, near, bits = [], [], [], []
    for i, lang in enumerate(langs):
        dense = np.zeros((len(got[lang]), DIMS), "f4")
        for k, r in enumerate(got[lang]):
            dense[k, np.frombuffer(r["at"], "u2")] = np.frombuffer(r["val"], "u4")
        x = model.vectors(dense)
        long_ = dense.sum(1) >= 300  # short texts blur the centroids
        cent = spherical_kmeans(x[long_] if long_.sum() >= CENTROIDS else x, CENTROIDS)
        cents.append(cent)
        lang_of += [i] * len(cent)
        near.append((x @ cent.T).max(1))
        bits.append(np.log2(np.maximum(dense.sum(1), 1)).astype(int))
    model.centroids, model.lang_of = np.concatenate(cents), np.array(lang_of)
    near, bits = np.concatenate(near), np.concatenate(bits)
    # farther than any training text of the same length class or a shorter one, with half as much again: rejected
    floor, low = np.zeros(33), 1.0
    for k in range(33):
        if (bits == k).any():
            low = float(near[bits == k].min())
        floor[k] = 0.5 * low if (bits <= k).any() else 0.0
    model.floor = np.minimum.accumulate(floor[::-1])[::-1]
    return model


def with_language(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """All columns of docs and three more: <prefix>pred (string), <prefix>score (double, 0 to 1), <prefix>far (boolean: nothing learned is near).

    A text that is null or has no letter gets `und`, score 0, far. Ties go to the language that comes first by code point.
    """
    fields = [T.StructField(f"{prefix}pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}far", T.BooleanType())]

    def run(batches):
        for b in batches:
            pred, score, far = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for i in range(0, b.num_rows, 256):
                found = [(k, c) for k, t in enumerate(text_of(b, text_col).slice(i, 256), i) if t.is_valid and (c := counts(t.as_py())) is not None]
                if found:
                    ks = [k for k, _ in found]
                    top, score[ks], far[ks] = model.predict(np.stack([c for _, c in found]))
                    for k, t in zip(ks, top, strict=True):
                        pred[k] = model.langs[t] if t >= 0 else UNKNOWN
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(far)], [*b.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected. Repeated rows get the same answer each; a null doc_id is neither learned from nor held out."""
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(bucket() == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_far").alias("rejected"))
