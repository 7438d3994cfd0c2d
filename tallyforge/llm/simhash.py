"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits of the fingerprints are grouped into partitions. Each partition gets its own threshold: if the thresholds add up to
tau - partitions + 1, two fingerprints within tau bits are within the threshold of one partition at least (-1: the partition is left
out). Dynamic programming picks the thresholds with the fewest estimated candidates. Cells of a partition are then probed, and what
meets in a cell is verified over all bits.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, text_of

BITS = 64
#: A cell of more fingerprints than this isn't verified pair by pair: its members meet at midpoints instead, which is exact as well.
CELL = 2048
#: Cost of a probe, which is a row to shuffle, in comparisons of two fingerprints within a task.
PROBE = 1000
#: From so many distinct fingerprints on, two partitions of 32 bits are cheaper than three of about 21.
WIDE_FROM = 1 << 24


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """SimHash of the text's shingles of `width` words, each counted as often as it occurs: a bit is set if over half the hashes have it."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", n) + 1) - 1
    k = min(width, n)
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "u8")
    ones = np.zeros(BITS, "i8")
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text_col: str = "text", name: str = "fp") -> DataFrame:
    """All columns of docs and a long column of fingerprints. A text without words, or null, has fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in text_of(b, text_col)), "u8", b.num_rows).view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have both bits i and j set, over all rows, and the number of rows. Each task adds up its own rows."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            for i in range(0, b.num_rows, 16384):
                x = b.column(0).slice(i, 16384).to_numpy(zero_copy_only=False).astype("i8")
                bits = np.unpackbits(x.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
                total += bits.T @ bits
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), float(n)]])], ["both"])

    part = fps.select("fp").mapInArrow(run, "both array<double>")
    cells = part.select(F.posexplode("both").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # 4097 rows
    both = np.zeros(BITS * BITS + 1)
    for r in cells:
        both[r["at"]] = r["x"]
    return both[:-1].reshape(BITS, BITS), int(both[-1])


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width: each starts with the bit least correlated to those taken and grows by the bit most correlated to its own."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        taken = [b for g in groups for b in g]
        first = min(free, key=lambda b: (corr[b, taken].sum() if taken else -corr[b, free].sum(), b))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def spheres(width: int, radius: int) -> int:
    from math import comb

    return sum(comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def estimates(both: np.ndarray, n: int, groups: list[list[int]], same: list[float], tau: int) -> np.ndarray:
    """Estimated cost of each partition (rows) at each threshold from -1 to tau (columns): candidates and probes.

    The chance of r differing bits comes from the bits' shares as if they were independent; the measured number of pairs that agree on
    the whole partition (same) is its floor.
    """
    n = max(n, 1)  # of no fingerprints, too, few probes are better than many
    p = np.diag(both) / n
    out = np.zeros((len(groups), tau + 2))
    for i, g in enumerate(groups):
        dist = np.zeros(len(g) + 1)
        dist[0] = 1
        for b in g:
            q = 2 * p[b] * (1 - p[b])
            dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
            dist[0] *= 1 - q
        for t in range(tau + 1):
            out[i, t + 1] = max(same[i], float(n) * n * dist[: t + 1].sum()) + PROBE * n * spheres(len(g), t)
    return out


def allocate(cost: np.ndarray, tau: int) -> list[int]:
    """Thresholds of the partitions that add up to tau - partitions + 1 at the least total cost, by dynamic programming."""
    parts = len(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(parts):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                x = (c + cost[i, t + 1], [*ts, t])
                if total + t not in new or x < new[total + t]:
                    new[total + t] = x
        best = new
    return best[tau - parts + 1][1]


def _flips(bits: list[int], radius: int) -> list[int]:
    """Masks of up to radius bits."""
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def verify(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one cell which are linked by pairs within tau bits: one for each but the least of a component."""
    v = np.sort(values)
    bits = v.view("u8")  # of a negative number numpy would count the bits of its absolute value
    label = np.arange(len(v))
    a, b = [], []
    for i in range(0, len(v), 512):
        x, y = np.nonzero(np.bitwise_count(bits[i : i + 512, None] ^ bits[None, :]) <= tau)
        keep = x + i < y
        a.append(x[keep] + i)
        b.append(y[keep])
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(v)))
    return list(zip(v[moved].tolist(), v[label[moved]].tolist(), strict=True))


def link(fps: DataFrame, scratch: Scratch, tau: int = 2, parts: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints of the column fp, such that components are those of all pairs within tau bits.

    A cell of up to `cell` members is verified pair by pair within its task; only joining edges leave it, fewer than members. In larger
    cells every member goes to its midpoints (itself and each fingerprint one bit away): two fingerprints within two bits share one,
    and any two that share one are within two bits. So this holds for tau = 2; for other tau give cell=None to verify all pair by pair.
    """
    if tau != 2 and cell is not None:
        raise ValueError("midpoints are exact for tau = 2 only: give cell=None")
    both, n = bit_statistics(fps)
    parts = parts or (3 if n < WIDE_FROM else 2)
    groups = group_bits(both, n, parts)
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    values = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    counts = fps.select(F.explode(values).alias("c")).groupBy("c.part", "c.value").agg(F.count("*").alias("n"))
    same = {r["part"]: float(r["s"]) for r in counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).collect()}
    limits = allocate(estimates(both, n, groups, [same.get(i, 0.0) for i in range(parts)], tau), tau)
    probes = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(_signed(x))).alias("value"))
        for i, (m, t) in enumerate(zip(masks, limits, strict=True)) if t >= 0 for x in _flips(groups[i], t)
    ]
    rows = scratch.cut(fps.select("fp", F.explode(F.array(*probes)).alias("c")).select("fp", "c.part", "c.value"))
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1")
    if cell is not None:
        hot = sizes.where(F.col("n") > cell).select("part", "value")
        cold_rows = rows.join(sizes.where(F.col("n") <= cell).select("part", "value"), ["part", "value"], "left_semi")
    else:
        cold_rows = rows.join(sizes.select("part", "value"), ["part", "value"], "left_semi")

    def run(batches):
        for b in batches:
            edges = [e for x in b.column(0) for e in verify(np.array(x.as_py(), "i8"), tau)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    edges = cold_rows.groupBy("part", "value").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "a long, b long")
    if cell is not None:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
        mids = rows.join(hot, ["part", "value"], "left_semi").select("fp").distinct().select("fp", F.explode(flips).alias("mid"))
        met = mids.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
        edges = edges.union(met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b"))
    return edges.distinct()


def groups(rows: DataFrame, scratch: Scratch, tau: int = 2, id_col: str = "doc_id", cell: int | None = CELL) -> DataFrame:
    """For each fingerprint of rows (columns id_col and fp): fp, component_id (least id of its component; null ids don't count, null if there is no other)."""
    distinct = scratch.cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    comp = scratch.cut(components(link(distinct, scratch, tau, cell=cell), scratch))
    rooted = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, tau: int = 2, width: int = 3, seed: int = 42, cell: int | None = CELL) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id, kept.

    Texts are read whole. Null and empty texts and texts without words have fingerprint zero, which links like any other. Copies and
    repeated rows share a fingerprint and so a component; of a component the least doc_id is kept (each of its rows, if it is repeated).
    Rows with a null doc_id never give a component its id unless all are null; component_id is then null. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = scratch.cut(with_fingerprints(docs.select("doc_id", "text"), width, seed).select("doc_id", "fp"))
    found = scratch.cut(groups(slim, scratch, tau, cell=cell).select("fp", "component_id"))
    scratch.keep(slim, found)
    return slim.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def keep_one(docs: DataFrame, tau: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs without all but one of each near-duplicate group, all columns kept.

    The row with the least doc_id stays (nulls last; of equal ones any one). Rows are told apart by a row number written with them, so repeated
    rows and null ids leave exactly one row a group. Columns may have any name: they travel in one struct.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    boxed = with_fingerprints(docs.select(F.struct("*").alias("row")), width, seed, "row.text")
    whole = scratch.cut(boxed.select("row", "row.doc_id", "fp", F.monotonically_increasing_id().alias("at")))
    slim = whole.select("doc_id", "fp", "at")
    found = groups(slim, scratch, tau).select("fp", "root")
    best = slim.join(found, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("best"))
    # neither side has a bound, so neither is broadcast
    return whole.join(scratch.cut(best.select("best.at")).hint("merge"), "at", "left_semi").select("row.*")
