"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative of each group."""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components
from .langid import spherical_kmeans

#: Centroids are fitted on so many vectors at most (those with the least hashes) and are so many at most, which bounds their broadcast.
SAMPLE, CELLS = 16_384, 4096
#: Vectors of a block: a task holds two blocks and their product.
BLOCK = 2048


def finite(col: str):
    """Whether the vector can link: not null, no null or non-finite component, not zero."""
    return F.coalesce(F.col(col).isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(col, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(n: int) -> int:
    """Cells for n vectors: one for each block. With more of them a vector visits more cells, and rows cost more than products."""
    return int(min(CELLS, max(1, n // BLOCK)))


def fit(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centroids for each dimension in the sample (vectors of other dimensions share one cell each)."""
    got = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(len(r[0]), []).append(r[0])
    return {dim: spherical_kmeans(_unit(np.array(v, "f8")), max(1, cells(n) * len(v) // len(got)), rounds=8) for dim, v in by.items()}


def place(rows: DataFrame, centroids: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Rows (node, weight, vec) in their own cell (home = cell) and in those where a linked vector may be at home: node, weight, vec, dim, home, cell.

    Unit vectors with that cosine are d = sqrt(2 - 2 cosine) apart at most. If x is at home in i and y in j, the plane halfway between the
    centroids lies between them, so one of the two is within d / 2 of it: that one visits the other's cell. No link is lost.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9

    def run(batches):
        for b in batches:
            node, dim, home, cell = [], [], [], []
            values, off = b.column(2).values.to_numpy(zero_copy_only=False).astype("f8"), b.column(2).offsets.to_numpy()
            lens = np.diff(off)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                cent = centroids.get(int(d))
                if cent is None:
                    cent = np.eye(1, int(d))
                between = np.sqrt(np.maximum(2 - 2 * cent @ cent.T, 1e-18))
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    x = values[off[part][:, None] + np.arange(d)]
                    sims = _unit(x) @ cent.T
                    own = sims.argmax(1)
                    gap = (sims[np.arange(len(part)), own][:, None] - sims) / between[own]
                    gap[np.arange(len(part)), own] = 0
                    r, c = np.nonzero(gap <= reach)
                    node.append(part[r]), home.append(own[r]), cell.append(c), dim.append(np.full(len(r), d))
            order = np.concatenate(node)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(order)), b.column(1).take(pa.array(order)), b.column(2).take(pa.array(order)), pa.array(np.concatenate(dim).astype("i4")),
                pa.array(np.concatenate(home).astype("i4")), pa.array(np.concatenate(cell).astype("i4")),
            ], ["node", "weight", "vec", "dim", "home", "cell"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("node", "weight", "vec").where(F.size("vec") > 0).mapInArrow(run, f"node long, weight long, vec {kind}, dim int, home int, cell int")


def _beyond(x: np.ndarray, at: np.ndarray, cent: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How far each x[at] lies on its own centroid's side of the plane to the other's (times the centroids' distance). Summed row by row, so any task gets the same bits."""
    out = np.empty(len(at))
    for i in range(0, len(at), 8192):
        k = slice(i, i + 8192)
        out[k] = np.add.reduce(np.ascontiguousarray(x[at[k]] * (cent[own[k]] - cent[other[k]])), axis=1)
    return out


def _joined(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each node of the pairs to the least node of its component within the block."""
    label = np.arange(len(nodes))  # nodes are sorted
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True))


def compare(placed: DataFrame, centroids: dict[int, np.ndarray], cosine: float, block: int = BLOCK) -> DataFrame:
    """Blocked products within cells. Rows (a, b, n): node a has n links more (b null), or a and b are in one component (n null).

    A cell's residents and visitors are dealt into blocks by a hash; a task multiplies a block of residents with one block of residents or
    visitors of the same cell. It gives one count for each vector and one edge for each vector that isn't least in its component, never the pairs.
    A pair of different homes counts in the home of the one that lies farther from the plane between them (of equal ones, the lower cell), where the other surely visits.
    """
    sizes = placed.groupBy("dim", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count("*").alias("all"))
    sizes = sizes.where("own > 0 and all > 1").select("dim", "cell", F.ceil(F.col("own") / block).cast("int").alias("rb"), F.ceil(F.col("all") / block).cast("int").alias("ob"))
    rows = placed.join(sizes, ["dim", "cell"]).withColumn("h", F.xxhash64("node"))
    left = rows.where("home = cell").select("*", F.pmod("h", "rb").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("y"), F.lit(True).alias("res"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("x"), F.pmod("h", "ob").cast("int").alias("y"), F.lit(False).alias("res"))
    # pmod(h, ob) deals residents and visitors alike, so a resident is in one left and one right block; pairs of residents count where left node < right node
    cols = ["dim", "cell", "x", "y", "node", "weight", "vec", "home", "res"]

    def run(key, t):
        res = t.column("res").to_numpy(zero_copy_only=False)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if res.all() or not res.any():
            return empty
        lt, rt = t.filter(pa.array(res)), t.filter(pa.array(~res))

        def side(s):
            vec = s.column("vec").combine_chunks()
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            return s.column("node").to_numpy(), s.column("weight").to_numpy(), _unit(flat.reshape(s.num_rows, -1).astype("f8")), s.column("home").to_numpy()

        ln, lw, lx, _ = side(lt)
        rn, rw, rx, rh = side(rt)
        here = int(t.column("cell")[0].as_py())
        cent = centroids.get(int(t.column("dim")[0].as_py()))
        counts: dict[int, int] = {}
        pa_, pb_ = [], []
        for i in range(0, len(ln), 512):
            a, b = np.nonzero(lx[i : i + 512] @ rx.T >= cosine)
            a += i
            same = rh[b] == here
            ok = ~same | (ln[a] < rn[b])  # both at home here: count once
            v = np.flatnonzero(~same)
            if len(v):
                mine, its = np.full(len(v), here), rh[b[v]]
                near, far = _beyond(rx, b[v], cent, its, mine), _beyond(lx, a[v], cent, mine, its)
                ok[v] = (near < far) | ((near == far) & (here < rh[b[v]]))
            pa_.append(a[ok]), pb_.append(b[ok])
        a, b = np.concatenate(pa_), np.concatenate(pb_)
        if not len(a):
            return empty
        total_l, total_r = np.zeros(len(ln), "i8"), np.zeros(len(rn), "i8")
        np.add.at(total_l, a, rw[b])
        np.add.at(total_r, b, lw[a])
        for nodes, total in ((ln, total_l), (rn, total_r)):
            for k in np.flatnonzero(total):
                counts[int(nodes[k])] = counts.get(int(nodes[k]), 0) + int(total[k])
        nodes = np.unique(np.concatenate([ln[a], rn[b]]))
        edges = _joined(nodes, np.searchsorted(nodes, ln[a]), np.searchsorted(nodes, rn[b]))
        n, m = len(counts), len(edges)
        return pa.table({"a": pa.array([*counts, *(e[0] for e in edges)], pa.int64()), "b": pa.array([None] * n + [e[1] for e in edges], pa.int64()), "n": pa.array([*counts.values()] + [None] * m, pa.int64())})

    return left.select(cols).union(right.select(cols)).groupBy("dim", "cell", "x", "y").applyInArrow(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Cosine in double precision, links at `cosine` or more, none lost. A vector that is null, zero or empty, or has null or non-finite components,
    links with nothing: n_links 0, itself as component. Vectors of other length never link. Equal vectors (repeated rows too) are compared
    once, with their number as weight, and count as linked to each other. Other columns, label among them, are not read. A null vec_id never
    is a component's id unless there is no other; kept is then false.
    """
    scratch = Scratch(embeddings.sparkSession, "neardup")
    single = embeddings.schema["embedding"].dataType.elementType == T.FloatType()  # compared in double precision all the same
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("vec"))
    good = rows.where(finite("vec"))
    distinct = scratch.cut(good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    centroids = fit(distinct, n)
    placed = scratch.cut(place(distinct, centroids, cosine))
    found = scratch.cut(compare(placed, centroids, cosine, block))
    scratch.release(placed)
    comp = components(found.where("b is not null").select("a", "b"), scratch)
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = distinct.join(links, "node", "left").join(comp, "node", "left").select("vec", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    full = scratch.cut(rooted.join(least, "root").select("vec", "n_links", "component_id"))
    scratch.keep(full)
    linked = good.join(full, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~finite("vec")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
