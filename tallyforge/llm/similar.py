"""Near-duplicates of whole texts by SimHash: fingerprints over the distinct five-word shingles, generalised pigeonhole for candidates, exact Jaccard verification.

Each distinct shingle set has fingerprints of 64 bits under several hash functions. Every one of them is probed as in `simhash` (correlated bits grouped,
thresholds by dynamic programming); a pair is a candidate if it is within TAU bits in one of them and not far apart in all bits together. Cells give out
spanning forests of their candidates, never all pairs. A candidate group is then verified by whole shingle sets: all members against the group's most linked one,
what fails along the forest's edges, and what still stands apart against the rest of its group, in blocks.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, text_of
from .simhash import BITS, _flips, _signed, allocate, bit_statistics, estimates, group_bits

#: Words of a shingle. Similar are documents of Jaccard >= 0.8 over their distinct shingles.
WIDTH, SEED = 5, 42
#: Fingerprints of a shingle set, bits that a candidate pair differs in at most in one of them, and on average in all (rounded up). Of the pairs of Jaccard >= 0.8 in
#: a table of near copies 92 % are candidates, which finds 97 % of the copies, as copies have more than one partner.
TABLES, TAU, MEAN = 3, 8, 13
#: Nodes on each side of a comparison within one task: fingerprints, and whole shingle sets.
BLOCK, SETS = 2048, 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of `width` words; of a shorter text the one run of all its words."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII space only
    if not words:
        return np.array([], "u8")
    k, digest = min(width, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), "u8"))


def sketches(h: np.ndarray) -> list[int]:
    """The fingerprints of a shingle set, one for each table: a bit is set if over half of the hashes have it."""
    out = []
    for k in range(TABLES):
        ones = np.zeros(BITS, "i8")
        for i in range(0, len(h), 8192):
            part = h[i : i + 8192]
            if k:  # another hash function of the same shingles
                with np.errstate(over="ignore"):
                    part = (part ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    part = (part ^ (part >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    part = part ^ (part >> np.uint64(29))
            ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        out.append(int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True) if len(h) else 0)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard >= 0.8, that is 9 |a and b| >= 4 (|a| + |b|); two empty ones have."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return n == m
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return 9 * int(np.count_nonzero(both[1:] == both[:-1])) >= 4 * (n + m)


def plan_probes(fps: DataFrame, tau: int) -> list[tuple[int, int, int]]:
    """(partition, mask, flip) of every probe, for the number of partitions and the thresholds that cost least by the estimates."""
    both, n = bit_statistics(fps)
    best = None
    for parts in range(2, tau + 2):
        groups = group_bits(both, n, parts)
        cost = estimates(both, n, groups, [0.0] * parts, tau)
        limits = allocate(cost, tau)
        total = sum(cost[i, t + 1] for i, t in enumerate(limits))
        if best is None or total < best[0]:
            best = (total, groups, limits)
    _, groups, limits = best
    return [(i, _signed(sum(1 << b for b in g)), _signed(x)) for i, (g, t) in enumerate(zip(groups, limits, strict=True)) if t >= 0 for x in _flips(g, t)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (places a, b of n nodes, nearest first) span the components that they form. Each round every component takes its first edge to another."""
    label, taken = np.arange(n), []
    left = np.arange(len(a))
    while len(left):
        la, lb = label[a[left]], label[b[left]]
        out = la != lb
        left, la, lb = left[out], la[out], lb[out]
        if not len(left):
            break
        first = np.full(n, len(left))
        np.minimum.at(first, la, np.arange(len(left)))
        np.minimum.at(first, lb, np.arange(len(left)))
        for e in np.unique(first[first < len(left)]):  # fewer than components
            x, y = int(la[e]), int(lb[e])
            while label[x] != x:
                x = int(label[x])
            while label[y] != y:
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                taken.append(left[e])
        while (label[label] != label).any():
            label = label[label]
    return np.array(taken, "i8")


def _near(x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, tau: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of the candidate pairs of the sketches x[own] with x (rows: nodes, columns: tables)."""
    rows, cols, dist = [], [], []
    for i in range(0, len(own), 512):
        at = own[i : i + 512]
        d = np.bitwise_count(x[at, None, k] ^ y[None, :, k])
        r, c = np.nonzero(d <= tau)
        far = sum(np.bitwise_count(x[at[r], j] ^ y[c, j]).astype("i4") for j in range(x.shape[1]))
        ok = far <= total
        rows.append(at[r[ok]]), cols.append(c[ok]), dist.append(far[ok])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def candidates(nodes: DataFrame, scratch: Scratch, tau: int = TAU, mean: int = MEAN, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between candidates of nodes (id, f0, f1, ..): in every cell a spanning forest of its candidate pairs, the nearest first.

    A node is at home in the cell of its own bits and visits those within the partition's threshold; residents are compared with all. Cells whose
    rows number more than `block` are dealt into blocks by a hash, and every block of residents meets every block of rows.
    """
    sk = [f"f{k}" for k in range(TABLES)]
    made = None
    for k in range(TABLES):
        probes = plan_probes(nodes.select(F.col(sk[k]).alias("fp")), tau)
        fp = F.col(sk[k])
        cells = F.array(*[F.struct(F.lit(p).alias("part"), fp.bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(x)).alias("value"), F.lit(x == 0).alias("own")) for p, m, x in probes])
        # cells are counted by the residents of the cells around them, far fewer rows than the probes
        homes = F.array(*[F.struct(F.lit(p).alias("part"), fp.bitwiseAND(F.lit(m)).alias("value")) for p, m, x in probes if x == 0])
        own = nodes.select(F.explode(homes).alias("c")).groupBy("c.part", "c.value").agg(F.count("*").alias("n"))
        flips: dict[int, list[int]] = {}
        for p, _, x in probes:
            flips.setdefault(p, []).append(x)
        around = F.element_at(F.array(*[F.array(*[F.lit(x) for x in flips.get(p, [0])]) for p in range(max(flips) + 1)]), F.col("part") + 1)
        sizes = own.select("part", "n", F.explode(F.transform(around, lambda x: F.col("value").bitwiseXOR(x))).alias("value")).groupBy("part", "value").agg(F.sum("n").alias("n"))
        hot = scratch.cut(sizes.where(F.col("n") > block).select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
        rows = nodes.select("id", *sk, F.explode(cells).alias("c")).select(F.lit(k).alias("k"), "c.*", "id", *sk).join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        grid = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), "own", F.lit(True).alias("seen"))))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        as_seen = F.transform(every, lambda x: F.struct(x.alias("x"), mine.alias("y"), F.lit(False).alias("own"), F.lit(True).alias("seen")))
        as_own = F.transform(every, lambda y: F.struct(mine.alias("x"), y.alias("y"), F.lit(True).alias("own"), F.lit(False).alias("seen")))
        dealt = rows.withColumn("g", grid.when(F.col("own"), F.concat(as_seen, as_own)).otherwise(as_seen)).select("k", "part", "value", "id", *sk, F.explode("g").alias("g"))
        dealt = dealt.select("k", "part", "value", "g.x", "g.y", F.struct("id", *sk, "g.own", "g.seen").alias("r"))
        made = dealt if made is None else made.union(dealt)
    total = TABLES * mean

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = flat.field("id").to_numpy(zero_copy_only=False)
            x = np.stack([flat.field(s).to_numpy(zero_copy_only=False).view("u8") for s in sk], 1)
            own, seen = (flat.field(s).to_numpy(zero_copy_only=False) for s in ("own", "seen"))
            ks = b.column(0).to_numpy()
            left, right = [np.array([], "i8")], [np.array([], "i8")]
            for i in range(b.num_rows):
                lo, hi = ends[i], ends[i + 1]
                o = np.flatnonzero(own[lo:hi])
                if not len(o) or hi - lo < 2:
                    continue
                r, c, d = _near(x[lo:hi], x[lo:hi], o, int(ks[i]), tau, total)
                ok = seen[lo:hi][c] & (ids[lo:hi][r] != ids[lo:hi][c])
                r, c, d = r[ok], c[ok], d[ok]
                if not len(r):
                    continue
                order = np.argsort(d, kind="stable")
                names, at = np.unique(ids[lo:hi], return_inverse=True)  # a node may be there as resident and as one of all
                r, c = at[r[order]], at[c[order]]
                keep = forest(len(names), r, c)
                left.append(names[r[keep]]), right.append(names[c[keep]])
            p, q = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])

    met = made.groupBy("k", "part", "value", "x", "y").agg(F.collect_list("r").alias("rs"), F.count_if(F.col("r.own")).alias("residents")).where("residents > 0 and size(rs) > 1")
    return met.select("k", "rs").mapInArrow(run, "a long, b long").distinct()


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "u8")


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose ends have Jaccard >= 0.8. sets: id, h (sorted hashes as bytes). A node of many edges splits like any skewed join."""

    def run(batches):
        for b in batches:
            ok = np.fromiter((similar(_set(x), _set(y)) for x, y in zip(b.column(2), b.column(3), strict=True)), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    both = edges.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")).hint("merge"), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def apart(members: DataFrame, sets: DataFrame, block: int = SETS) -> DataFrame:
    """Similar pairs (a, b) across the parts of candidate groups that aren't linked yet. members: root, id, part, f0, f1, ..

    Every such pair has an end outside its group's largest part, so those nodes meet the whole group, block by block; a task gives out only edges that join parts.
    """
    sk = [f"f{k}" for k in range(TABLES)]
    parts = members.groupBy("root", "part").agg(F.count("*").alias("n"))
    groups = parts.groupBy("root").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts"))
    groups = groups.where((F.col("parts") > 1) & (F.col("all") > 2)).select(
        "root", F.col("most.part").alias("largest"), F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("xs"), F.ceil(F.col("all") / block).cast("int").alias("ys")
    )
    rows = members.join(groups, "root").join(sets.hint("merge"), "id").withColumn("hash", F.xxhash64("id"))
    cols = ["root", "x", "y", "own", "id", "part", *sk, "h"]
    left = rows.where(F.col("part") != F.col("largest")).select("*", F.pmod("hash", "xs").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(True).alias("own"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.pmod("hash", "ys").cast("int").alias("y"), F.lit(False).alias("own"))

    def run(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy(zero_copy_only=False)
        ids, part, hs = t.column("id").to_numpy(), t.column("part").to_numpy(), [_set(x) for x in t.column("h")]
        x = np.stack([t.column(s).to_numpy().view("u8") for s in sk], 1)
        names, at = np.unique(part, return_inverse=True)
        label = np.arange(len(names))

        def find(p: int) -> int:
            while label[p] != p:
                p = int(label[p])
            return p

        a, b = [], []
        others = np.flatnonzero(~own)
        for i in np.flatnonzero(own):
            d = sum(np.bitwise_count(x[others, j] ^ x[i, j]).astype("i4") for j in range(len(sk)))
            for j in others[np.argsort(d, kind="stable")]:
                p, q = find(int(at[i])), find(int(at[j]))
                if p != q and similar(hs[i], hs[j]):
                    label[max(p, q)] = min(p, q)
                    a.append(int(ids[i])), b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.select(cols).union(right.select(cols)).groupBy("root", "x", "y").applyInArrow(run, "a long, b long")


def linked(nodes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root) for the nodes in groups: components of pairs of Jaccard >= 0.8 within groups of candidates. nodes: id, f0, f1, ..; texts: id, text."""
    edges = scratch.cut(candidates(nodes, scratch))
    group = scratch.cut(components(edges, scratch))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["id", "h"])

    sets = scratch.cut(texts.join(group.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, h binary"), few="id")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    middle = group.join(degree, "node").groupBy("root").agg(F.max(F.struct("n", (-F.col("node")).alias("node"))).alias("m")).select("root", (-F.col("m.node")).alias("middle"))
    star = group.join(middle, "root").where("node <> middle").select(F.col("node").alias("a"), F.col("middle").alias("b"))
    star = scratch.cut(verified(star, sets), few="a")
    held = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for end in ("a", "b"):
        edges = edges.join(held.select(F.col("node").alias(end), F.lit(True).alias(f"held_{end}")), end, "left")
    rest = verified(edges.where("held_a is null or held_b is null").select("a", "b"), sets)
    sure = scratch.cut(star.union(rest), few="a")
    part = scratch.cut(components(sure, scratch))
    members = group.join(part.select("node", F.col("root").alias("part")), "node", "left").select("root", F.col("node").alias("id"), F.coalesce("part", "node").alias("part"))
    more = scratch.cut(apart(members.join(nodes, "id"), sets), few="a")
    if more.isEmpty():  # a look at a written table
        return part
    out = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each group of near-duplicates, all columns kept, whatever their names.

    Documents link if the Jaccard similarity of their distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle) is 0.8 or more and SimHash makes them
    candidates of one group. Documents with equal shingle sets always link, so do all texts without words (null and empty). The row with the least doc_id of a group stays
    (nulls last; of equal ones any one), so repeated rows leave one. An empty table gives an empty one. Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    sk = [f"f{k}" for k in range(TABLES)]

    def run(batches):
        for b in batches:
            sets = [shingles(x.as_py()) for x in text_of(b, "row.text")]
            name = np.fromiter((xxhash.xxh3_64_intdigest(h.tobytes(), SEED) for h in sets), "u8", len(sets)).view("i8")
            fps = np.array([sketches(h) for h in sets], "i8").reshape(-1, TABLES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name), *(pa.array(fps[:, k]) for k in range(TABLES))], [*b.schema.names, "name", *sk])

    boxed = docs.select(F.struct("*").alias("row"))
    out = T.StructType([*boxed.schema.fields, *(T.StructField(n, T.LongType()) for n in ("name", *sk))])
    whole = scratch.cut(boxed.mapInArrow(run, out).select("row", "row.doc_id", "name", *sk, F.monotonically_increasing_id().alias("at")))
    slim = whole.select("doc_id", "name", *sk, "at")
    nodes = scratch.cut(slim.groupBy("name", *sk).agg(F.min("at").alias("id")))  # a set is told apart by 192 bits
    found = scratch.cut(linked(nodes.select("id", *sk), whole.select(F.col("at").alias("id"), "row.text"), scratch))
    named = scratch.cut(nodes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("name", *sk, F.coalesce("root", "id").alias("root")))
    scratch.keep(whole, named)
    rooted = slim.join(named.hint("merge"), ["name", *sk]).select("doc_id", "at", "root")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("best"))
    best = scratch.cut(best.select("best.at"))
    scratch.keep(whole, best)
    # neither side has a bound, so neither is broadcast
    return whole.join(best.hint("merge"), "at", "left_semi").select("row.*")
