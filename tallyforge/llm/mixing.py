"""Mixing sources to target weights by entropy balancing.

Document d of source s gets the rate r = min(most, exp(lambda_s * size_d / mean size of s)): of all rates with the source's token target
those nearest to 1 in relative entropy, under the bound. lambda solves the convex dual, by Newton steps kept inside a bracket; every step
is one distributed sum for all sources that aren't solved yet. Rates become whole copies: the whole part, and one more for the documents whose hash, over the rest of the
rate, is least, up to the place where the source's words reach the target; what a long document leaves open there is filled with shorter ones, with a copy beyond their rate where there are no others.

Sources stay in tables, as many as there may be; the driver sees sums and counts only.
"""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_key, n_words, running, unit_hash

WEIGHTS = [1.0, 2.0, 3.0]
#: A source is solved when its expected words are within this share of the target, and filled when its whole copies are.
EXACT, NEAR = 1e-7, 0.001
#: Newton and bisection steps need about 10, at worst some 70 to halve the bracket down to nothing. More is an error.
ROUNDS = 200
#: Bounds of lambda; beyond them every rate is 0 or the most.
FAR = 3000.0
#: Rows that a task sorts, about.
TASK_ROWS = 200_000


def sid() -> Column:
    """A name for the source that isn't null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1))


def targets(sources: DataFrame, scratch: Scratch, weights: list[float], most: float, n: int) -> DataFrame:
    """Adds target to sources (sid, source, size, docs), n of them. Weights go round the sources in code point order, null last; no target passes `most` times its
    source's size, what is over is dealt again by weight until none is above."""
    ranked = running(sources.select("*", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one")), ["last", "source"], "one", scratch, _tasks(sources, n))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = scratch.cut(ranked.select("sid", "size", "docs", weight.alias("weight")))
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each, capped = 0.0, -1
    while True:  # the level rises and so more sources are at their bound, until none is added
        over = F.col("weight") * F.lit(each) > F.col("size") * F.lit(float(most))
        over = over | (F.col("size") == 0)
        at_bound, held, free = ranked.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if at_bound == capped or free <= 0:
            break
        each, capped = (total - float(most) * held) / free, at_bound
    return ranked.select("sid", "size", "docs", F.least(F.col("weight") * F.lit(each), F.col("size") * F.lit(float(most))).alias("target"))


def _rate(most: float) -> Column:
    """Of a document with the columns size, tilt and mean (of its source)."""
    x = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most) + 1))
    return F.when(F.col("tilt").isNull() | (F.col("size") <= 0), 1.0).otherwise(F.least(F.lit(float(most)), F.exp(x)))


def solve(sizes: DataFrame, sources: DataFrame, scratch: Scratch, most: float, n: int) -> DataFrame:
    """Adds mean and tilt (lambda) to sources (sid, size, docs, target), n of them. sizes: sid, size, n (documents of that size). Raises if a source isn't solved after ROUNDS steps."""
    size, target = F.col("size"), F.col("target")
    full, none = target >= size * F.lit(most * (1 - 1e-12)), target <= 0
    begin = F.when(size == 0, 0.0).when(none, F.lit(-20 * FAR)).when(full, F.lit(20 * FAR)).otherwise(F.log(F.greatest(target, F.lit(1e-300)) / F.greatest(size, F.lit(1))))
    state = sources.select("sid", F.col("size").alias("source_size"), "target", (size / F.greatest("docs", F.lit(1))).alias("mean"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"), begin.alias("tilt"), ((size > 0) & ~none & ~full).alias("open"))
    is_open = F.count_if("open")
    state, seen = scratch.cut_and_see(state, open=is_open)
    rate = _rate(most)
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")  # noqa: E731  the same whatever the order
    for _ in range(ROUNDS):
        if not seen["open"]:
            return state.select("sid", "source_size", "target", "mean", "tilt")
        inner = F.when(rate < most, rate).otherwise(0.0)
        met = by_key(sizes, state.where("open").select("sid", "tilt", "mean"), n, "sid")
        sums = met.groupBy("sid").agg(exact(F.col("n") * rate * size).alias("g"), exact(F.col("n") * inner * size * size / F.col("mean")).alias("h"))
        miss = F.col("g") - target
        now = by_key(state, sums, n, "sid", "left", ["sid"]).withColumn("done", ~F.col("open") | (F.abs(miss) <= EXACT * target))
        now = now.withColumn("low2", F.when(miss > 0, F.col("low")).otherwise(F.col("tilt"))).withColumn("high2", F.when(miss > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.when(F.col("h") > 0, F.col("tilt") - miss / F.col("h"))
        step = F.when((step > F.col("low2")) & (step < F.col("high2")) & (F.abs(step - F.col("tilt")) < 20), step).otherwise((F.col("low2") + F.col("high2")) / 2)
        new, seen = scratch.cut_and_see(now.select(
            "sid", "source_size", "target", "mean", F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")).alias("high"),
            F.when(F.col("done"), F.col("tilt")).otherwise(step).alias("tilt"), (~F.col("done")).alias("open"),
        ), open=is_open)
        scratch.release(state)
        state = new
    raise RuntimeError(f"mixing: a source's rates aren't solved after {ROUNDS} steps")


def _queue(rate: Column) -> Column:
    """Where a document stands in the queue for one more copy; null if its rate is whole."""
    rest = rate - F.floor(rate)
    return F.when(rest > 0, F.col("h") / rest)


_LIMITS = "array<struct<key:double,size:bigint>>"


def _within(limits: str, key: Column) -> Column:
    """Whether a document with this key is one that the limits take."""
    return F.coalesce(F.exists(limits, lambda x: (key < x["key"]) & (F.col("size") <= x["size"])), F.lit(False))


def _fill(queue: DataFrame, wanted: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """queue: sid, size, key (a document's place); wanted: sid, target, need (words). Gives sid, target, need (what is left of it), limits: the documents taken are those before a limit's key and up to its size.

    The documents of a source are numbered in words by their place, in ranges, so a hot source is split. The first limit is where the words reach the need. Then documents of at most
    half of what is missing go on from there, again and again, so that what is missing halves each time.
    """
    is_open = F.count_if("open")
    state, seen = scratch.cut_and_see(wanted.select("sid", "target", "need", F.lit(-1.0).alias("key"), F.floor("need").cast("long").alias("most_size"), F.array().cast(_LIMITS).alias("limits"), (F.col("need") >= 1).alias("open")), open=is_open)
    while seen["open"]:
        look = state.where("open").select("sid", "need", F.col("key").alias("from"), "most_size")
        rows, met = scratch.cut_and_see(by_key(queue, look, n, "sid").where("key >= from and size <= most_size").select("sid", "key", "size", "need"), rows=F.count(F.lit(1)))
        line = running(rows, ["sid", "key", "size"], "size", scratch, _tasks(rows, met["rows"]))
        starts = line.groupBy("sid").agg(F.min("before").alias("start"))
        over = by_key(line, starts, n, "sid").where(F.col("before") - F.col("start") + F.col("size") > F.col("need")).groupBy("sid").agg(F.min("key").alias("at"))
        ends = rows.groupBy("sid").agg(F.lit(True).alias("met")).join(over, "sid", "left").select("sid", F.coalesce("at", F.lit(float("inf"))).alias("at"))
        ends = scratch.cut(ends)
        took = by_key(rows, ends, n, "sid").where("key < at").groupBy("sid").agg(F.sum("size").alias("took"))
        new = state.join(ends, "sid", "left").join(took, "sid", "left")
        met = F.col("open") & F.col("at").isNotNull()
        left = F.col("need") - F.coalesce("took", F.lit(0))
        new, seen = scratch.cut_and_see(new.select(
            "sid", "target", F.when(met, left).otherwise(F.col("need")).alias("need"), F.when(met, F.col("at")).otherwise(F.col("key")).alias("key"), F.when(met, F.floor(left / 2).cast("long")).otherwise(F.col("most_size")).alias("most_size"),
            F.when(met, F.concat("limits", F.array(F.struct(F.col("at").alias("key"), F.col("most_size").alias("size"))))).otherwise(F.col("limits")).alias("limits"),
            (met & (F.col("at") < float("inf")) & (left > NEAR * F.col("target")) & (left >= 2)).alias("open"),
        ), open=is_open)
        scratch.release(state, rows, ends)
        state = new
    return state


def round_rates(slim: DataFrame, params: DataFrame, scratch: Scratch, most: float, n: int) -> DataFrame:
    """Adds to params who gets one more copy than its rate's whole part: `limits` of the queue, and `also`, the key of one document more (or null); and who gets still one more, `second`.

    The queue is filled up to the source's target. If that leaves words open, the one document of the queue that comes nearest is taken, if it helps. What is open then, because the
    rest of the queue is too long, goes to documents with copies left, in the order of their hashes.
    """
    rate = _rate(most)
    rated = scratch.cut(by_key(slim, params.select("sid", "tilt", "mean"), n, "sid", salt=["h"]).where("size > 0").select("sid", "size", "h", F.floor(rate).cast("int").alias("whole"), _queue(rate).alias("key")))
    base = rated.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    queue = rated.where("key is not null").select("sid", "size", "key")
    state = _fill(queue, params.join(base, "sid").select("sid", "target", (F.col("target") - F.col("base")).alias("need")), scratch, n)
    out = params.join(state.select("sid", "limits"), "sid", "left")
    short = state.where(F.col("need") > NEAR * F.col("target")).select("sid", "target", "need", "limits")
    if short.isEmpty():
        return scratch.cut(out.select("*", F.lit(None).cast("double").alias("also"), F.array().cast(_LIMITS).alias("second")))
    near = F.abs(F.col("size") - F.col("need"))
    spare = by_key(queue, short, n, "sid", salt=["key", "size"]).where(~_within("limits", F.col("key"))).where(near < F.col("need"))
    best = scratch.cut(spare.groupBy("sid").agg(F.min(F.struct(near.alias("miss"), "key", "size")).alias("best")).select("sid", F.col("best.key").alias("also"), F.col("best.size").alias("more")))
    still = short.join(best, "sid", "left").select("sid", "target", (F.col("need") - F.coalesce("more", F.lit(0))).alias("need"), "limits", "also").where(F.col("need") > NEAR * F.col("target"))
    still = scratch.cut(still)
    copies = F.col("whole") + (_within("limits", F.col("key")) | F.coalesce(F.col("key") == F.col("also"), F.lit(False))).cast("int")
    rest = by_key(rated, still.select("sid", "limits", "also"), n, "sid", salt=["h"]).where(copies < most).select("sid", "size", F.col("h").alias("key"))
    second = _fill(rest, still.select("sid", "target", "need"), scratch, n)
    out = out.join(best.select("sid", "also"), "sid", "left").join(second.select("sid", F.col("limits").alias("second")), "sid", "left")
    return scratch.cut(out.select(*params.columns, "limits", "also", F.coalesce("second", F.array().cast(_LIMITS)).alias("second")))


def fit(docs: DataFrame, scratch: Scratch, weights: list[float], most: float) -> tuple[DataFrame, DataFrame, int]:
    """Slim rows (doc_id, source, sid, size, h), a row for each source (sid, source_size, target, mean, tilt, limits, also, second), both written, and the number of sources."""
    slim = scratch.cut(docs.select("doc_id", "source", sid().alias("sid"), n_words().alias("size"), unit_hash("doc_id", "text").alias("h")), few="h")
    sizes = scratch.cut(slim.groupBy("sid", "source", "size").agg(F.count("*").alias("n")))
    sources, seen = scratch.cut_and_see(sizes.groupBy("sid", "source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs")), n=F.count(F.lit(1)))
    n = seen["n"]
    params = solve(sizes, targets(sources, scratch, weights, most, n), scratch, most, n)
    params = round_rates(slim, params, scratch, most, n)
    scratch.keep(slim, params)
    return slim, params, n


def _copies(rows: DataFrame, params: DataFrame, most: float, n: int) -> DataFrame:
    """rows with source_size, target, rate and copies."""
    out = by_key(rows, params, n, "sid", "left", ["h"])
    rate = _rate(most)
    key = _queue(rate)
    first = F.floor(rate).cast("int") + (_within("limits", key) | F.coalesce(key == F.col("also"), F.lit(False))).cast("int")
    return out.select(*rows.columns, "source_size", "target", rate.alias("rate"), F.least(first + _within("second", F.col("h")).cast("int"), F.lit(int(most))).alias("copies"))


def mix(docs: DataFrame, weights: list[float] | None = None, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size (words, 0 for a null text), source_size, target, rate, copies, taken (copies x size).

    A null source is a source of its own. Documents without words are taken once; a source without words has target 0. Repeated rows get
    the same rate and, as their hashes are equal, the same copies. Reruns agree: hashes depend on doc_id and text, sums are exact. Other columns aren't read; an empty table gives an empty result.
    """
    slim, params, n = fit(docs, Scratch(docs.sparkSession, "mixing"), weights or WEIGHTS, most)
    return _copies(slim, params, most, n).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: list[float] | None = None, most: float = 3.0) -> DataFrame:
    """The documents of the mix, each as often as its copies say, all columns kept whatever their names."""
    _, params, n = fit(docs, Scratch(docs.sparkSession, "mixing"), weights or WEIGHTS, most)
    rows = docs.select(F.struct("*").alias("row"), sid().alias("sid"), n_words().alias("size"), unit_hash("doc_id", "text").alias("h"))
    taken = _copies(rows, params, most, n).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
