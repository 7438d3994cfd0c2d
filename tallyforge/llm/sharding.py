"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents of one group (equal texts) are linked to each other. They start on shards chosen by a hash. In each round a join tells every
document of a group how the group's bytes lie over the shards; what isn't on the group's fullest shard wants to go there, and moves as far as that
shard's quota lets it, until no more bytes get nearer. Shards that are over their quota then give documents back. These, with the unlinked documents, even out the
shards: long ones go one by one to the emptiest shard, longest first, and short ones fill what is left to equal bytes. Unlinked documents so long that nothing evens them out later come
before all others and count against the quotas.
"""
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running, unit_hash

LAW = "bytes"
#: A group larger than this share of a shard is spread over more than one.
FILL = 0.8
#: A document of more than this share of a shard is long. There are fewer long ones than shards / LONG, whatever the table's size, so they are dealt on the driver.
LONG = 0.001
#: Unlinked documents of more than this share of a shard are dealt first. So much of all bytes must be left to even out with: where unlinked documents have less, linked ones don't fill the shards.
FIRST, SPARE = 0.05, 0.1
#: Rows that a task numbers, about.
TASK_ROWS = 200_000


def _by_shard(pairs: dict[int, float], shards: int):
    """A column: the value for the shard in the column p."""
    return F.element_at(F.array(*[F.lit(float(pairs.get(i, 0.0))) for i in range(shards)]), F.col("p") + 1)


def propagate(linked: DataFrame, scratch: Scratch, shards: int, quotas: list[float]) -> DataFrame:
    """linked: at, g, size, h, shard, written by scratch. Moves documents between shards; no shard that isn't over its quota gets over it but by chance of the hashes.

    Ends when no document wants to move, or when a round has brought the bytes that want to move down by less than a hundredth: the quotas hold the rest back.
    """
    state, pending, k = linked, float("inf"), 0
    quota = max(quotas)
    while True:
        k += 1
        blocks = scratch.cut(state.groupBy("g", "shard").agg(F.sum("size").alias("b")))  # by group and shard, before the groups meet
        load = {r["shard"]: float(r["b"]) for r in blocks.groupBy("shard").agg(F.sum("b").alias("b")).collect()}  # one row a shard
        # the fullest shard of the group, or as many of the fullest as a large group needs; equally full ones in the order of a hash
        order = F.sort_array(F.collect_list(F.struct("b", F.xxhash64("g", "shard").alias("tie"), "shard")), asc=False)  # one entry a shard at most
        tops = blocks.groupBy("g").agg(order.alias("all"), F.sum("b").alias("bytes")).where(F.size("all") > 1)
        tops = tops.select("g", F.slice(F.transform("all", lambda x: x["shard"]), F.lit(1), F.least(F.size("all"), F.ceil(F.col("bytes") / (quota * FILL)).cast("int"))).alias("top"))
        wants = blocks.join(tops, "g").where(~F.array_contains("top", F.col("shard")))
        asks = {r["p"]: float(r["b"]) for r in wants.select(F.explode("top").alias("p"), (F.col("b") / F.size("top")).alias("b")).groupBy("p").agg(F.sum("b").alias("b")).collect()}
        gives = {r["shard"]: float(r["b"]) for r in wants.groupBy("shard").agg(F.sum("b").alias("b")).collect()}
        waiting = sum(gives.values())
        if not asks or waiting > 0.99 * pending:
            scratch.release(blocks)
            break
        pending = waiting
        share = {p: max(0.0, min(1.0, (quotas[p] - load.get(p, 0.0) + 0.5 * gives.get(p, 0.0)) / a)) for p, a in asks.items()}
        # a block moves whole to one shard, unless its group is large: then its documents move one by one to the group's shards
        joined = state.join(wants.select("g", "shard", "top"), ["g", "shard"], "left")
        p = F.element_at("top", (F.pmod(F.col("h"), F.size("top")) + 1).cast("int"))
        luck = F.when(F.size("top") > 1, unit_hash("h", F.lit(k))).otherwise(unit_hash("g", "shard", F.lit(k)))
        joined = joined.select("at", "g", "size", "h", "shard", p.alias("p"), luck.alias("luck"))
        new = scratch.cut(joined.select("at", "g", "size", "h", F.when(F.col("p").isNotNull() & (F.col("luck") < _by_shard(share, shards)), F.col("p")).otherwise(F.col("shard")).alias("shard")))
        scratch.release(state, blocks)
        state = new
    return state


def _deal(long_: list[tuple[int, int]], held: list[float]) -> list[tuple[int, int]]:
    """(at, shard) of each long document (at, size): the longest first, each to the shard with the fewest bytes. Adds their bytes to held."""
    heap = [(b, s) for s, b in enumerate(held)]
    heapq.heapify(heap)
    out = []
    for at, size in sorted(long_, key=lambda x: (-x[1], x[0])):
        b, s = heapq.heappop(heap)
        out.append((at, s))
        held[s] = b + size
        heapq.heappush(heap, (held[s], s))
    return out


def _level(held: list[float], total: float) -> float:
    """The bytes of every shard that isn't fuller already, if all shards together have `total`."""
    full = sorted(held)
    n = len(full)
    while n > 1 and full[n - 1] > (total - sum(full[n:])) / n:
        n -= 1
    return (total - sum(full[n:])) / n


def assign(docs: DataFrame, shards: int = 40, group: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Sizes (UTF-8 bytes of the text and 16; a null text has 16 and a null crc32) are nearly equal over the shards: within about a thousandth of the mean, unless linked
    groups or single documents are too large for that. Documents with equal texts are linked (null texts are not, empty ones are); a group larger than a shard is spread over
    as few as its quota allows. Slots count the documents of a shard from 0, by doc_id (null first). Repeated rows are documents of their own. Other columns are not read; an empty table gives an empty result.
    group: a column that names the linked group instead of the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    key = F.col(group) if group else F.col("text")
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.when(key.isNotNull(), F.sha2(key.cast("string"), 256)).alias("g"),
    )
    slim = scratch.cut(slim.withColumn("at", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("doc_id", "g", "at")))
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1))
    least = LONG * total / shards
    # written before the join: a join with an aggregate by the same key can't be split where a group is large
    many = scratch.cut(slim.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    lone = slim.where(F.col("size") > FIRST * total / shards).select("at", "size", "g").join(many, "g", "left_anti")
    held = [0.0] * shards
    dealt = _deal([(r["at"], r["size"]) for r in lone.collect()], held)  # fewer than shards / FIRST
    quota = _level(held, total)
    linked = slim.select("at", "g", "size", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard")).join(many, "g", "left_semi").select("at", "g", "size", "h", "shard")
    linked = scratch.cut(linked)
    free = total - sum(held) - linked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fill = 1 - max(0.0, SPARE - free / max(total, 1))
    quotas = [max(0.0, fill * quota - b) for b in held]
    state = propagate(linked, scratch, shards, quotas)
    load = {r["shard"]: float(r["b"]) for r in state.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    over = {s: max(0.0, (b - quotas[s]) / b) if b else 0.0 for s, b in load.items()}
    p = F.col("shard").alias("p")
    stay = scratch.cut(state.select("at", "size", "h", p).where(unit_hash("h", F.lit("back")) >= _by_shard(over, shards)).select("at", "p", "size"))
    for r in stay.groupBy("p").agg(F.sum("size").alias("b")).collect():
        held[r["p"]] += float(r["b"])
    first = spark.createDataFrame(dealt, "at long, p int")
    rest = slim.select("at", "size", "h").join(stay.select("at"), "at", "left_anti").join(F.broadcast(first), "at", "left_anti")
    dealt = _deal([tuple(r) for r in rest.where(F.col("size") > least).select("at", "size").collect()], held)  # fewer than shards / LONG
    line = running(rest.where(F.col("size") <= least), ["h", "at"], "size", scratch, tasks)
    room = [max(0.0, _level(held, total) - b) for b in held]
    left, free = float(total - sum(held)), sum(room)
    ends, upto = [], 0.0
    for r in room:
        upto += r * (left / free if free else 1.0)
        ends.append(upto)
    middle = F.col("before") + F.col("size") / 2
    filled = line.select("at", F.least(F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda n, e: n + (e <= middle).cast("int")), F.lit(shards - 1)).alias("p"))
    placed = stay.select("at", "p").union(first).union(spark.createDataFrame(dealt, "at long, p int")).union(filled)
    full = scratch.cut(slim.join(placed.hint("merge"), "at").select("doc_id", "size", "text_crc32", F.col("p").alias("shard"), "at", F.lit(1).cast("long").alias("one")))
    counted = running(full, ["shard", "doc_id", "at"], "one", scratch, tasks)
    starts = counted.groupBy("shard").agg(F.min("before").alias("start"))  # one row a shard
    scratch.release(slim, many, state, stay, full)
    return counted.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
