"""Duplicate records: fingerprints and scored candidate pairs."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of each kind of agreement and the score of a candidate.
POINTS = {"hash": 100, "merchant": 20, "total": 25, "date": 20, "time": 15, "high": 30, "medium": 15}
CANDIDATE = 70
# Equal records that travel in one row while pairs are sought.
UNIT = 64
# Up to so many names two of them make a key; beyond, one does, as pairs of names would be too many.
FEW = 16


def content_fingerprint(merchant: Column, date: Column, time: Column, total: Column, n: Column) -> Column:
    money = F.coalesce(F.format_string("%.2f", total), F.lit(""))
    return F.sha2(F.concat_ws("|", F.coalesce(merchant, F.lit("")), F.coalesce(date, F.lit("")), F.coalesce(time, F.lit("")), money, n.cast("string")), 256)


def item_signature(items: DataFrame) -> DataFrame:
    """receipt_id, names: up to 80 distinct item names in order."""
    return items.groupBy("receipt_id").agg(F.slice(F.sort_array(F.collect_set("raw_name")), 1, 80).alias("names"))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _points(a: str, b: str, total: Column) -> Column:
    """The points of all but the names."""
    same = _same(a, b)
    points = [F.when(same("file_sha256"), POINTS["hash"]), F.when(same("merchant"), POINTS["merchant"]), F.when(total, POINTS["total"]), F.when(same("receipt_date"), POINTS["date"]), F.when(same("receipt_time"), POINTS["time"])]
    return reduce(lambda p, q: p + q, [F.coalesce(p, F.lit(0)) for p in points])


def _same(a: str, b: str):
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return lambda c: F.coalesce((x(c) == y(c)) & (x(c) != ""), F.lit(False))


def score(a: str = "a", b: str = "b") -> Column:
    """Of rows a and b: file_sha256, merchant, grand_total, receipt_date, receipt_time, names; 100 at most."""
    o = overlap(F.col(f"{a}.names"), F.col(f"{b}.names"))
    total = F.coalesce(F.abs(F.col(f"{a}.grand_total").cast("decimal(18,2)") - F.col(f"{b}.grand_total").cast("decimal(18,2)")) <= 0.01, F.lit(False))
    return F.least(_points(a, b, total) + F.when(o >= 0.75, POINTS["high"]).when(o >= 0.45, POINTS["medium"]).otherwise(0), F.lit(100))


def _units(records: DataFrame) -> DataFrame:
    """Records that agree in everything travel together: a row for up to UNIT of them, with their ids in order. Names are distinct, in the order of a hash."""
    names = F.array_distinct(F.coalesce("names", F.array().cast("array<string>")))
    ordered = F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("n")))), lambda x: x["n"])
    same = ["file_sha256", "merchant", "cent", "receipt_date", "receipt_time", "names"]
    cent = (F.col("grand_total").cast("decimal(18,2)") * 100).cast("long")
    r = records.where("id is not null").select("id", "file_sha256", "merchant", cent.alias("cent"), "receipt_date", "receipt_time", ordered.alias("names"))
    # sorted by one number; records whose hashes are equal by chance only share a count of places. A window spills what doesn't fit; a list of all ids of a class would not
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    r = r.withColumn("class", F.xxhash64(*same)).withColumn("unit", F.floor((place - 1) / UNIT))
    return r.groupBy("class", "unit", *same).agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("class", "unit")


def _lead(names: Column, share: int) -> Column:
    """The first names of which sets that overlap by 0.75 have at least `share` in common: such sets share ceil(0.75 n) names of n, and any order puts that many of those first."""
    n = F.size(names)
    return F.slice(names, F.lit(1), n - F.floor((n * 3 + 3) / 4).cast("int") + share)


# Kinds of blocks: equal files; three of merchant, total, date and time; names with merchant and date, or with the total.
_FILE, _MTD, _MDH, _MTH, _TDH, _SHOP, _TOTAL = range(7)


def _block(kind: int, of: dict[str, Column], *names: Column) -> Column:
    """The key of a block: a hash. `of`: merchant, receipt_date, receipt_time, file_sha256, and cents as the number of eight of them."""
    parts = {_FILE: ["file_sha256"], _MTD: ["merchant", "eight", "receipt_date"], _MDH: ["merchant", "receipt_date", "receipt_time"], _MTH: ["merchant", "eight", "receipt_time"], _TDH: ["eight", "receipt_date", "receipt_time"], _SHOP: ["merchant", "receipt_date"], _TOTAL: ["eight"]}
    return F.xxhash64(F.lit(kind), *[of[c] for c in parts[kind]], *names)


def _keyed(units: DataFrame) -> DataFrame:
    """A row for each unit and block of it. Totals meet in spans of eight cents; the last cent of a span stands in the next one too."""
    said = lambda c: F.col(c) != ""
    cent, names, n = F.col("cent"), F.col("names"), F.size("names")
    of = lambda up: {c: F.col(c) for c in ("file_sha256", "merchant", "receipt_date", "receipt_time")} | {"eight": F.shiftright(cent, 3) + up}
    needs = {_FILE: said("file_sha256"), _MTD: said("merchant") & said("receipt_date"), _MDH: said("merchant") & said("receipt_date") & said("receipt_time"), _MTH: said("merchant") & said("receipt_time"), _TDH: said("receipt_date") & said("receipt_time"), _SHOP: said("merchant") & said("receipt_date"), _TOTAL: F.lit(True)}
    spans = lambda kind: [(0, F.lit(True))] if kind in (_FILE, _MDH, _SHOP) else [(0, cent.isNotNull()), (1, cent.bitwiseAND(7) == 7)]
    alone = [F.when(needs[k] & when, _block(k, of(up))) for k in (_FILE, _MTD, _MDH, _MTH, _TDH) for up, when in spans(k)]
    # a key's names: both of each pair of the leading ones, or the single one, or each leading one of many
    one, two = _lead(names, 1), _lead(names, 2)
    pairs = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.xxhash64(x, y))))
    marks = F.concat(F.when(n.between(2, FEW), pairs).otherwise(F.array().cast("array<bigint>")), F.when((n == 1) | (4 * n > 3 * FEW), F.transform(one, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    each = lambda x: F.array(*[F.when(needs[k] & when, _block(k, of(up), x)) for k in (_SHOP, _TOTAL) for up, when in spans(k)])
    return units.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(*alone), F.flatten(F.transform(marks, each)))))))


def candidate_pairs(records: DataFrame, least: int = CANDIDATE) -> DataFrame:
    """id_a < id_b, score: pairs of at least `least` points, found by equal keys instead of comparing all.

    Without equal files, 70 points take three of merchant, total, date and time, or two of them and an overlap of item names of 0.75, where the two are merchant and date, or one is the total. Three make
    a block by themselves. Sets that overlap by 0.75 are equal or share two of their first n - ceil(0.75 n) + 2 names in any common order, here that of a hash, so two names of those are part of the
    other keys and blocks stay small also where there are few totals and few names; of more than FEW names one is.

    Equal records meet others once for all of them, and a pair counts only under the one key that its own values give. So pairs are scored where they meet and go straight to the result: no pair is
    shuffled, and both sides of the join read one exchange. Keys are hashes: keys that are equal by chance make units meet, but don't let pairs pass or pass twice.
    """
    if least < 70:
        raise ValueError("the blocking keys are complete from 70 points on")
    # there are ids in each unit, but Spark asks for that where ids_b are exploded; asked on one side only, the sides would not read one exchange
    keyed = _keyed(_units(records).where(F.size("ids") > 0)).hint("merge")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same, near = _same("a", "b"), F.coalesce(F.abs(x("cent") - y("cent")) <= 1, F.lit(False))
    nx, ny = F.size(x("names")), F.size(y("names"))
    points = _points("a", "b", near)
    # in the join only what is quick: points without names, and sizes, which rule most overlaps out. The rest stands in generators, which the optimizer leaves where they are: a join that evaluates
    # all of it is one method too long for the JVM to compile
    quick = (points >= least - POINTS["high"]) & ((4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) | (points >= least - POINTS["medium"]))
    shared = F.size(F.array_intersect(x("names"), y("names")))
    o = F.coalesce(F.try_divide(shared, nx + ny - shared), F.lit(0.0))
    total = F.least(points + F.when(o >= 0.75, POINTS["high"]).when(o >= 0.45, POINTS["medium"]).otherwise(0), F.lit(100))
    of = {c: x(c) for c in ("file_sha256", "merchant", "receipt_date", "receipt_time")} | {"eight": F.shiftright(F.greatest(x("cent"), y("cent")), 3)}
    m, d, h = same("merchant"), same("receipt_date"), same("receipt_time")
    both = lambda share: F.array_intersect(_lead(x("names"), share), _lead(y("names"), share))
    mark = F.when(F.greatest(nx, ny).between(2, FEW), F.xxhash64(F.get(both(2), F.lit(0)), F.get(both(2), F.lit(1)))).otherwise(F.xxhash64(F.get(both(1), F.lit(0))))
    own = F.when(same("file_sha256"), _block(_FILE, of)).when(m & near & d, _block(_MTD, of)).when(m & d & h, _block(_MDH, of)).when(m & near & h, _block(_MTH, of)).when(near & d & h, _block(_TDH, of)).when(m & d, _block(_SHOP, of, mark)).when(near, _block(_TOTAL, of, mark))
    met = (x("key") == y("key")) & (F.get(x("ids"), F.lit(0)) < F.get(y("ids"), F.size(y("ids")) - 1)) & quick
    passed = (F.col("score") >= least) & F.forall(F.array(x("key")), lambda k: k == own)
    sides = [F.struct(*[F.col(f"{t}.{c}") for c in keyed.columns]).alias(t) for t in "ab"]
    scored = keyed.alias("a").join(keyed.alias("b"), met).select(*sides, total.alias("score"))
    first = scored.select(F.explode(F.when(passed, x("ids"))).alias("id_a"), y("ids").alias("ids_b"), "score")
    return first.select("id_a", F.explode("ids_b").alias("id_b"), "score").where("id_a < id_b")
