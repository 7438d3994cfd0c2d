"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates for each language and source.

DataFrame functions only. Each document has a vector of transformed statistics; each group's location and covariance come from the half or
more of its documents that lie nearest to it, found by concentration steps: distances from the estimate so far, a histogram of them, and the moments of
those in the nearest bins. The reweighted estimate gives the Mahalanobis distances by which documents are rejected.
"""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, by_key

SPACE_CHARS = " \t\n\u000b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Share of a group that an estimate is made of, and the least documents of a group with an estimate of its own.
SHARE, LEAST = 0.5, 50
#: Concentration steps end when no group's log determinant falls by more than this. It has a lower bound (the floors), so they do end.
SETTLED = 1e-3
#: Least standard deviation of each transformed statistic: what varies less than this isn't told apart.
FLOOR = {"x_words": 0.25, "x_length": 0.025, "x_symbols": 0.1, "x_lines": 0.06, "x_repeat": 0.08}
NAMES = list(FLOOR)


def chi_squared(tail: float) -> float:
    """The value that a chi-squared number with 5 degrees of freedom exceeds with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > tail else (low, x)
    return low


#: Squared Mahalanobis distance from which on a document is rejected (one normal document in 10^9 lies beyond), and that of the reweighting step.
CUT, REWEIGHT = chi_squared(1e-9), chi_squared(0.025)
#: What the covariance of the nearest half, or of those within REWEIGHT, of a normal sample in 5 dimensions must be multiplied by.
CONSISTENT, REWEIGHTED = 1.912, 1.055


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(ws: Column) -> Column:
    """Number of words in windows of three that occur twice or more. A window's hash in the upper 40 bits and its place in the lower 24
    are sorted as one number; neighbours with equal upper bits are compared by whole hashes. Windows from place 2^24 on use all of the sorted pairs (hash, place)."""
    hashes = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    place = F.lit((1 << 24) - 1).cast("long")

    def count(h: Column) -> Column:
        def from_starts(starts: Column) -> Column:
            total = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3).cast("long"))).alias("n"), p.alias("last")), lambda a: a["n"])
            return F.when(F.size(starts) > 0, total).otherwise(F.lit(0).cast("long"))

        def from_keys(keys: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce((F.shiftright(x, 24) == F.shiftright(y, 24)) & (F.get(h, x.bitwiseAND(place).cast("int")) == F.get(h, y.bitwiseAND(place).cast("int"))), F.lit(False))

            hit = F.filter(keys, lambda x, i: same(x, F.get(keys, i + 1)) | same(x, F.get(keys, i - 1)))
            return _let(F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(place))), from_starts)

        def from_pairs(pairs: Column) -> Column:
            hit = F.filter(pairs, lambda x, i: F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)))
            return _let(F.sort_array(F.transform(hit, lambda x: x["i"].cast("long"))), from_starts)

        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(1 << 24)).cast("long")).bitwiseOR(i.cast("long"))))
        whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) < (1 << 24), _let(packed, from_keys)).otherwise(_let(whole, from_pairs))

    return F.when(F.size(ws) >= 4, _let(F.slice(hashes, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), count)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text (null: all 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))

    def of(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeated(ws).alias("n_repeat_words"))

    def lines(ls: Column) -> Column:
        return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")

    dup = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")), lines)
    s = docs.select("doc_id", "lang", "source", _let(words, of).alias("s"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), (F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    return s.select("doc_id", "lang", "source", "s.n_words", "s.word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words", "n_lines")


def transformed(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the five transformed statistics: logarithms of the number of words and of the mean word length, logarithm of symbols a word, shares of repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = {
        "x_words": F.log1p(F.col("n_words").cast("double")), "x_length": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))), "x_symbols": F.log1p(F.lit(10.0) * F.col("n_symbols") / n),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "x_repeat": F.col("n_repeat_words") / n,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("*", failed.alias("base_failed"), *[v.cast("double").alias(k) for k, v in x.items()])


def _cut_at(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The least value of each key at which the counts up to it reach that share of all, and the part of that value's count which the share needs. counts: one row for each key and value, few values a key."""
    from pyspark.sql import Window as W

    every, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(value)
    c = counts.select(*keys, value, "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("total"))
    need = F.ceil(F.col("total") * F.lit(share))
    part = (need - F.col("upto") + F.col("n")) / F.col("n")
    return c.where(F.col("upto") >= need).groupBy(*keys).agg(F.min(F.struct(value, part.alias("part"))).alias("at")).select(*keys, F.col(f"at.{value}").alias("cut"), "at.part")


def _start(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Medians and scales (from quartiles) of each key, from histograms of bins of 1/256: key, m0.., l00.. (a diagonal matrix)."""
    long_ = scratch.cut(rows.select("key", F.posexplode(F.array(*NAMES)).alias("dim", "x")).groupBy("key", "dim", F.round(F.col("x") * 256).alias("bin")).agg(F.count("*").alias("n")))
    q = [_cut_at(long_, ["key", "dim"], "bin", s).drop("part").withColumnRenamed("cut", f"q{i}") for i, s in enumerate((0.25, 0.5, 0.75))]
    at = q[0].join(q[1], ["key", "dim"]).join(q[2], ["key", "dim"])
    out = []
    for i, name in enumerate(NAMES):
        here = F.col("dim") == i
        out += [F.max(F.when(here, F.col("q1") / 256)).alias(f"m{i}"), F.max(F.when(here, F.greatest((F.col("q2") - F.col("q0")) / 256 / 1.349, F.lit(FLOOR[name])))).alias(f"l{i}{i}")]
        out += [F.lit(0.0).alias(f"l{i}{j}") for j in range(i)]
    return at.groupBy("key").agg(*out)


def _standardised() -> list[Column]:
    """y of L y = x - m, one column after the other; its squared length is the squared Mahalanobis distance with covariance L L'."""
    ys: list[Column] = []
    for i, name in enumerate(NAMES):
        y = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        ys.append((y / F.col(f"l{i}{i}")).alias(f"y{i}"))
    return ys


def with_distance(rows: DataFrame, params: DataFrame, keys: int) -> DataFrame:
    """Adds d2. params has one row a key."""
    keep = rows.columns
    df = by_key(rows, params, keys, how="left")
    for y in _standardised():
        df = df.select("*", y)
    return df.select(*keep, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(NAMES))), F.col("y0") * F.col("y0")).alias("d2"))


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance (times factor, and with the squared floors added to its diagonal) of each key. A row counts as much as its column w."""
    p = len(NAMES)
    # moments about the key's first centre keep their digits; a plain sum of squares of these small numbers has enough of them
    aggs = [F.sum("w").alias("n")] + [F.sum(F.col("w") * F.col(a)).alias(f"s{i}") for i, a in enumerate(NAMES)]
    aggs += [F.sum(F.col("w") * F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)]
    g = rows.groupBy("key").agg(*aggs)
    g = g.select("key", "n", *[F.round(F.col(f"s{i}") / F.col("n"), 9).alias(f"m{i}") for i in range(p)], *[(F.col(f"s{i}{j}") / F.col("n")).alias(f"e{i}{j}") for i in range(p) for j in range(i + 1)])
    g = g.select("key", "n", *[f"m{i}" for i in range(p)], *[F.round((F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (FLOOR[NAMES[i]] ** 2 if i == j else 0.0), 9).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floors keep the diagonal positive
            g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l{j}{j}"))
    return g.select("key", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def mcd(rows: DataFrame, scratch: Scratch, keys: int, share: float = SHARE) -> DataFrame:
    """Minimum-covariance-determinant estimates of each key of rows (key and the transformed statistics), reweighted: key, m0.., l00.. keys: number of keys.

    Concentration steps lower the determinant each, until it settles for every key; they start at medians and quartiles, so they are the same in every run. The nearest
    `share` is taken by bins of the distance; of the last bin each row counts in part, so that a bin full of copies doesn't enter whole.
    """
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, len(NAMES))), 2 * F.log("l00"))
    params, last = scratch.cut(_start(rows, scratch)), None
    while True:
        near = with_distance(rows, params, keys).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * 16))
        counts = scratch.cut(near.groupBy("key", "bin").agg(F.count("*").alias("n")))  # by key and bin, before a key's bins meet
        cut = scratch.cut(_cut_at(counts, ["key"], "bin", share))
        held = by_key(near, cut, keys).where("bin <= cut").withColumn("w", F.when(F.col("bin") == F.col("cut"), F.col("part")).otherwise(F.lit(1.0)))
        new = scratch.cut(_estimate(held, CONSISTENT))
        falls = True
        if last is not None:  # the first estimate comes from another half than quartiles tell of
            old = last.select("key", log_det.alias("old"))
            falls = not by_key(new.select("key", log_det.alias("new")), old, keys).where(F.col("old") - F.col("new") > SETTLED).isEmpty()
        scratch.release(params, counts, cut)
        params, last = new, new
        if not falls:
            break
    return scratch.cut(_estimate(with_distance(rows, params, keys).where(F.col("d2") <= REWEIGHT).withColumn("w", F.lit(1.0)), REWEIGHTED))


def judge(docs: DataFrame, cut: float = CUT, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A document passes if it isn't base_failed (fewer than 50 words, or over half of its words in repeated windows of three) and its squared Mahalanobis
    distance from its language and source is at most `cut`. Estimates are made from documents that aren't base_failed; those of a language and source
    with fewer than `least` of them are pooled by language, and then all together. distance is null for a base_failed document. A null text
    has no words and fails; a null language or source is a value of its own. Repeated rows are judged alike. Other columns are not read. Windows of
    texts up to 2^24 words are found by sorting packed numbers, of longer ones by sorting pairs.
    """
    scratch = Scratch(docs.sparkSession, "outliers")
    own = F.to_json(F.struct("lang", "source"))
    by_lang = F.to_json(F.struct("lang", F.lit(True).alias("pooled")))
    rows = scratch.cut(transformed(statistics(docs)).select("*", own.alias("own"), by_lang.alias("by_lang")).drop("lang", "source", "n_lines"))
    good = rows.where("not base_failed")
    sizes = scratch.cut(good.groupBy("own", "by_lang").agg(F.count("*").alias("n")))
    pools = sizes.where(F.col("n") < least).groupBy("by_lang").agg(F.sum("n").alias("pool"))
    keys = scratch.cut(sizes.join(pools, "by_lang", "left").select("own", F.when(F.col("n") >= least, F.col("own")).when(F.col("pool") >= least, F.col("by_lang")).otherwise(F.lit("all")).alias("key")))
    n = keys.count()
    params = mcd(by_key(good, keys, n, "own").select("key", *NAMES), scratch, n)
    scratch.keep(rows, keys, params)
    out = with_distance(by_key(rows, keys, n, "own", "left"), params, n)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(d2 <= cut, F.lit(True))).alias("kept"), F.sqrt(d2).alias("distance"))
