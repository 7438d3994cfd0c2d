"""Search over items: BM25, lexical scores, cosine, rank fusion, deduplication, evaluation."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lexical_relevance, normalize_text, tokens
from .ranking import global_rank


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """An inverted index: term, doc_id, tf, and the document's length."""
    words = F.filter(F.split(normalize_text(text), " "), lambda w: w != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(words).alias("length"), F.explode(words).alias("term")).groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str], limit: int | None = 25, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score, rank: higher is better; ties by id; rank only with a limit.

    Texts are read and split once: each document becomes its length and its counts of the query's terms. The corpus size, the mean length and the terms' document
    frequencies are one row, joined back. idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    query = list(dict.fromkeys(query))
    words = F.filter(F.split(normalize_text(text), " "), lambda w: w != "")
    found = lambda ws: F.struct(F.size(ws).alias("length"), F.filter(ws, lambda w: w.isin(query)).alias("hits"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.get(F.transform(F.array(words), found), F.lit(0)).alias("w")).select("doc_id", "w.length", *[F.size(F.filter("w.hits", _is(t))).alias(f"tf{i}") for i, t in enumerate(query)])
    base = base.persist()
    corpus = base.agg(F.count("*").alias("N"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    some = [F.col(f"tf{i}") > 0 for i in range(len(query))]
    hit = base.where(reduce(lambda x, y: x | y, some, F.lit(False))).crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0).cast("decimal(28,12)")
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
        score = score + F.when(tf > 0, part.cast("decimal(28,12)")).otherwise(F.lit(0).cast("decimal(28,12)"))
    out = hit.select("doc_id", F.round(score, 6).cast("double").alias("score"))
    if not limit:
        return out
    top = out.orderBy(F.desc("score"), "doc_id").limit(limit)
    return top.select("*", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"))  # `limit` rows


def fallback_score(text: Column, terms: list[str]) -> Column:
    """Shared words, and 0.35 for each term that is part of the text."""
    t = normalize_text(text)
    shared = F.size(F.array_intersect(tokens(t), F.array(*[F.lit(x) for x in terms])))
    inside = sum((t.contains(x).cast("int") for x in terms), F.lit(0))
    return shared + F.lit(0.35) * inside


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero or missing vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """Top rows by cosine with one vector; the scan is narrow and only `limit` rows a task are sorted."""
    sim = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    out = vectors.select("vec_id", F.round(F.least(F.greatest(sim, F.lit(-1.0)), F.lit(1.0)), 6).alias("similarity")).where(F.col("similarity").isNotNull())
    return out.orderBy(F.desc("similarity"), "vec_id").limit(limit)


def fuse(vector_rank: Column, lexical_rank: Column, k: int = 60, vector_weight: float = 1.0, lexical_weight: float = 1.5) -> Column:
    """Reciprocal-rank fusion; a null rank adds nothing."""
    if k <= 0 or vector_weight < 0 or lexical_weight < 0:
        raise ValueError("k must be above 0 and weights not below")
    return F.coalesce(vector_weight / (k + vector_rank), F.lit(0.0)) + F.coalesce(lexical_weight / (k + lexical_rank), F.lit(0.0))


def hybrid(candidates: DataFrame, query: str, vector: list[float], limit: int = 10, minimum_score: float | None = None, deduplicate: bool = True, k: int = 60, most: int = 100) -> DataFrame:
    """candidates: item_id, description, identity, embedding, fts_rank (null: not found). Two rankings of the groups, fused.

    A row is dropped by minimum_score only if it has no lexical score either. Groups are products of one identity: ids sorted, best scores of each kind. Ranks
    are made among all groups, by ranges of the order. Vectors of another length than the query's are an error; null ones aren't found.
    """
    if not query.strip() or not 0 < limit <= most or (minimum_score is not None and not -1 <= minimum_score <= 1):
        raise ValueError("a query, a limit within bounds and a score within -1 and 1 are needed")
    same = F.size("embedding") == len(vector)
    checked = F.when(F.col("embedding").isNull() | same, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"vectors of {len(vector)} dimensions are needed, one has "), F.size("embedding").cast("string"))).cast("array<float>"))
    sim = F.least(F.greatest(cosine(checked, F.array(*[F.lit(float(x)) for x in vector])), F.lit(-1.0)), F.lit(1.0))
    lex = lexical_relevance(query, F.col("description")) + F.coalesce(1.0 / F.col("fts_rank"), F.lit(0.0))
    rows = candidates.select("item_id", "description", F.col("identity") if deduplicate else F.col("item_id").cast("string").alias("identity"), sim.alias("similarity"), lex.alias("lexical")).where("similarity is not null")
    if minimum_score is not None:
        rows = rows.where((F.col("similarity") >= minimum_score) | (F.col("lexical") > 0))
    g = rows.groupBy("identity").agg(
        F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"), F.max("lexical").alias("lexical"),
        F.max_by("description", F.struct("lexical", "similarity", -F.col("item_id"))).alias("description"),
    )
    ranked = global_rank(global_rank(g, [F.desc("similarity"), F.col("identity")], "vector_rank"), [F.desc("lexical"), F.desc("similarity"), F.col("identity")], "place")
    ranked = ranked.select(*g.columns, "vector_rank", F.when(F.col("lexical") > 0, F.col("place")).alias("lexical_rank"))
    return ranked.select("*", fuse(F.col("vector_rank"), F.col("lexical_rank"), k).alias("fusion")).orderBy(F.desc("fusion"), F.desc("lexical"), F.desc("similarity"), F.element_at("item_ids", 1)).limit(limit)


def evaluate(results: DataFrame, cases: DataFrame) -> DataFrame:
    """results: case_id, item_id, rank; cases: case_id, expected (ids), top_k. recall, precision and reciprocal rank of each case; recall is null without expected ids."""
    hits = results.join(cases, "case_id").where(F.col("rank") <= F.col("top_k"))
    per = hits.groupBy("case_id").agg(F.count_if(F.array_contains("expected", F.col("item_id"))).alias("hit"), F.count("*").alias("shown"), F.min(F.when(F.array_contains("expected", F.col("item_id")), F.col("rank"))).alias("first"))
    wanted = F.size("expected")
    return cases.join(per, "case_id", "left").select(
        "case_id", F.when(wanted > 0, F.coalesce("hit", F.lit(0)) / wanted).alias("recall"), F.when(wanted > 0, F.coalesce("hit", F.lit(0)) / F.col("top_k")).alias("precision"), F.when(wanted > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank")
    )
