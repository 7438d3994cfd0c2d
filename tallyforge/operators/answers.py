"""Around a question: search terms, candidates and decisions on them, how a result counts, how it is written, what a query cost."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_indexable, normal_literal


def expand_terms(query: str, aliases: dict[str, list[str]], most: int = 80) -> list[str]:
    """The query, its words, and the names and aliases of each category that it mentions; at most `most`, in that order."""
    whole = normal_literal(query)
    out = [whole, *whole.split()]
    for name, words in aliases.items():
        near = [normal_literal(w) for w in words]
        if any(w in whole for w in near) or normal_literal(name).replace(" ", "") in whole.replace(" ", ""):
            out += [normal_literal(name), *near]
    return list(dict.fromkeys(t for t in out if t))[:most]


def prefix_terms(query: str, most: int = 12) -> list[str]:
    """Words of two characters or more, for a search by prefix."""
    return [w for w in dict.fromkeys(normal_literal(query).split()) if len(w) >= 2][:most]


def prefix_matches(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and the number of query terms that begin one of its terms."""
    hit = F.array_compact(F.array(*[F.when(F.col("term").startswith(t), t) for t in terms]))
    return postings.select("doc_id", F.explode(hit).alias("t")).groupBy("doc_id").agg(F.count_distinct("t").alias("n"))


def candidates(matches: DataFrame, most: int = 12) -> DataFrame:
    """matches: rank, description, item_ids. The first that may be indexed, named c001 and on, ids distinct and sorted."""
    top = matches.where(is_indexable(F.col("description"))).orderBy("rank").limit(most)
    n = F.row_number().over(W.orderBy("rank"))  # of `most` rows
    ids = F.array_sort(F.array_distinct("item_ids"))
    return top.select(F.format_string("c%03d", n).alias("candidate_id"), "description", ids.alias("item_ids"), F.size(ids).alias("occurrences"))


def coverage(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """candidate_id and its fault: missing, unknown or duplicate. No rows: each candidate was decided exactly once."""
    d = decisions.groupBy("candidate_id").agg(F.count("*").alias("n"))
    j = shown.select("candidate_id", F.lit(True).alias("known")).join(d, "candidate_id", "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return j.select("candidate_id", fault.alias("fault")).where("fault is not null")


def decided_ids(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """decision and the distinct item ids under it, sorted."""
    return decisions.join(shown, "candidate_id").groupBy("decision").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))


def outcome(shape: str, rows: list[tuple], truncated: bool = False) -> str:
    """empty, null (one row of nulls), answered or truncated."""
    if not rows:
        return "empty"
    if shape in ("scalar", "row") and all(v is None for v in rows[0]):
        return "null"
    return "truncated" if truncated else "answered"


def written(c: Column, language: str = "en", places: int = 2) -> Column:
    """A number as text: 1,234.50 or, in German, 1.234,50."""
    text = F.format_number(F.round(c.cast(f"decimal(28,{places})"), places), places)
    return F.translate(text, ",.", ".,") if language == "de" else text


def written_money(c: Column, currency: Column, language: str = "en") -> Column:
    return F.concat_ws(" ", written(c, language), currency)


def query_events(stages: DataFrame) -> DataFrame:
    """stages: query_id, name, duration_ms. One row a query: durations by stage (the last of a name counts), validation and repair attempts."""
    last = stages.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    tries = lambda p: F.count_if(F.col("name").startswith(p))
    per = last.groupBy("query_id", "name").agg(F.max("duration_ms").alias("duration_ms"), F.count("*").alias("n"))
    return per.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "duration_ms")))).alias("durations"), tries("validate_sql_attempt_").alias("validations"), tries("repair_sql_attempt_").alias("repairs"), F.sum("n").alias("stages"))


def identity(c: Column) -> Column:
    """A model's name without case and signs, by which spellings of one model meet."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def display_name(c: Column) -> Column:
    """Words of a model's name, capitalised; version numbers keep their dots."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, r"[/_:-]+", " "), r"\s+", " ")))

