"""What is added to items before they are searched or shown: categories, labelled texts, aliases, and the search that falls back to plain words."""
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_present, normal_literal, normalize_text
from .answers import expand_terms
from .retrieval import bm25, fallback_score

# Labels of an item's text for embedding, in order.
LABELS = ["Merchant", "Date", "Product item", "Raw item", "Normalized item", "Line note", "Category", "Semantic description", "Parser row type", "Original price", "Discount amount", "Tax code", "Aliases", "Price"]


def taxonomy_key(c: Column) -> Column:
    """Lower case, spaces and hyphens as underscores; empty for null."""
    return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), " -", "__")


def valid_category(c: Column, valid: list[str], renamed: dict[str, str]) -> Column:
    """The key, by its new name if it was renamed; `unknown` if it isn't a valid one."""
    k = taxonomy_key(c)
    new = F.coalesce(*[F.when(k == a, b) for a, b in renamed.items()], k)
    return F.when(new.isin(valid), new).otherwise("unknown")


def infer_categories(query: Column, aliases: dict[str, list[str]], first: list[tuple[list[str], list[str]]] = ()) -> Column:
    """All categories whose name or alias is part of the normalised query, in the order of aliases. `first`: rules (terms, categories) that come before and settle it."""
    q = normalize_text(query)
    says = lambda terms: reduce(lambda a, b: a | b, [q.contains(normal_literal(t)) for t in terms])
    out = F.array_compact(F.array(*[F.when(says([name, *words]), name) for name, words in aliases.items()]))
    for terms, names in reversed(first):
        out = F.when(says(terms), F.array(*map(F.lit, names))).otherwise(out)
    return out


def embedding_text(values: dict[str, Column], aliases: Column, most_aliases: int = 20) -> Column:
    """Labelled lines, one for each of LABELS. values: columns by label; what is missing is `unknown`, or `none` for the note and the semantic description."""
    none = {"Line note": "none", "Semantic description": "none"}
    lines = []
    for label in LABELS:
        if label == "Aliases":
            value = F.array_join(F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, most_aliases), ", ")
        else:
            value = F.coalesce(first_present(values[label].cast("string")) if label in values else F.lit(None), F.lit(none.get(label, "unknown")))
        lines.append(F.concat(F.lit(f"{label}: "), value))
    return F.array_join(F.array(*lines), "\n")


def overlay(items: DataFrame, categorised: DataFrame, fields: list[str]) -> DataFrame:
    """items with the named fields taken from the categorised item of the same record_id and item_index, where there is one; nothing else changes."""
    k = ["record_id", "item_index"]
    other = categorised.select(*k, F.struct(*fields).alias("_new"))
    return items.join(other, k, "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns])


def category_counts(items: DataFrame) -> DataFrame:
    """By record_id: items, those with a category, those that need review."""
    known = ~taxonomy_key(F.col("category_key")).isin("", "unknown")
    return items.groupBy("record_id").agg(F.count("*").alias("n_items"), F.count_if(known).alias("categorised"), F.count_if(F.coalesce("review_required", F.lit(False))).alias("to_review"))


def currency_code(c: Column) -> Column:
    """Three letters, upper case; null for anything else."""
    code = F.upper(F.trim(c))
    return F.when(code.rlike(r"\A[A-Z]{3}\z"), code)


def supported_discount(records: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """records: doc_id, discount; rows: doc_id, line. The discount where a line that fits the pattern `label` prints its amount (to the cent, whatever the sign), else null."""
    amounts = F.regexp_extract_all("line", F.lit(r"(?<!\d)((?:\d{1,3}(?:[ .]\d{3})*|\d+)[.,]\d{2})(?!\d)"), F.lit(1))
    number = lambda a: F.translate(F.regexp_replace(a, r"[ .,](?=.*[.,])", ""), ",", ".").try_cast("decimal(18,2)")
    printed = rows.where(F.col("line").rlike(label)).select("doc_id", F.explode(F.transform(amounts, number)).alias("amount")).where("amount is not null").distinct()
    wanted = records.where("discount is not null").select("doc_id", F.abs(F.col("discount")).cast("decimal(18,2)").alias("d"))
    near = wanted.join(printed, "doc_id").where(F.abs(F.col("d") - F.col("amount")) <= 0.01).select("doc_id").distinct().withColumn("_found", F.lit(True))
    return records.join(near, "doc_id", "left").select("doc_id", F.when(F.col("_found"), F.col("discount")).alias("discount"))


def search(docs: DataFrame, doc_id: str, text: str, query: str, aliases: dict[str, list[str]] | None = None, limit: int = 25) -> DataFrame:
    """doc_id, score, path: the best by BM25 over the expanded query's words; if not one document has any of them, by shared words and parts of words."""
    terms = expand_terms(query, aliases or {})
    words = [w for t in terms for w in t.split(" ") if w]
    full = bm25(docs, doc_id, text, words, limit).drop("rank").withColumn("path", F.lit("full_text"))
    score = F.round(fallback_score(F.col(text), terms).cast("decimal(18,4)"), 4).cast("double")
    plain = docs.select(F.col(doc_id).alias("doc_id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit).withColumn("path", F.lit("fallback"))
    # one plan: the few rows of the fallback count only where the full text has none
    found = full.agg((F.count("*") == 0).alias("_none"))
    return full.union(plain.crossJoin(F.broadcast(found)).where("_none").drop("_none"))


def seed_aliases(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Adds to catalog (alias, name) the new ones whose normalised alias isn't there; of several the one with the least name."""
    fresh = new.select(normalize_text("alias").alias("alias"), "name").where("alias <> ''").groupBy("alias").agg(F.min("name").alias("name"))
    return catalog.select("alias", "name").union(fresh.join(catalog, "alias", "left_anti").select("alias", "name"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of every file that holds something: Spark's file sources leave empty files out, so these have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
