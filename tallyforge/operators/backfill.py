"""Backfills of tables that an older version wrote, and checks of what is written by hand."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .telemetry import PRICES

# Fixed value: fields of an item's JSON that became columns.
ITEM_FIELDS = {"category_reason": "$.category_reason", "semantic_description": "$.semantic_description", "parser_item_type": "$.item_type"}


def snapshots(queue: DataFrame) -> DataFrame:
    """queue: raw_json, extraction_json, draft_json, ..: what is missing comes from raw_json, which then mirrors the extraction; the draft keeps what it has."""
    source = F.coalesce("extraction_json", "raw_json")
    new = {"extraction_json": source, "draft_json": F.coalesce("draft_json", "raw_json"), "raw_json": source}
    return queue.select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])


def item_semantics(items: DataFrame, json: str = "raw_json") -> DataFrame:
    """Columns that are null take the value of the item's own JSON; invalid JSON gives none."""
    new = {c: F.coalesce(F.col(c), F.nullif(F.get_json_object(json, path), F.lit(""))) for c, path in ITEM_FIELDS.items() if c in items.columns}
    return items.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def compact(provider: Column, model: Column) -> Column:
    """Spellings of one model by one provider meet here."""
    return F.concat_ws("|", *[F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "") for c in (provider, model)])


def snap_names(prices: DataFrame, calls: DataFrame) -> DataFrame:
    """Prices under the one spelling that calls have for their model, if there is exactly one; of prices that meet there, the one that had the spelling before, else the latest. prices: provider, model, updated_at, .."""
    seen = calls.where(F.trim(F.coalesce("model", F.lit(""))) != "").select("provider", "model").distinct()
    one = seen.groupBy(compact(F.col("provider"), F.col("model")).alias("_key")).agg(F.count("*").alias("_n"), F.min("provider").alias("_provider"), F.min("model").alias("_model")).where("_n = 1").drop("_n")
    j = prices.withColumn("_key", compact(F.col("provider"), F.col("model"))).join(one, "_key", "left")
    exact = (F.col("provider") == F.col("_provider")) & (F.col("model") == F.col("_model"))
    named = j.select(F.coalesce("_provider", "provider").alias("provider"), F.coalesce("_model", "model").alias("model"), F.struct(F.coalesce(exact, F.lit(True)).alias("exact"), "updated_at", *[c for c in prices.columns if c not in ("provider", "model", "updated_at")]).alias("v"))
    best = named.groupBy("provider", "model").agg(F.max(F.struct(F.col("v.exact").alias("a"), F.col("v.updated_at").alias("b"), "v")).alias("m"))
    return best.select(*[F.col(c) if c in ("provider", "model") else F.col(f"m.v.{c}").alias(c) for c in prices.columns])


def checked_prices(new: DataFrame) -> DataFrame:
    """New prices with the reason why a row can't be taken, null if it can: a blank name, a currency that hasn't three letters, an input or output price that is missing, a price that is negative or not finite.

    Currencies are upper-cased, names trimmed.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    bad = lambda c: F.coalesce((F.col(c) < 0) | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    why = F.when(blank("provider") | blank("model"), "name").when(F.length(F.trim(F.coalesce("currency", F.lit("")))) != 3, "currency").when(F.col(PRICES[0]).isNull() | F.col(PRICES[3]).isNull(), "missing price")
    for p in PRICES:
        why = why.when(bad(p), p)
    new_ = {"provider": F.trim("provider"), "model": F.trim("model"), "currency": F.upper(F.trim("currency"))}
    return new.select(*[new_.get(c, F.col(c)).alias(c) for c in new.columns], why.alias("fault"))


def recalibrate(items: DataFrame, calibrate) -> tuple[DataFrame, DataFrame]:
    """Items with their confidence as it is calibrated now, and those whose confidence that changes (item_id, old, new). Running it again changes nothing: it starts from the model's own confidence."""
    now = calibrate(items)
    changed = now.where(~F.col("calibrated").eqNullSafe(F.col("stored"))).select("item_id", F.col("stored").alias("old"), F.col("calibrated").alias("new"))
    return now, changed
