"""Analytics of model-call logs: tokens, cost, latency."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import nearest_rank

PRICES = ["input_price_per_million", "cached_input_price_per_million", "cache_write_input_price_per_million", "output_price_per_million"]


def select_calls(calls: DataFrame, since: str | None = None, **equals: str | None) -> DataFrame:
    """Conditions that are blank or None don't count."""
    if since:
        calls = calls.where(F.col("recorded_at") >= since)
    for name, value in equals.items():
        if value:
            calls = calls.where(F.col(name) == value)
    return calls


def token_parts(calls: DataFrame) -> DataFrame:
    """Splits input tokens: cached ones at most all, cache writes at most the rest, standard what is left. Null input: parts null but zero at least."""
    n = F.col("input_tokens")
    cached = F.when(n.isNotNull() & F.col("cached_input_tokens").isNotNull(), F.least(F.greatest(F.col("cached_input_tokens"), F.lit(0)), n)).otherwise(F.col("cached_input_tokens"))
    rest = F.greatest(n - F.coalesce(cached, F.lit(0)), F.lit(0))
    write = F.when(rest.isNotNull() & F.col("cache_write_input_tokens").isNotNull(), F.least(F.greatest(F.col("cache_write_input_tokens"), F.lit(0)), rest)).otherwise(F.col("cache_write_input_tokens"))
    return calls.withColumns({"cached_input_tokens": cached, "cache_write_input_tokens": write, "standard_input_tokens": F.greatest(rest - F.coalesce(write, F.lit(0)), F.lit(0))})


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on provider and model ('' for null), then estimated_cost: null and a list of what is missing if a needed price is; 0 without tokens.

    The price list is one row for each model; adaptive execution broadcasts it if it is small.
    """
    p = prices.select(F.col("provider").alias("p_provider"), F.col("model").alias("p_model"), F.col("currency"), *PRICES)
    df = token_parts(calls).join(p, (F.col("provider") == F.col("p_provider")) & (F.coalesce("model", F.lit("")) == F.col("p_model")), "left")
    parts = dict(zip(["standard_input", "cached_input", "cache_write_input", "output"], zip(["standard_input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens"], PRICES, strict=True), strict=True))
    missing = F.array_compact(F.array(*[F.when((F.coalesce(F.col(n), F.lit(0)) > 0) & F.col(price).isNull(), name) for name, (n, price) in parts.items()]))
    cost = sum((F.coalesce(F.col(n), F.lit(0)) * F.coalesce(F.col(price), F.lit(0.0)) / 1_000_000.0 for n, price in parts.values()), F.lit(0.0))
    rate = F.when(F.col("generation_duration_ms") != 0, F.col("output_tokens") / (F.col("generation_duration_ms") / 1000.0))
    return df.select(*[c for c in df.columns if c not in ("p_provider", "p_model")], missing.alias("missing_prices"), F.when(F.size(missing) == 0, cost).alias("estimated_cost"), rate.alias("tokens_per_second"))


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(28,10)")).cast("double")


def summary(costed: DataFrame) -> DataFrame:
    """One row over all calls; p95 by nearest rank."""
    one = F.when(F.count_distinct("currency") == 1, F.min("currency"))
    sums = costed.agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), (_exact(F.col("duration_ms")) / F.count("duration_ms")).alias("average_ms"),
        _exact(F.col("estimated_cost")).alias("cost"),
        F.count_if(F.col("estimated_cost").isNotNull()).alias("priced"), F.count_if(F.col("estimated_cost").isNull()).alias("unpriced"), one.alias("currency"),
    )
    return sums.join(F.broadcast(nearest_rank(costed, [], "duration_ms", 0.95, "p95_ms")), how="left")  # one row each


def by_group(costed: DataFrame, key: str) -> DataFrame:
    out = costed.groupBy(F.col(key).alias("group_key")).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), (_exact(F.col("duration_ms")) / F.count("duration_ms")).alias("average_ms"),
        _exact(F.col("estimated_cost")).alias("cost"), F.count("estimated_cost").alias("priced"), F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return out.orderBy(F.desc("calls"), F.asc_nulls_first("group_key"))


def model_catalog(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that were seen or have a price."""
    seen = calls.groupBy("provider", F.coalesce("model", F.lit("")).alias("model")).agg(F.max("recorded_at").alias("last_seen"), F.count("*").alias("calls"))
    return seen.join(prices.select("provider", "model", "output_price_per_million"), ["provider", "model"], "full_outer").select("provider", "model", "last_seen", F.coalesce("calls", F.lit(0)).alias("calls"), F.col("output_price_per_million").isNotNull().alias("priced"))


def page(calls: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return calls.orderBy(F.desc_nulls_last("recorded_at"), "call_id").offset(offset).limit(limit)


def upsert_prices(prices: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same provider and model."""
    return prices.join(new.select("provider", "model"), ["provider", "model"], "left_anti").unionByName(new)
