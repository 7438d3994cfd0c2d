"""Fixed aggregations over receipts and items. None is approval-scoped unless the caller passes a view."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents, exact_sum


def row_counts(receipts: DataFrame, items: DataFrame) -> DataFrame:
    return receipts.agg(F.count("*").alias("receipt_count")).crossJoin(items.agg(F.count("*").alias("item_count")))  # one row each


def top_groups(df: DataFrame, key: Column, amount: str, name: str, limit: int = 10) -> DataFrame:
    """Groups by number of rows, then by name (null first); a null key is a group."""
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.coalesce(exact_sum(F.col(amount)), F.lit(0.0)).alias("total"))
    return out.orderBy(F.desc("n"), F.asc_nulls_first(name)).limit(limit)


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values that aren't blank, in order."""
    out = df.where(F.trim(column) != "").select(F.col(column).alias("value")).distinct()
    return out.orderBy("value").limit(limit) if limit else out


def date_range(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.min("receipt_date").alias("first_date"), F.max("receipt_date").alias("last_date"))


def filtered(receipts: DataFrame, merchant: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Equality on the normalised merchant and comparison of date texts; None: no condition."""
    for value, cond in ((merchant, F.col("merchant_normalized") == merchant), (date_from, F.col("receipt_date") >= date_from), (date_to, F.col("receipt_date") <= date_to)):
        if value is not None:
            receipts = receipts.where(cond)
    return receipts


ORDERS = {
    "date_desc": lambda: [F.desc_nulls_last("receipt_date"), F.asc("receipt_id")], "date_asc": lambda: [F.asc_nulls_first("receipt_date"), F.asc("receipt_id")],
    "total_desc": lambda: [F.desc_nulls_last("grand_total"), F.asc("receipt_id")],
}


def list_receipts(receipts: DataFrame, items: DataFrame, order: str = "date_desc", limit: int = 100, **conditions) -> DataFrame:
    """Receipts with their number of items. Only the rows of the answer are joined: order and limit come first."""
    limit = max(1, min(10_000, limit))
    top = filtered(receipts, **conditions).orderBy(*ORDERS[order]()).limit(limit)
    n = items.join(top.select("receipt_id"), "receipt_id", "left_semi").groupBy("receipt_id").agg(F.count("*").alias("n"))
    return top.join(n, "receipt_id", "left").select("receipt_id", "merchant_name", "receipt_date", "currency", "grand_total", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"))


def _measure(metric: str) -> Column:
    total = exact_sum(F.col("grand_total"))
    value = {"sum": total, "average": cents(total / F.nullif(F.count("grand_total"), F.lit(0))), "count": F.count("*").cast("double")}[metric]
    return F.coalesce(value, F.lit(0.0)).alias("value")


def _currency() -> Column:
    return F.when(F.count_distinct("currency") > 1, "MIXED").otherwise(F.min("currency")).alias("currency")


def aggregate_receipts(receipts: DataFrame, metric: str = "sum", **conditions) -> DataFrame:
    """One value over all that match; currency is MIXED for more than one."""
    return filtered(receipts, **conditions).agg(_measure(metric), F.count("*").alias("n"), _currency())


def group_receipts(receipts: DataFrame, by: str = "merchant", metric: str = "sum", limit: int = 100, **conditions) -> DataFrame:
    """By merchant (null: unknown) or month; largest value first, then by key."""
    key = {"merchant": F.coalesce("merchant_normalized", F.lit("unknown")), "month": F.substr("receipt_date", F.lit(1), F.lit(7))}[by]
    out = filtered(receipts, **conditions).groupBy(key.alias("group_key")).agg(_measure(metric), F.count("*").alias("n"), _currency())
    return out.orderBy(F.desc("value"), F.asc_nulls_first("group_key")).limit(max(1, min(1000, limit)))


def cheapest(items: DataFrame, limit: int = 10) -> DataFrame:
    """Least price of each description and currency, with the spelling of the row that has it."""
    out = items.groupBy(F.lower("description").alias("item"), "currency").agg(F.min("line_total").alias("price"), F.min_by("description", F.struct("line_total", "description")).alias("spelling"))
    return out.orderBy(F.asc_nulls_first("price"), "item", F.asc_nulls_first("currency")).limit(limit)
