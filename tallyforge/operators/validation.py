"""Reconciliation rules. Every rule gives rows of one long table: id, code, status (passed, failed, skipped, observed), severity (error, review)."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOLERANCE, within

CHECK = "struct<code:string,status:string,severity:string>"


def check(code: str, ok: Column, severity: str = "review", skipped: Column | None = None) -> Column:
    """Null in the condition skips the check."""
    status = F.when(skipped if skipped is not None else F.lit(False), "skipped").when(ok.isNull(), "skipped").when(ok, "passed").otherwise("failed")
    return F.struct(F.lit(code).alias("code"), status.alias("status"), F.lit(severity).alias("severity"))


def item_facts(items: DataFrame) -> DataFrame:
    """Sums and counts of each record's items: record_id, n_items, n_priced, item_sum, discount_faults, negative, repeated. Equal items are added up first, so the second step meets sums only."""
    price = F.col("final_price").cast("decimal(18,2)")
    fault = F.col("original_price").isNotNull() & F.col("discount_amount").isNotNull() & ~within(F.col("original_price") - F.col("discount_amount"), F.col("final_price"))
    each = items.groupBy("record_id", "name", "final_price", "quantity", "unit").agg(F.count("*").alias("n"), F.count("final_price").alias("priced"), F.sum(price).alias("sum"), F.count_if(fault).alias("faults"), F.count_if(F.col("final_price") < 0).alias("below"))
    return each.groupBy("record_id").agg(
        F.sum("n").alias("n_items"), F.sum("priced").alias("n_priced"), F.sum("sum").cast("decimal(28,2)").alias("item_sum"), F.sum("faults").alias("discount_faults"), F.sum("below").alias("negative"), F.count_if(F.col("n") > 1).alias("repeated")
    )


# The rules in their order, and those that need the items.
RULES = ["NONNEGATIVE_AMOUNTS", "ITEMS_PRESENT", "ITEM_PRICES_COMPLETE", "ITEM_DISCOUNT_ARITHMETIC", "REPEATED_IDENTICAL_ITEMS", "ITEM_SUM_RECONCILIATION", "PRE_DISCOUNT_TOTAL", "NET_PLUS_VAT", "PAYMENT_CHANGE", "VAT_RATE", "CURRENCY_CONSISTENCY"]
ITEM_RULES = {"ITEMS_PRESENT", "ITEM_PRICES_COMPLETE", "ITEM_DISCOUNT_ARITHMETIC", "REPEATED_IDENTICAL_ITEMS", "ITEM_SUM_RECONCILIATION"}


def check_records(records: DataFrame, facts: DataFrame | None, tolerance: float = TOLERANCE, codes: list[str] | None = None) -> DataFrame:
    """records: record_id, total, pre_discount_total, discount_total, net, vat, vat_rate, paid, change, currencies (array). codes: the rules wanted, all if not given; item facts are joined only if one needs them."""
    codes = [c for c in RULES if codes is None or c in codes]
    r = records.join(facts, "record_id", "left") if ITEM_RULES & set(codes) else records
    amounts = [F.col(c) for c in ("total", "pre_discount_total", "discount_total", "net", "vat", "paid", "change")]
    n = lambda: F.coalesce("n_items", F.lit(0))
    near = lambda a, b: within(a, b, tolerance)
    direct = lambda: near(F.col("item_sum"), F.col("total")) | F.coalesce(near(F.col("item_sum") - F.col("discount_total").cast("decimal(18,2)"), F.col("total")), F.lit(False))
    rules = {
        "NONNEGATIVE_AMOUNTS": lambda c: check(c, ~reduce(lambda a, b: a | b, [F.coalesce(a < 0, F.lit(False)) for a in amounts]), "error"),
        "ITEMS_PRESENT": lambda c: check(c, n() > 0),
        "ITEM_PRICES_COMPLETE": lambda c: check(c, F.col("n_priced") == n(), skipped=n() == 0),
        "ITEM_DISCOUNT_ARITHMETIC": lambda c: check(c, F.col("discount_faults") == 0),
        "REPEATED_IDENTICAL_ITEMS": lambda c: F.struct(F.lit(c).alias("code"), F.when(F.coalesce("repeated", F.lit(0)) > 0, "observed").otherwise("passed").alias("status"), F.lit("review").alias("severity")),
        "ITEM_SUM_RECONCILIATION": lambda c: check(c, direct(), skipped=~((n() > 0) & (F.col("n_priced") == n()))),
        "PRE_DISCOUNT_TOTAL": lambda c: check(c, near(F.col("pre_discount_total") - F.col("discount_total"), F.col("total"))),
        "NET_PLUS_VAT": lambda c: check(c, near(F.col("net") + F.col("vat"), F.col("total"))),
        "PAYMENT_CHANGE": lambda c: check(c, near(F.col("paid") - F.coalesce("change", F.lit(0.0)), F.col("total"))),
        "VAT_RATE": lambda c: check(c, near(F.round((F.col("net") * F.col("vat_rate") / 100).cast("decimal(18,6)"), 2), F.col("vat"))),
        "CURRENCY_CONSISTENCY": lambda c: check(c, F.size(F.array_distinct(F.array_compact("currencies"))) <= 1),
    }
    return r.select("record_id", F.inline(F.array(*[rules[c](c) for c in codes])))


def roll_up(checks: DataFrame) -> DataFrame:
    """A record is invalid with a failed error, review_required with a failed review, else valid."""
    bad = lambda s: F.count_if((F.col("status") == "failed") & (F.col("severity") == s))
    g = checks.groupBy("record_id").agg(bad("error").alias("errors"), bad("review").alias("reviews"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    return g.select("*", F.when(F.col("errors") > 0, "invalid").when(F.col("reviews") > 0, "review_required").otherwise("valid").alias("status"))


def decision(status: Column) -> Column:
    return F.when(status == "valid", "import").when(status == "review_required", "needs_review").otherwise("reject")


def accepts(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Whether a correction is taken: the target check failed before and passes now, and nothing that passed fails now."""
    j = before.select("record_id", "code", F.col("status").alias("was")).join(after.select("record_id", "code", F.col("status").alias("is")), ["record_id", "code"], "full_outer")
    return j.groupBy("record_id").agg((F.bool_or((F.col("code") == target) & (F.col("was") == "failed") & (F.col("is") == "passed")) & ~F.bool_or((F.coalesce("was", F.lit("passed")) != "failed") & (F.col("is") == "failed"))).alias("accepted"))
