"""Records: item contract, two generations of JSON, assembly of task answers, edits and what they change."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOLERANCE, within

# Words that stand for nothing, in lower case.
NOTHING = ["", "n/a", "na", "none", "null", "unknown", "unk", "-"]
# Checks without which a record can't be approved.
CORE = {"MISSING_MERCHANT": "merchant_name", "MISSING_TOTAL": "grand_total", "NO_ITEMS": "n_items"}


def present(c: Column) -> Column:
    """Null for a placeholder."""
    return F.when(~F.lower(F.trim(c)).isin(NOTHING), F.trim(c))


def item_contract(items: DataFrame) -> DataFrame:
    """items: record_id, item_index, name, quantity, unit, price. One row for each breach: code and level (error, warning)."""
    found = {
        "BLANK_NAME": ("error", F.trim(F.coalesce("name", F.lit(""))) == ""), "NEGATIVE_PRICE": ("error", F.col("price") < 0), "NEGATIVE_QUANTITY": ("error", F.col("quantity") < 0),
        "MISSING_PRICE": ("warning", F.col("price").isNull()), "UNIT_WITHOUT_QUANTITY": ("warning", F.col("unit").isNotNull() & F.col("quantity").isNull()),
    }
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("code"), F.lit(level).alias("level"))) for k, (level, c) in found.items()]))
    return items.select("record_id", "item_index", F.inline(rows))


def variant_number(v: Column, field: str) -> Column:
    """A money value of either form: {"<field>": 1.2, ...} or a plain number; null for anything else."""
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "double"), F.try_variant_get(v, "$", "double"))


def either(doc: Column, new: str, old: str, kind: str) -> Column:
    """The value at the new path if the key is there, even if it is null; else that at the old one."""
    here = F.try_variant_get(doc, new, "variant")
    return F.when(here.isNotNull(), F.try_variant_get(doc, new, kind)).otherwise(F.try_variant_get(doc, old, kind))


def assemble(answers: DataFrame, fields: list[str]) -> DataFrame:
    """answers: record_id, task, value, seq. One row a record, the last answer of each task; one aggregation for all fields."""
    return answers.groupBy("record_id").agg(*[F.max_by(F.when(F.col("task") == f, F.col("value")), F.when(F.col("task") == f, F.col("seq"))).alias(f) for f in fields])


def vat_checks(lines: DataFrame, records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """lines: record_id, rate, net, vat; records: record_id, vat, total. Whether each line's rate, the lines' sum and the lines' gross agree (null: nothing to compare)."""
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    fits = within(F.round((F.col("net") * F.col("rate") / 100).cast("decimal(18,6)"), 2), F.col("vat"), tolerance)
    g = lines.groupBy("record_id").agg(F.bool_and(fits).alias("rates"), F.sum(exact("vat")).alias("vat_sum"), F.sum(exact("net") + exact("vat")).alias("gross"))
    return records.join(g, "record_id", "left").select("record_id", "rates", within(F.col("vat_sum"), F.col("vat"), tolerance).alias("sum"), within(F.col("gross"), F.col("total"), tolerance).alias("gross"))


def by_priority(entries: Column, kinds: list[str]) -> Column:
    """entries: array of (kind, value). The value of the kind that comes first in kinds."""
    return F.coalesce(*[F.get(_of_kind(entries, k), F.lit(0))["value"] for k in kinds])


def _of_kind(entries: Column, kind: str) -> Column:
    return F.filter(entries, lambda e: (e["kind"] == kind) & e["value"].isNotNull())


def blockers(records: DataFrame) -> DataFrame:
    """records: record_id, merchant_name, grand_total, n_items, severities (array), codes (array). Codes that keep a record from approval, sorted; none: it may be approved."""
    missing = F.array_compact(F.array(F.when(present(F.col("merchant_name")).isNull(), "MISSING_MERCHANT"), F.when(F.col("grand_total").isNull(), "MISSING_TOTAL"), F.when(F.coalesce("n_items", F.lit(0)) == 0, "NO_ITEMS")))
    severe = F.filter(F.transform(F.arrays_zip("codes", "severities"), lambda x: F.when(x["severities"].isin("high", "critical") | x["codes"].isin(list(CORE)), x["codes"])), lambda x: x.isNotNull())
    return records.select("record_id", F.array_sort(F.array_union(missing, severe)).alias("blocking"))


def category_codes(items: DataFrame) -> DataFrame:
    """items: record_id, category_key, review_required, status (of the record's categorisation). Codes by record, sorted."""
    g = items.groupBy("record_id").agg(F.bool_or(F.coalesce("review_required", F.lit(False))).alias("review"), F.bool_or(F.coalesce(F.lower(F.trim("category_key")), F.lit("")).isin("", "unknown")).alias("unknown"), F.max("status").alias("status"))
    codes = F.array(F.when(F.col("status").isNotNull() & (F.lower(F.trim("status")) != "ok"), "CATEGORIZATION_INCOMPLETE"), F.when(F.col("review"), "CATEGORY_REVIEW_REQUIRED"), F.when(F.col("unknown"), "UNKNOWN_ITEM_CATEGORY"))
    return g.select("record_id", F.array_compact(codes).alias("codes"))


def apply_edits(records: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """edits: record_id, field, value (text), one row a field. A field that is named takes its value, even null."""
    e = assemble(edits.select("record_id", F.col("field").alias("task"), F.struct("value").alias("value"), F.lit(1).alias("seq")), fields)
    e = e.select("record_id", *[F.col(f).alias(f"_{f}") for f in fields])
    kinds = dict(records.dtypes)
    out = records.join(e, "record_id", "left")
    return out.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").try_cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])


def compare_items(old: DataFrame, new: DataFrame, semantic: list[str], other: list[str]) -> DataFrame:
    """record_id, item_index, change: added, removed, semantic (its embedding is out of date), metadata or same."""
    k = ["record_id", "item_index"]
    pack = lambda df, n: df.select(*k, F.struct(*semantic).alias(f"{n}_s"), F.struct(*(other or semantic)).alias(f"{n}_o"))
    j = pack(old, "a").join(pack(new, "b"), k, "full_outer")
    change = F.when(F.col("a_s").isNull(), "added").when(F.col("b_s").isNull(), "removed").when(~F.col("a_s").eqNullSafe(F.col("b_s")), "semantic").when(~F.col("a_o").eqNullSafe(F.col("b_o")), "metadata").otherwise("same")
    return j.select(*k, change.alias("change"))
