"""The two approval-scoped views, and the records that the star schema stands in for."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statuses of an approved record, and kinds of rows that are purchases.
APPROVED = ["approved", "accepted", "complete", "completed"]
PURCHASES = ["item", "product", "purchase_item", "purchased_product"]


def approved(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(APPROVED)


def is_purchase(kind: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit("item"))).isin(PURCHASES)


def month(date: Column) -> Column:
    """yyyy-mm of a date text that starts like a date with a day, else null."""
    return F.when(date.rlike(r"\A\d{4}-\d{2}-"), F.substr(date, F.lit(1), F.lit(7)))


def _given(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a null column for each of `columns` (name: type) that it doesn't have."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns])


# Columns that records may lack.
RECEIPT_EXTRA = {"job_id": "string", "receipt_time": "string", "subtotal": "double", "tax_total": "double", "paid_total": "double", "payment_method": "string"}
ITEM_EXTRA = {
    "item_index": "int", "normalized_name": "string", "category_key": "string", "category_group": "string", "category": "string", "category_reason": "string", "semantic_description": "string", "unit": "string", "unit_price": "double",
    "original_price": "double", "discount_amount": "double", "tax_code": "string", "confidence": "double", "brand": "string", "quantity": "double",
}


def _merchant() -> Column:
    return F.coalesce(F.nullif(F.col("merchant_normalized"), F.lit("")), F.col("merchant_name"))


def receipts_view(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each approved receipt. Items are counted before the join, so the join key is unique on that side."""
    n = items.where(is_purchase(F.col("item_type")) & (F.lower(F.coalesce("item_status", F.lit(""))) != "rejected")).groupBy("receipt_id").agg(F.count("*").alias("n"))
    r = _given(receipts, RECEIPT_EXTRA).where(approved(F.col("review_status")))
    return r.join(n, "receipt_id", "left").select(
        "receipt_id", "job_id", "merchant_name", _merchant().alias("merchant"), "receipt_date", month(F.col("receipt_date")).alias("receipt_month"), "receipt_time", "currency", "subtotal", "tax_total", "grand_total", "paid_total",
        "payment_method", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"),
    )


def items_view(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each purchase of an approved receipt that isn't rejected. Category: key, then group, then the old category as it is. brand is an addition."""
    r = _given(receipts, RECEIPT_EXTRA).where(approved(F.col("review_status"))).select("receipt_id", "job_id", "merchant_name", _merchant().alias("merchant"), "receipt_date", month(F.col("receipt_date")).alias("receipt_month"), "currency")
    i = _given(items, ITEM_EXTRA).where((F.lower(F.coalesce("item_status", F.lit(""))) != "rejected") & is_purchase(F.col("item_type")))
    category = F.coalesce(F.nullif(F.col("category_key"), F.lit("")), F.nullif(F.col("category_group"), F.lit("")), F.col("category"))
    return i.join(r, "receipt_id").select(
        "item_id", "receipt_id", "job_id", "item_index", "merchant_name", "merchant", "receipt_date", "receipt_month", "currency", F.col("raw_name").alias("description"), "normalized_name", category.alias("category"), "category_key", "category_reason",
        "semantic_description", F.col("item_type").alias("parser_item_type"), "quantity", "unit", "unit_price", "original_price", "discount_amount", "line_total", "tax_code", "confidence", "brand",
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts: the market segment is the merchant (one segment has only a customer's name), priority gives currency and payment."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderkey").alias("receipt_id"), F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("c_name").alias("merchant_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.lower("c_mktsegment")).alias("merchant_normalized"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("receipt_date"),
        F.when(p == "1", "USD").when(p != "5", "EUR").alias("currency"), F.when(p.isin("1", "2"), "card").when(p != "5", "cash").alias("payment_method"), F.col("o_totalprice").alias("grand_total"),
        F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30")).alias("receipt_time"), (F.col("o_totalprice") * 0.5).alias("subtotal"), (F.col("o_totalprice") * 0.25).alias("tax_total"), F.when(p != "5", F.col("o_totalprice")).alias("paid_total"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "Accepted").otherwise("needs_review").alias("review_status"),
    )


def star_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as receipt items. item_id is the part's key: the table has no key of its own."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_orderkey").alias("receipt_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("item_index"), F.col("p_name").alias("raw_name"), F.col("p_name").alias("normalized_name"),
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.lower("p_type")).alias("category_key"), F.lit(None).cast("string").alias("category_group"), F.lower("p_brand").alias("category"), F.col("p_brand").alias("brand"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("line_total"), (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"), F.col("l_tax").alias("tax_rate"),
        F.col("p_type").alias("category_reason"), F.concat(F.lower("p_name"), F.lit(" by "), F.col("p_brand")).alias("semantic_description"), F.when(F.col("l_quantity") < 10, "pc").alias("unit"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("original_price"), F.when(F.col("l_tax") > 0.04, "A").otherwise("B").alias("tax_code"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "refund").when(F.col("l_returnflag") == "A", "item").alias("item_type"),
        F.when(F.col("l_quantity") >= 49, "rejected").when(F.col("l_tax") >= 0.08, "needs_review").otherwise("approved").alias("item_status"),
    )


#: The same records for the SQL that queries are held against.
STAR_SQL = """
receipts AS (
  SELECT o_orderkey AS receipt_id, 'job-' || o_orderkey AS job_id, c_name AS merchant_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE lower(c_mktsegment) END AS merchant_normalized,
    strftime(o_orderdate, '%Y-%m-%d') AS receipt_date, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS receipt_time, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'USD' WHEN '5' THEN NULL ELSE 'EUR' END AS currency,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'card' WHEN substr(o_orderpriority, 1, 1) <> '5' THEN 'cash' END AS payment_method, o_totalprice AS grand_total,
    o_totalprice * 0.5::DOUBLE AS subtotal, o_totalprice * 0.25::DOUBLE AS tax_total, CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN o_totalprice END AS paid_total,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'Accepted' ELSE 'needs_review' END AS review_status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), items AS (
  SELECT l_orderkey AS receipt_id, l_partkey AS item_id, l_linenumber AS item_index, p_name AS raw_name, p_name AS normalized_name, CASE WHEN p_type = 'ECONOMY' THEN '' ELSE lower(p_type) END AS category_key,
    CAST(NULL AS VARCHAR) AS category_group, lower(p_brand) AS category, p_brand AS brand, l_quantity AS quantity, l_extendedprice AS line_total, l_extendedprice * l_discount AS discount_amount, l_tax AS tax_rate,
    p_type AS category_reason, lower(p_name) || ' by ' || p_brand AS semantic_description, CASE WHEN l_quantity < 10 THEN 'pc' END AS unit, l_extendedprice / l_quantity AS unit_price, CASE WHEN l_discount > 0 THEN l_extendedprice END AS original_price,
    CASE WHEN l_tax > 0.04::DOUBLE THEN 'A' ELSE 'B' END AS tax_code, l_discount AS confidence,
    CASE l_returnflag WHEN 'R' THEN 'refund' WHEN 'A' THEN 'item' END AS item_type, CASE WHEN l_quantity >= 49 THEN 'rejected' WHEN l_tax >= 0.08 THEN 'needs_review' ELSE 'approved' END AS item_status
  FROM lineitem JOIN part ON l_partkey = p_partkey
), analytics_receipts AS (
  SELECT receipt_id, job_id, merchant_name, coalesce(nullif(merchant_normalized, ''), merchant_name) AS merchant, receipt_date, substr(receipt_date, 1, 7) AS receipt_month, receipt_time, currency, subtotal, tax_total, grand_total, paid_total, payment_method,
    (SELECT count(*) FROM items i WHERE i.receipt_id = receipts.receipt_id AND i.item_status <> 'rejected' AND coalesce(i.item_type, 'item') IN ('item', 'product', 'purchase_item', 'purchased_product')) AS item_count
  FROM receipts WHERE lower(coalesce(review_status, '')) IN ('approved', 'accepted', 'complete', 'completed')
), analytics_purchase_items AS (
  SELECT item_id, i.receipt_id, job_id, item_index, merchant_name, coalesce(nullif(merchant_normalized, ''), merchant_name) AS merchant, receipt_date, substr(receipt_date, 1, 7) AS receipt_month, currency, raw_name AS description, normalized_name,
    coalesce(nullif(category_key, ''), nullif(category_group, ''), category) AS category, category_key, category_reason, semantic_description, item_type AS parser_item_type, quantity, unit, unit_price, original_price, discount_amount, line_total, tax_code, confidence, brand
  FROM items i JOIN receipts r USING (receipt_id)
  WHERE lower(coalesce(review_status, '')) IN ('approved', 'accepted', 'complete', 'completed') AND i.item_status <> 'rejected' AND coalesce(i.item_type, 'item') IN ('item', 'product', 'purchase_item', 'purchased_product')
)"""
