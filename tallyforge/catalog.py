"""The registered queries of the engine over the driver's tables, and the SQL that each is held against.

Every query reads its whole tables. Limits stand only where a limit is the operator (top-k lists, pages).
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import money as M
from .functions import text as T
from .operators import analytics as A
from .operators import answers as AN
from .operators import categories as C
from .operators import duplicates as D
from .operators import enrichment as EN
from .operators import evidence as E
from .operators import filters as FL
from .operators import guard as G
from .operators import index as I
from .operators import patches as P
from .operators import records as RC
from .operators import retrieval as R
from .operators import review as Q
from .operators import telemetry as TM
from .operators import validation as V
from .operators.ranking import global_rank, nearest_rank
from .plans.views import STAR_SQL, approved, items_view, read, receipts_view, star_items, star_receipts

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, star: bool = False):
    """Registers f(spark, sf_dir); star: the SQL uses the records and views of the star schema."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {STAR_SQL.strip()}{sql if sql.startswith(',') else chr(10) + sql}" if star else sql
        return f

    return add


def _rv(spark, d):
    return receipts_view(star_receipts(spark, d), star_items(spark, d))


def _iv(spark, d):
    return items_view(star_receipts(spark, d), star_items(spark, d))


# Views and guarded SQL

query("analytics_receipts_view", "SELECT * FROM analytics_receipts", True)(_rv)
query("analytics_purchase_items_view", "SELECT * FROM analytics_purchase_items", True)(_iv)


@query("guarded_sql_segment_sum", "SELECT currency, floor(sum(CAST(line_total AS DECIMAL(18,2)))::DOUBLE * 100 + 0.5) / 100 AS value FROM analytics_purchase_items WHERE merchant = 'building' GROUP BY currency", True)
def _(spark, d):
    f = FL.QueryFilter("merchant", "matches", "Building", "f001")
    found = FL.resolve(f, [r[0] for r in A.distinct_values(star_receipts(spark, d), "merchant_normalized", 100).collect()])
    p = FL.parameters(f, found)
    plan = G.Plan("SELECT currency, ROUND(SUM(CAST(line_total AS DECIMAL(18, 2))), 2) AS value FROM analytics_purchase_items WHERE merchant IN (:f001_merchant_0) GROUP BY currency ORDER BY currency LIMIT 100", p, "grouped_rows")
    df = G.frame(spark, plan, {"analytics_purchase_items": _iv(spark, d)}, protected=p, filters=[FL.guard_filter(f, found)])
    return df.select("currency", M.cents(F.col("value").cast("double")).alias("value"))


@query("guarded_sql_month_count", "SELECT receipt_month, count(*) AS n FROM analytics_receipts WHERE receipt_date BETWEEN '1996-01-01' AND '1996-12-31' GROUP BY receipt_month", True)
def _(spark, d):
    f = FL.QueryFilter("purchase_date", "between", ["1996-01-01", "1996-12-31"])
    r = FL.resolve(f)
    p = FL.parameters(f, r)
    sql = "SELECT receipt_month, COUNT(*) AS n FROM analytics_receipts WHERE receipt_date BETWEEN :f001_date_0 AND :f001_date_1 GROUP BY receipt_month ORDER BY receipt_month LIMIT 100"
    return G.frame(spark, G.Plan(sql, p), {"analytics_receipts": _rv(spark, d)}, protected=p, filters=[FL.guard_filter(f, r)])


_GUARDED = {
    "guarded_strftime_total": ("SELECT strftime('%Y-%m', receipt_date) AS ym, TOTAL(grand_total) > 0 AS some, COUNT(*) AS n FROM analytics_receipts GROUP BY strftime('%Y-%m', receipt_date) LIMIT 100", "SELECT strftime(CAST(receipt_date AS DATE), '%Y-%m') AS ym, sum(grand_total) > 0 AS some, count(*) AS n FROM analytics_receipts GROUP BY 1 ORDER BY 1 LIMIT 100"),
    "guarded_glob_like": ("SELECT COUNT(*) AS n, SUM(CASE WHEN receipt_date GLOB '199[67]-0?-*' THEN 1 ELSE 0 END) AS early, SUM(CASE WHEN merchant LIKE 'BUILD%' THEN 1 ELSE 0 END) AS build FROM analytics_receipts", "SELECT count(*) AS n, CAST(sum(CASE WHEN regexp_matches(receipt_date, '^199[67]-0.-') THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN merchant ILIKE 'BUILD%' THEN 1 ELSE 0 END) AS BIGINT) AS build FROM analytics_receipts"),
    "guarded_min_max_division": ("SELECT MAX(MIN(item_count, 3)) AS most, MIN(MAX(item_count, 2)) AS least, MAX(item_count / 2) AS half, MAX(receipt_id / 0) AS none FROM analytics_receipts", "SELECT max(least(item_count, 3)) AS most, min(greatest(item_count, 2)) AS least, max(item_count // 2) AS half, CAST(NULL AS BIGINT) AS none FROM analytics_receipts"),
    "guarded_lenient_cast": ("SELECT MAX(CAST(receipt_date AS INTEGER)) AS year, SUM(CAST(merchant AS INTEGER)) AS zero, MAX(CAST('12.5abc' AS REAL)) AS part FROM analytics_receipts", "SELECT max(CAST(substr(receipt_date, 1, 4) AS BIGINT)) AS year, 0::BIGINT AS zero, 12.5::DOUBLE AS part FROM analytics_receipts"),
    "guarded_dates": ("SELECT date(receipt_date, 'start of month', '+1 month') AS next_month, CAST(MIN(julianday(receipt_date) - julianday('1992-01-01')) AS INTEGER) AS days, COUNT(DISTINCT datetime(receipt_date)) AS n FROM analytics_receipts GROUP BY date(receipt_date, 'start of month', '+1 month') LIMIT 100", "SELECT strftime(date_trunc('month', CAST(receipt_date AS DATE)) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, min(date_diff('day', DATE '1992-01-01', CAST(receipt_date AS DATE))) AS days, count(DISTINCT receipt_date) AS n FROM analytics_receipts GROUP BY 1 ORDER BY 1 LIMIT 100"),
    "guarded_month_sum": ("SELECT ROUND(SUM(CAST(grand_total AS DECIMAL(18, 2))), 2) AS value, currency FROM analytics_receipts WHERE lower(merchant) = :f001_merchant_0 AND receipt_month = '1996-06' GROUP BY currency LIMIT 100", "SELECT sum(CAST(grand_total AS DECIMAL(18,2))) AS value, currency FROM analytics_receipts WHERE merchant = 'furniture' AND receipt_month = '1996-06' GROUP BY currency"),
    "guarded_join_items": ("SELECT r.merchant, COUNT(*) AS n FROM analytics_receipts r JOIN analytics_purchase_items i ON (r.receipt_id = i.receipt_id) WHERE i.category = :c AND r.receipt_id IN (SELECT receipt_id FROM analytics_receipts WHERE grand_total > 1000) GROUP BY r.merchant HAVING COUNT(*) > 2 ORDER BY n DESC, r.merchant LIMIT 20", "SELECT r.merchant, count(*) AS n FROM analytics_receipts r JOIN analytics_purchase_items i ON r.receipt_id = i.receipt_id WHERE i.category = 'small' AND r.grand_total > 1000 GROUP BY 1 HAVING count(*) > 2 ORDER BY n DESC, r.merchant LIMIT 20"),
}


def _guarded(spark, d, sql: str) -> DataFrame:
    given = {"f001_merchant_0": "furniture", "c": "small"}
    plan = G.Plan(sql, {k: v for k, v in given.items() if f":{k}" in sql}, "rows" if "LIMIT" in sql else "scalar")
    return G.frame(spark, plan, {"analytics_receipts": _rv(spark, d), "analytics_purchase_items": _iv(spark, d)})


for _name, (_sql, _want) in _GUARDED.items():
    query(_name, _want, True)(lambda s, d, q=_sql: _guarded(s, d, q))


@query("set_ops_views", "SELECT merchant, 'both' AS side FROM (SELECT merchant FROM analytics_receipts INTERSECT SELECT merchant FROM analytics_purchase_items) UNION ALL SELECT merchant, 'receipts' AS side FROM (SELECT merchant FROM analytics_receipts EXCEPT SELECT merchant FROM analytics_purchase_items)", True)
def _(spark, d):
    a, b = _rv(spark, d).select("merchant"), _iv(spark, d).select("merchant")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("receipts")))


@query("window_sum_over", "SELECT DISTINCT merchant, receipt_month, sum(CAST(sum(CAST(grand_total AS DECIMAL(18,2))) AS DECIMAL(18,2))) OVER (PARTITION BY merchant ORDER BY receipt_month)::DOUBLE AS running FROM analytics_receipts GROUP BY merchant, receipt_month", True)
def _(spark, d):
    from pyspark.sql import Window as W

    # months are summed before the window: a merchant's window has one row a month, however many receipts it has
    m = _rv(spark, d).groupBy("merchant", "receipt_month").agg(F.sum(F.col("grand_total").cast("decimal(18,2)")).alias("s"))
    return m.select("merchant", "receipt_month", F.sum("s").over(W.partitionBy("merchant").orderBy("receipt_month")).cast("double").alias("running"))


# Fixed aggregations

query("row_counts", "SELECT (SELECT count(*) FROM receipts) AS receipt_count, (SELECT count(*) FROM items) AS item_count", True)(lambda s, d: A.row_counts(star_receipts(s, d), star_items(s, d)))
query("top_merchants", "SELECT merchant_name AS merchant, count(*) AS n, coalesce(sum(CAST(grand_total AS DECIMAL(18,2))), 0)::DOUBLE AS total FROM receipts GROUP BY 1 ORDER BY n DESC, merchant ASC NULLS FIRST LIMIT 10", True)(lambda s, d: A.top_groups(star_receipts(s, d), F.col("merchant_name"), "grand_total", "merchant"))
query("top_categories", "SELECT coalesce(nullif(category_key, ''), 'uncategorized') AS category, count(*) AS n, coalesce(sum(CAST(line_total AS DECIMAL(18,2))), 0)::DOUBLE AS total FROM items GROUP BY 1 ORDER BY n DESC, category ASC NULLS FIRST LIMIT 10", True)(
    lambda s, d: A.top_groups(star_items(s, d), F.coalesce(F.nullif(F.col("category_key"), F.lit("")), F.lit("uncategorized")), "line_total", "category"))
query("distinct_catalogs", "SELECT 'merchant' AS field, merchant AS value FROM (SELECT DISTINCT merchant FROM analytics_receipts) WHERE trim(merchant) <> '' UNION ALL SELECT 'currency', currency FROM (SELECT DISTINCT currency FROM analytics_receipts) WHERE trim(currency) <> '' UNION ALL SELECT 'category', category FROM (SELECT DISTINCT category FROM analytics_purchase_items) WHERE trim(category) <> ''", True)(
    lambda s, d: A.distinct_values(_rv(s, d), "merchant").select(F.lit("merchant").alias("field"), "value").union(A.distinct_values(_rv(s, d), "currency").select(F.lit("currency"), "value")).union(A.distinct_values(_iv(s, d), "category").select(F.lit("category"), "value")))
query("date_range", "SELECT min(receipt_date) AS first_date, max(receipt_date) AS last_date FROM receipts", True)(lambda s, d: A.date_range(star_receipts(s, d)))
query("list_receipts_filtered", "SELECT r.receipt_id, merchant_name, receipt_date, currency, grand_total, (SELECT count(*) FROM items i WHERE i.receipt_id = r.receipt_id) AS item_count FROM receipts r WHERE merchant_normalized = 'furniture' AND receipt_date >= '1997-01-01' ORDER BY grand_total DESC NULLS LAST, r.receipt_id LIMIT 50", True)(
    lambda s, d: A.list_receipts(star_receipts(s, d), star_items(s, d), "total_desc", 50, merchant="furniture", date_from="1997-01-01"))
_CUR = "CASE WHEN count(DISTINCT currency) > 1 THEN 'MIXED' ELSE min(currency) END AS currency"
_SUM = "coalesce(sum(CAST(grand_total AS DECIMAL(18,2)))::DOUBLE, 0.0)"
_AVG = "coalesce(floor(sum(CAST(grand_total AS DECIMAL(18,2)))::DOUBLE / nullif(count(grand_total), 0) * 100 + 0.5) / 100, 0.0)"
query("aggregate_receipts_sum", f"SELECT {_SUM} AS value, count(*) AS n, {_CUR} FROM receipts WHERE merchant_normalized = 'household'", True)(lambda s, d: A.aggregate_receipts(star_receipts(s, d), "sum", merchant="household"))
query("aggregate_receipts_avg", f"SELECT {_AVG} AS value, count(*) AS n, {_CUR} FROM receipts WHERE receipt_date >= '1998-01-01' AND receipt_date <= '1998-06-30'", True)(lambda s, d: A.aggregate_receipts(star_receipts(s, d), "average", date_from="1998-01-01", date_to="1998-06-30"))
query("aggregate_receipts_count", f"SELECT count(*)::DOUBLE AS value, count(*) AS n, {_CUR} FROM receipts", True)(lambda s, d: A.aggregate_receipts(star_receipts(s, d), "count"))
query("aggregate_one_currency", f"SELECT {_SUM} AS value, count(*) AS n, {_CUR} FROM receipts WHERE currency = 'USD'", True)(lambda s, d: A.aggregate_receipts(star_receipts(s, d).where("currency = 'USD'"), "sum"))
query("group_receipts_merchant", f"SELECT coalesce(merchant_normalized, 'unknown') AS group_key, {_SUM} AS value, count(*) AS n, {_CUR} FROM receipts GROUP BY 1 ORDER BY value DESC, group_key LIMIT 100", True)(lambda s, d: A.group_receipts(star_receipts(s, d), "merchant", "sum"))
query("group_receipts_month", f"SELECT substr(receipt_date, 1, 7) AS group_key, {_AVG} AS value, count(*) AS n, {_CUR} FROM receipts GROUP BY 1 ORDER BY value DESC, group_key NULLS FIRST LIMIT 1000", True)(lambda s, d: A.group_receipts(star_receipts(s, d), "month", "average", 1000))
query("cheapest_item_min_by", "SELECT lower(description) AS item, currency, min(line_total) AS price, arg_min(description, {'a': line_total, 'b': description}) AS spelling FROM analytics_purchase_items GROUP BY 1, 2 ORDER BY price NULLS FIRST, item, currency NULLS FIRST LIMIT 10", True)(lambda s, d: A.cheapest(_iv(s, d)))
query("scalar_subquery_item_count", "SELECT receipt_id, item_count FROM analytics_receipts", True)(lambda s, d: _rv(s, d).select("receipt_id", "item_count"))
query("rollup_currency_month", "SELECT currency, receipt_month, grouping(currency) + grouping(receipt_month) AS level, count(*) AS n FROM analytics_receipts GROUP BY ROLLUP (currency, receipt_month)", True)(
    lambda s, d: _rv(s, d).rollup("currency", "receipt_month").agg((F.grouping("currency") + F.grouping("receipt_month")).cast("long").alias("level"), F.count("*").alias("n")))

# Telemetry: events as model calls

_CALLS_SQL = """calls AS (
  SELECT event_id AS call_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS recorded_at, 'prov' || (user_id % 3) AS provider, event_type AS model, event_type AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS cached_input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 AS cache_write_input_tokens, value AS generation_duration_ms
  FROM events
), prices AS (SELECT * FROM (VALUES ('prov0', 'click', 'EUR', 0.2, 0.02, 0.25, 1.2), ('prov0', 'view', 'EUR', 2.0, NULL, NULL, 8.0), ('prov1', 'click', 'EUR', 1.0, 0.5, 0.5, 4.0), ('prov1', 'purchase', 'EUR', 1.0, 0.5, 0.5, NULL), ('prov9', 'unseen', 'EUR', 1.0, 1.0, 1.0, 1.0)) p(provider, model, currency, i, c, w, o)
), parts AS (
  SELECT calls.*, currency, i, c, w, o, least(greatest(cached_input_tokens, 0), input_tokens) AS ca, least(cache_write_input_tokens, input_tokens - least(cached_input_tokens, input_tokens)) AS wr FROM calls LEFT JOIN prices USING (provider, model)
), costed AS (
  SELECT *, input_tokens - ca - wr AS st, CASE WHEN (input_tokens - ca - wr > 0 AND i IS NULL) OR (ca > 0 AND c IS NULL) OR (wr > 0 AND w IS NULL) OR (output_tokens > 0 AND o IS NULL) THEN NULL
    ELSE 0.0 + (input_tokens - ca - wr) * coalesce(i, 0)::DOUBLE / 1000000.0 + ca * coalesce(c, 0)::DOUBLE / 1000000.0 + wr * coalesce(w, 0)::DOUBLE / 1000000.0 + output_tokens * coalesce(o, 0)::DOUBLE / 1000000.0 END AS estimated_cost FROM parts
)"""


def _calls(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("call_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"), F.concat(F.lit("prov"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("event_type").alias("model"), F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("duration_ms"), (k * 10).alias("input_tokens"), k.alias("output_tokens"), (k * 3).alias("cached_input_tokens"), (k * 20).alias("cache_write_input_tokens"), F.col("value").alias("generation_duration_ms"),
    )


def _prices(spark) -> DataFrame:
    rows = [("prov0", "click", "EUR", 0.2, 0.02, 0.25, 1.2), ("prov0", "view", "EUR", 2.0, None, None, 8.0), ("prov1", "click", "EUR", 1.0, 0.5, 0.5, 4.0), ("prov1", "purchase", "EUR", 1.0, 0.5, 0.5, None), ("prov9", "unseen", "EUR", 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "provider string, model string, currency string, input_price_per_million double, cached_input_price_per_million double, cache_write_input_price_per_million double, output_price_per_million double")


def _costed(s, d):
    return TM.with_cost(_calls(s, d), _prices(s))


_AVG_MS = "sum(CAST(duration_ms AS DECIMAL(28,10)))::DOUBLE / count(duration_ms) AS average_ms"
_COST = "sum(CAST(estimated_cost AS DECIMAL(28,10)))::DOUBLE AS cost"
query("left_join_pricing_cost", f"WITH {_CALLS_SQL} SELECT call_id, st AS standard_input_tokens, ca AS cached_input_tokens, wr AS cache_write_input_tokens, floor(estimated_cost * 1e8 + 0.5) / 1e8 AS estimated_cost, floor(output_tokens / (nullif(generation_duration_ms, 0) / 1000.0) * 100 + 0.5) / 100 AS tokens_per_second FROM costed")(
    lambda s, d: _costed(s, d).select("call_id", "standard_input_tokens", "cached_input_tokens", "cache_write_input_tokens", (F.floor(F.col("estimated_cost") * 1e8 + 0.5).cast("double") / 1e8).alias("estimated_cost"), M.cents(F.col("tokens_per_second")).alias("tokens_per_second")))
query("telemetry_summary", f"WITH {_CALLS_SQL} SELECT count(*) AS calls, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, {_AVG_MS}, quantile_disc(duration_ms, 0.95) AS p95_ms, {_COST}, count(estimated_cost) AS priced, count(*) - count(estimated_cost) AS unpriced, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency FROM costed")(lambda s, d: TM.summary(_costed(s, d)))
query("telemetry_p95", f"WITH {_CALLS_SQL} SELECT provider, quantile_disc(duration_ms, 0.95) AS p95_ms FROM calls GROUP BY provider")(lambda s, d: nearest_rank(_calls(s, d), ["provider"], "duration_ms", 0.95, "p95_ms"))
for _key in ("operation", "provider"):
    query(f"telemetry_group_by_{_key}", f"WITH {_CALLS_SQL} SELECT {_key} AS group_key, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, {_AVG_MS}, {_COST}, count(estimated_cost) AS priced, count(*) FILTER (status = 'failed') AS failed FROM costed GROUP BY 1")(lambda s, d, k=_key: TM.by_group(_costed(s, d), k))
query("model_catalog_full_outer", f"WITH {_CALLS_SQL} SELECT coalesce(a.provider, b.provider) AS provider, coalesce(a.model, b.model) AS model, last_seen, coalesce(calls, 0) AS calls, o IS NOT NULL AS priced FROM (SELECT provider, coalesce(model, '') AS model, max(recorded_at) AS last_seen, count(*) AS calls FROM calls GROUP BY 1, 2) a FULL JOIN prices b ON a.provider = b.provider AND a.model = b.model")(lambda s, d: TM.model_catalog(_calls(s, d), _prices(s)))
query("paging_limit_offset", f"WITH {_CALLS_SQL} SELECT call_id, recorded_at, status FROM calls WHERE status = 'failed' ORDER BY recorded_at DESC NULLS LAST, call_id LIMIT 20 OFFSET 40")(lambda s, d: TM.page(TM.select_calls(_calls(s, d), status="failed"), 20, 40).select("call_id", "recorded_at", "status"))
query("telemetry_lookback", f"WITH {_CALLS_SQL} SELECT provider, count(*) AS n FROM calls WHERE recorded_at >= (SELECT strftime(max(ts) - INTERVAL 24 HOURS, '%Y-%m-%dT%H:%M:%S') FROM events) GROUP BY 1")(
    lambda s, d: _calls(s, d).join(F.broadcast(read(s, d, "events").agg(F.date_format(F.max("ts") - F.expr("INTERVAL 24 HOURS"), "yyyy-MM-dd'T'HH:mm:ss").alias("since"))), F.col("recorded_at") >= F.col("since")).groupBy("provider").agg(F.count("*").alias("n")))

# Scalar functions, over all documents or parts

_NORM = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', ' ', 'g'))"
query("normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS normal FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", T.normalize_text("text").alias("normal")))
query("fold_text_nfkd", r"SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", FL.fold(F.col("text")).alias("folded")))
query("as_float_parse", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS value FROM lineitem")(
    lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.as_float_de(F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" €"))).alias("value")))
query("currency_normalize", "SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'USD' WHEN '3' THEN NULL WHEN '4' THEN 'CHF' ELSE 'EUR' END AS currency FROM orders")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", M.currency(F.element_at(F.create_map(*[F.lit(x) for x in ("1", " euro ", "2", "us$", "3", "n/a", "4", "chf", "5", "€")]), F.substr("o_orderpriority", F.lit(1), F.lit(1)))).alias("currency")))
query("merchant_alias_case", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'dm' WHEN 1 THEN 'aldi' WHEN 2 THEN 'rossmann' ELSE " + _NORM.format("s_name") + " END AS merchant FROM supplier")(
    lambda s, d: read(s, d, "supplier").select("s_suppkey", T.merchant_name(F.when(F.col("s_suppkey") % 4 == 0, "DM-Drogerie Markt 12").when(F.col("s_suppkey") % 4 == 1, "ALDI SÜD").when(F.col("s_suppkey") % 4 == 2, "Rossmann GmbH").otherwise(F.col("s_name"))).alias("merchant")))
query("category_by_alias", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'jewellery' WHEN p_name LIKE '%bolt%' OR p_name LIKE '%gear%' THEN 'hardware' END AS category FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", T.category_by_alias(F.col("p_name"), {"jewellery": ["Ring"], "hardware": ["bolt", "gear"]}).alias("category")))
query("content_fingerprint", "SELECT receipt_id, sha256(coalesce(merchant_normalized, '') || '|' || coalesce(receipt_date, '') || '||' || printf('%.2f', grand_total) || '|' || (SELECT count(*) FROM items i WHERE i.receipt_id = r.receipt_id)) AS fingerprint FROM receipts r", True)(
    lambda s, d: star_receipts(s, d).join(star_items(s, d).groupBy("receipt_id").agg(F.count("*").alias("n")), "receipt_id", "left").select("receipt_id", D.content_fingerprint(F.col("merchant_normalized"), F.col("receipt_date"), F.lit(None).cast("string"), F.col("grand_total"), F.coalesce("n", F.lit(0))).alias("fingerprint")))
query("sha256_document", "SELECT doc_id, sha256('v1' || chr(10) || text) AS content_hash FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", I.content_hash(F.col("text")).alias("content_hash")))
query("semantic_document", "SELECT p_partkey, 'Product: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10) || 'Brand: ' || p_brand AS document FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", I.semantic_document(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string")).alias("document")))
query("token_containment", "SELECT p_partkey, contains(' ' || p_name || ' ', ' red bolt ') AS both, contains(' ' || p_name || ' ', ' bolt ') AS one FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", T.contains_tokens(F.col("p_name"), F.lit("Red Bolt")).alias("both"), T.contains_tokens(F.col("p_name"), F.lit("bolt")).alias("one")))

# Index

query("indexable_filter", "SELECT receipt_id, item_id, raw_name, quantity FROM items WHERE length(trim(raw_name)) >= 3 AND coalesce(item_type, 'item') = 'item' AND item_status NOT IN ('rejected', 'needs_review')", True)(lambda s, d: I.indexable(star_items(s, d)).select("receipt_id", "item_id", "raw_name", "quantity"))


def _documents(s, d):
    doc = I.semantic_document(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string"))
    return read(s, d, "part").select(F.col("p_partkey").alias("item_id"), doc.alias("document"), I.content_hash(doc).alias("content_hash"))


def _old_index(s, d):
    """An index of an earlier state: every third part is missing, every fifth has another text, and some parts are gone since."""
    docs = _documents(s, d)
    gone = docs.where(F.col("item_id") % 7 == 0).select((-F.col("item_id") - 1).alias("item_id"), "content_hash")
    return docs.where(F.col("item_id") % 3 != 0).select("item_id", F.when(F.col("item_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash")).union(gone)


query("pending_hash_diff", "SELECT p_partkey AS item_id FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")(lambda s, d: I.pending(_documents(s, d), _old_index(s, d)).select("item_id"))
query("stale_embeddings_anti", "SELECT -p_partkey - 1 AS item_id FROM part WHERE p_partkey % 7 = 0")(lambda s, d: I.stale(_old_index(s, d), _documents(s, d)).select("item_id"))

# Search


def _vector(s, d, vec_id: int = 0) -> list[float]:
    return list(read(s, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


query("cosine_topk", "SELECT vec_id, similarity FROM (SELECT e.vec_id, round(CAST(least(greatest(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), -1), 1) AS DECIMAL(18,10)), 6)::DOUBLE AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY similarity DESC, vec_id LIMIT 10")(lambda s, d: R.nearest(read(s, d, "embeddings"), _vector(s, d)))
query("bm25_documents", r"""
WITH base AS (SELECT doc_id, list_filter(string_split(""" + _NORM.format("text") + r""", ' '), lambda w: w <> '') AS words FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM base),
tf AS (SELECT doc_id, len(words) AS length, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM base) WHERE term IN ('licensed', 'mail6', 'the') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(CAST(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS DECIMAL(28,12))), 6)::DOUBLE AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank
FROM tf JOIN df USING (term), corpus GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25""")(lambda s, d: R.bm25(read(s, d, "documents"), "doc_id", "text", ["licensed", "mail6", "the"]))
query("lexical_fallback_score", "SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), 'red') AS INT) + CAST(list_contains(string_split(p_name, ' '), 'bolt') AS INT) + 0.35 * (CAST(contains(p_name, 'red') AS INT) + CAST(contains(p_name, 'bolt') AS INT) + CAST(contains(p_name, 'red bolt') AS INT)) AS score FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'bolt')")(
    lambda s, d: read(s, d, "part").select("p_partkey", R.fallback_score(F.col("p_name"), ["red", "bolt", "red bolt"]).alias("score")).where("score > 0"))
_JACC = """WITH p AS (SELECT p_partkey, p_name AS w, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i::INT, 3))) AS g FROM part), q AS (SELECT list_distinct(list_transform(range(1, 7), lambda i: substr('red bolt', i::INT, 3))) AS g)
SELECT p_partkey, CASE WHEN len(list_intersect(p.g, q.g))::DOUBLE / len(list_distinct(p.g || q.g)) >= 0.45 THEN 2.5 * (len(list_intersect(p.g, q.g))::DOUBLE / len(list_distinct(p.g || q.g))) ELSE 0.0 END AS score FROM p, q"""
query("trigram_jaccard", _JACC)(lambda s, d: read(s, d, "part").select("p_partkey", T.trigram_score(F.col("p_name"), F.lit("red bolt")).alias("score")))
_LEX = """WITH p AS (SELECT p_partkey, lower(p_name) AS t, string_split(lower(p_name), ' ') AS ws FROM part), g AS (SELECT unnest(['red', 'bolt']) AS w),
tri AS (SELECT p_partkey, w, x, list_distinct(list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substr(x, i::INT, 3))) AS gx, list_distinct(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(w, i::INT, 3))) AS gw FROM (SELECT p_partkey, unnest(ws) AS x FROM p), g),
fit AS (SELECT p_partkey, w, max(CASE WHEN x = w THEN 8.0::DOUBLE WHEN length(w) >= 4 AND contains(x, w) THEN 6.0 + least(1.0::DOUBLE, length(w) / length(x)) WHEN length(x) >= 4 AND contains(w, x) THEN 4.0 + least(1.0::DOUBLE, length(x) / length(w))
  WHEN length(x) >= 4 AND length(w) >= 4 AND len(list_intersect(gx, gw)) / len(list_distinct(gx || gw)) >= 0.45 THEN 2.5 * len(list_intersect(gx, gw)) / len(list_distinct(gx || gw)) ELSE 0.0 END) AS best FROM tri GROUP BY 1, 2)
SELECT p_partkey, round(CAST(CASE WHEN any_value(t) = 'red bolt' THEN 20.0::DOUBLE WHEN contains(any_value(t), 'red bolt') THEN 12.0 + least(2.0::DOUBLE, 8.0::DOUBLE / length(any_value(t))) WHEN contains('red bolt', any_value(t)) THEN 5.0 ELSE 0.0 END + sum(best) AS DECIMAL(20,12)), 8)::DOUBLE AS score FROM p JOIN fit USING (p_partkey) GROUP BY 1"""
query("lexical_relevance", _LEX)(lambda s, d: read(s, d, "part").select("p_partkey", T.lexical_relevance("red bolt", F.col("p_name")).alias("score")))
query("lexical_relevance_all", _LEX.replace("'red', 'bolt'", "'ring', 'widgets'").replace("red bolt", "ring widgets").replace("8.0::DOUBLE / length(any", "12.0::DOUBLE / length(any"))(
    lambda s, d: read(s, d, "part").select("p_partkey", T.lexical_relevance("ring widgets", F.col("p_name")).alias("score")))
query("rrf_fusion", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS a, row_number() OVER (ORDER BY label, vec_id) AS b FROM embeddings) SELECT vec_id, 1.0::DOUBLE / (60 + a) + CASE WHEN vec_id % 2 = 0 THEN 1.5::DOUBLE / (60 + b) ELSE 0.0 END AS fusion FROM r")(lambda s, d: _fused(s, d))


def _fused(s, d) -> DataFrame:
    e = read(s, d, "embeddings").select("vec_id", "label")
    e = global_rank(global_rank(e, [F.desc("vec_id")], "a"), [F.col("label"), F.col("vec_id")], "b")
    return e.select("vec_id", R.fuse(F.col("a"), F.when(F.col("vec_id") % 2 == 0, F.col("b"))).alias("fusion"))


def _hybrid(s, d) -> DataFrame:
    parts = read(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("description"))
    c = parts.join(read(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    c = c.select("item_id", "description", T.identity_key(F.col("description"), F.col("item_id")).alias("identity"), "embedding", F.lit(None).cast("int").alias("fts_rank"))
    return R.hybrid(c, "red bolt", _vector(s, d), limit=20)


query("dedup_representative", "SELECT lower(p_name) AS identity, list_sort(list(p_partkey)) AS item_ids, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1")(
    lambda s, d: read(s, d, "part").groupBy(T.identity_key(F.col("p_name"), F.col("p_partkey")).alias("identity")).agg(F.sort_array(F.collect_list("p_partkey")).alias("item_ids"), F.count("*").alias("n"), F.min("p_partkey").alias("first_id")))
query("retrieval_recall_at_k", "WITH r AS (SELECT label AS case_id, vec_id AS item_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), e AS (SELECT label AS case_id, list(vec_id) AS expected FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1) SELECT e.case_id, count(*) FILTER (rank <= 20 AND list_contains(expected, item_id)) / len(expected) AS recall, count(*) FILTER (rank <= 20 AND list_contains(expected, item_id)) / 20 AS precision, coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 20 AND list_contains(expected, item_id)), 0.0) AS reciprocal_rank FROM e JOIN r USING (case_id) GROUP BY e.case_id, expected")(lambda s, d: _recall(s, d))


def _recall(s, d) -> DataFrame:
    from pyspark.sql import Window as W

    e = read(s, d, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("item_id"))
    results = e.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("item_id")))
    cases = e.where(F.col("item_id") % 3 == 0).groupBy("case_id").agg(F.collect_list("item_id").alias("expected")).withColumn("top_k", F.lit(20))
    return R.evaluate(results, cases)


# Record quality


def _records(s, d):
    """Line items as a record's items, orders as records; VAT and payment follow from the total, wrong for some."""
    o = read(s, d, "orders")
    t, k = F.col("o_totalprice"), F.col("o_orderkey")
    net = M.money(t / 1.19).cast("double")
    return o.select(
        k.alias("record_id"), t.alias("total"), F.when(k % 3 == 0, t + 5.0).alias("pre_discount_total"), F.when(k % 3 == 0, F.when(k % 6 == 0, 4.0).otherwise(5.0)).alias("discount_total"), net.alias("net"), F.when(k % 5 == 0, F.lit(1.0)).otherwise(M.money(t).cast("double") - net).alias("vat"),
        F.lit(19.0).alias("vat_rate"), F.when(k % 4 != 0, t + 10.0).alias("paid"), F.when(k % 8 == 1, F.lit(9.0)).otherwise(F.lit(10.0)).alias("change"), F.array(F.lit("EUR"), F.when(k % 11 == 0, F.lit("USD")), F.lit("EUR")).alias("currencies"),
    )


def _facts(s, d):
    li = read(s, d, "lineitem")
    return V.item_facts(li.select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").cast("string").alias("name"), F.lit("pc").alias("unit"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("final_price"), (F.col("l_extendedprice") + 1.0).alias("original_price"), F.when(F.col("l_tax") == 0.08, 2.0).otherwise(1.0).alias("discount_amount")))


def _checks(s, d, *codes):
    return V.check_records(_records(s, d), _facts(s, d), codes=list(codes) or None)


_CODE = lambda code, cond: (f"SELECT o_orderkey AS record_id, CASE WHEN ({cond}) IS NULL THEN 'skipped' WHEN {cond} THEN 'passed' ELSE 'failed' END AS status FROM orders", code)  # noqa: E731
for _name, (_sql, _code) in {
    "payment_change_check": _CODE("PAYMENT_CHANGE", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 <> 1 END"), "currency_consistency": _CODE("CURRENCY_CONSISTENCY", "o_orderkey % 11 <> 0"),
    "pre_discount_check": _CODE("PRE_DISCOUNT_TOTAL", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 <> 0 END"), "net_plus_vat_check": _CODE("NET_PLUS_VAT", "o_orderkey % 5 <> 0 OR abs(CAST(round(CAST(o_totalprice AS DECIMAL(18,6)) / 1.19, 2) AS DOUBLE) + 1.0 - o_totalprice) <= 0.02"),
}.items():
    query(_name, _sql)(lambda s, d, c=_code: _checks(s, d, c).select("record_id", "status"))
query("item_sum_reconciliation", """WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber <> 7) AS p, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey AS record_id, CASE WHEN n IS NULL OR p <> n THEN 'skipped' WHEN abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.02 OR (o_orderkey % 3 = 0 AND abs(s - CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 5 END - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.02) THEN 'passed' ELSE 'failed' END AS status FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")(lambda s, d: _checks(s, d, "ITEM_SUM_RECONCILIATION").select("record_id", "status"))
query("repeated_items", "SELECT l_orderkey AS record_id, count(*) AS repeated FROM (SELECT l_orderkey, l_linestatus, l_returnflag, floor(l_quantity / 10) FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1")(
    lambda s, d: V.item_facts(read(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("unit"), F.floor(F.col("l_quantity") / 10).alias("quantity"), F.lit(1.0).alias("final_price"), F.lit(None).cast("double").alias("original_price"), F.lit(None).cast("double").alias("discount_amount"))).where("repeated > 0").select("record_id", "repeated"))
query("item_discount_faults", "SELECT l_orderkey AS record_id, count(*) FILTER (l_linenumber <> 7 AND l_tax = 0.08) AS discount_faults FROM lineitem GROUP BY 1")(lambda s, d: _facts(s, d).select("record_id", "discount_faults"))
_VAT_OK = "(o_orderkey % 5 <> 0 OR abs(CAST(round(CAST(round(CAST(o_totalprice AS DECIMAL(18,6)) / 1.19, 2) AS DECIMAL(18,6)) * 0.19, 2) AS DOUBLE) - 1.0) <= 0.02)"
query("vat_rate_check", f"SELECT o_orderkey AS record_id, CASE WHEN {_VAT_OK} THEN 'passed' ELSE 'failed' END AS status FROM orders")(lambda s, d: _checks(s, d, "VAT_RATE").select("record_id", "status"))
for _name, (_code, _cond) in {
    "nonnegative_amounts_check": ("NONNEGATIVE_AMOUNTS", "true"), "items_present_check": ("ITEMS_PRESENT", "n IS NOT NULL"), "item_prices_complete_check": ("ITEM_PRICES_COMPLETE", "p = n"), "item_discount_check": ("ITEM_DISCOUNT_ARITHMETIC", "faults = 0"),
}.items():
    query(_name, f"WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber <> 7) AS p, count(*) FILTER (l_linenumber <> 7 AND l_tax = 0.08) AS faults FROM lineitem GROUP BY 1) SELECT o_orderkey AS record_id, CASE WHEN ({_cond}) IS NULL THEN 'skipped' WHEN {_cond} THEN 'passed' ELSE 'failed' END AS status FROM orders LEFT JOIN f ON o_orderkey = l_orderkey")(
        lambda s, d, c=_code: _checks(s, d, c).select("record_id", "status"))
query("validation_rollup", f"""WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber <> 7) AS p, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) FILTER (l_linenumber <> 7 AND l_tax = 0.08) AS faults FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS record_id, n IS NOT NULL AS r1, p = n AS r2, faults = 0 AS r3,
  CASE WHEN p = n THEN abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.02 OR (o_orderkey % 3 = 0 AND abs(s - CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 5 END - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.02) END AS r4,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 <> 0 END AS r5, o_orderkey % 5 <> 0 OR abs(CAST(round(CAST(o_totalprice AS DECIMAL(18,6)) / 1.19, 2) AS DOUBLE) + 1.0 - o_totalprice) <= 0.02 AS r6,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 <> 1 END AS r7, {_VAT_OK} AS r8, o_orderkey % 11 <> 0 AS r9 FROM orders LEFT JOIN f ON o_orderkey = l_orderkey),
t AS (SELECT record_id, len(list_filter([r1, r2, r3, r4, r5, r6, r7, r8, r9], lambda x: NOT x)) AS reviews, len(list_filter([r1, r2, r3, r4, r5, r6, r7, r8, r9], lambda x: x IS NULL)) AS skipped FROM c)
SELECT record_id, 0::BIGINT AS errors, reviews, skipped, CASE WHEN reviews > 0 THEN 'review_required' ELSE 'valid' END AS status, CASE WHEN reviews > 0 THEN 'needs_review' ELSE 'import' END AS decision FROM t""")(
    lambda s, d: V.roll_up(_checks(s, d)).select("record_id", "errors", "reviews", "skipped", "status", V.decision(F.col("status")).alias("decision")))
_WORDS_OF = "list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
_LETTERS = "regexp_replace({0}, '[^A-Za-zÄÖÜäöüß]', '', 'g')"
_SHORT = "(" + ", ".join(f"'{w}'" for w in C.SHORT_WORDS) + ")"
query("noisy_description_flags", f"""WITH d AS (SELECT doc_id, substr(trim(coalesce(text, ''), ' '), 1, 240) AS t FROM documents),
w AS (SELECT *, {_WORDS_OF} AS ws, regexp_replace(t, '[ \\t\\n\\v\\f\\r]+', '', 'g') AS bare FROM d),
m AS (SELECT *, length(bare) AS size, length(regexp_replace(bare, '[^\\p{{Nd}}]', '', 'g')) AS digits, length(regexp_replace(bare, '[\\p{{L}}\\p{{N}}]', '', 'g')) AS marks, upper(replace({_LETTERS.format("coalesce(ws[len(ws)], '')")}, 'ß', 'ss')) AS tail FROM w)
SELECT doc_id, concat_ws('|', CASE WHEN t = '' THEN 'empty_description' END, CASE WHEN t <> '' AND length(t) <= 3 THEN 'very_short_description' END, CASE WHEN t <> '' AND len(ws) = 1 AND length(t) <= 5 THEN 'single_short_token' END,
  CASE WHEN regexp_matches(t, '[�|§#@~^_<>{{}}\\[\\]]') THEN 'contains_ocr_marker' END,
  CASE WHEN regexp_matches(bare, '[0-9]{{5,}}') OR (digits >= 4 AND digits / size >= 0.3) OR (marks >= 3 AND marks / size >= 0.2) OR (NOT regexp_matches(bare, '\\p{{L}}') AND digits > 0) OR regexp_matches(bare, '(?:[0-9]+[./-]){{2,}}[0-9]+') THEN 'code_like_or_numeric_description' END,
  CASE WHEN regexp_matches(t, '[.,:;/-]$') THEN 'truncated_or_punctuation_ending' END, CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])[A-Za-zÄÖÜäöüß]{{1,2}}\\.$') THEN 'abbreviated_last_token' END,
  CASE WHEN len(ws) >= 2 AND len(list_filter(ws, lambda x: length({_LETTERS.format("x")}) <= 2 AND upper(x) NOT IN {_SHORT})) >= 2 THEN 'many_short_tokens' END,
  CASE WHEN length(tail) BETWEEN 2 AND 3 AND tail NOT IN {_SHORT} AND length(t) > 8 THEN 'truncated_last_token' END) AS reasons FROM m""".replace("\\\\", "\\"))(
    lambda s, d: read(s, d, "documents").select("doc_id", F.concat_ws("|", C.noise(F.col("text"))).alias("reasons")))
query("calibration_caps", "SELECT p_partkey, least(0.9, CASE WHEN p_partkey % 4 = 1 THEN 0.75 ELSE 1 END, CASE WHEN p_partkey % 3 <> 0 THEN 0.8 ELSE 1 END, CASE WHEN p_partkey % 3 = 2 THEN 0.6 ELSE 1 END, CASE WHEN p_partkey % 5 = 0 THEN 0.6 ELSE 1 END, CASE WHEN p_partkey % 6 = 0 THEN 0.35 ELSE 1 END)::DOUBLE AS calibrated FROM part")(lambda s, d: _calibrated(s, d).select("p_partkey", "calibrated"))


def _calibrated(s, d) -> DataFrame:
    k = F.col("p_partkey")
    df = read(s, d, "part").select(
        "p_partkey", F.lit("organic apple juice").alias("description"), F.when(k % 6 == 0, "unknown").otherwise("drinks").alias("category_key"), F.lit(0.9).alias("confidence"), F.when(k % 4 == 1, "This is probably juice").otherwise("The text says juice").alias("reason"),
        F.when(k % 3 == 0, "explicit").when(k % 3 == 1, "contextual").otherwise("ambiguous").alias("text_certainty"), F.when(k % 5 == 0, 1).otherwise(0).alias("unsupported"), F.lit(False).alias("fallback"),
    )
    return C.calibrate(df)


# Duplicates and review


def _dup_records(s, d):
    r = star_receipts(s, d)
    sig = D.item_signature(star_items(s, d))
    return r.join(sig, "receipt_id", "left").select(F.col("receipt_id").alias("id"), F.lit(None).cast("string").alias("file_sha256"), F.col("merchant_normalized").alias("merchant"), F.floor(F.col("grand_total") / 1000).cast("double").alias("grand_total"), "receipt_date", F.lit(None).cast("string").alias("receipt_time"), "names")


query("duplicate_pairs_score", """, sig AS (SELECT receipt_id, list_slice(list_sort(list_distinct(list(raw_name))), 1, 80) AS names FROM items GROUP BY 1),
r AS (SELECT receipt_id AS id, merchant_normalized AS merchant, floor(grand_total / 1000) AS total, receipt_date, names FROM receipts LEFT JOIN sig USING (receipt_id)),
s AS (SELECT a.id AS id_a, b.id AS id_b, 20 * CAST(a.merchant = b.merchant AND a.merchant <> '' AS INT) + 25 * CAST(a.total = b.total AS INT) + 20 AS base, coalesce(len(list_intersect(a.names, b.names))::DOUBLE / nullif(len(list_distinct(a.names || b.names)), 0), 0) AS o FROM r a JOIN r b ON a.receipt_date = b.receipt_date AND a.id < b.id)
SELECT id_a, id_b, base + CASE WHEN o >= 0.75 THEN 30 WHEN o >= 0.45 THEN 15 ELSE 0 END AS score FROM s WHERE base + CASE WHEN o >= 0.75 THEN 30 WHEN o >= 0.45 THEN 15 ELSE 0 END >= 70
UNION ALL
SELECT a.id, b.id, 20 + 25 + CASE WHEN coalesce(len(list_intersect(a.names, b.names))::DOUBLE / nullif(len(list_distinct(a.names || b.names)), 0), 0) >= 0.75 THEN 30 ELSE 15 END FROM r a JOIN r b ON a.merchant = b.merchant AND a.merchant <> '' AND a.total = b.total AND a.id < b.id AND a.receipt_date <> b.receipt_date
WHERE coalesce(len(list_intersect(a.names, b.names))::DOUBLE / nullif(len(list_distinct(a.names || b.names)), 0), 0) >= 0.75""", True)(lambda s, d: D.candidate_pairs(_dup_records(s, d)))
query("item_overlap_jaccard", ", sig AS (SELECT receipt_id, list_slice(list_sort(list_distinct(list(raw_name))), 1, 80) AS names FROM items GROUP BY 1) SELECT a.receipt_id, len(list_intersect(a.names, b.names))::DOUBLE / len(list_distinct(a.names || b.names)) AS overlap FROM sig a JOIN sig b ON b.receipt_id = a.receipt_id + 1", True)(
    lambda s, d: _neighbours(s, d))


def _neighbours(s, d) -> DataFrame:
    g = D.item_signature(star_items(s, d))
    return g.alias("a").join(g.select((F.col("receipt_id") - 1).alias("receipt_id"), F.col("names").alias("other")).alias("b"), "receipt_id").select("receipt_id", D.overlap(F.col("names"), F.col("other")).alias("overlap"))


query("queue_status_decision", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'possible_duplicate' WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'auto_validated' ELSE 'needs_review' END AS status FROM orders")(
    lambda s, d: read(s, d, "orders").select("o_orderkey", Q.queue_status(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 5 == 0, "reject").otherwise("import"), F.col("o_orderkey") % 2 == 0).alias("status")))


def _queue(s, d):
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(F.concat(F.lit("job-"), k.cast("string")).alias("job_id"), F.when(k % 3 == 0, k).alias("receipt_id"), F.when(k % 2 == 0, "needs_review").otherwise("pending").alias("queue_status"), F.col("o_orderdate").alias("updated_at"))


_QUEUE_SQL = ", queue AS (SELECT 'job-' || o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS rid, CASE WHEN o_orderkey % 2 = 0 THEN 'needs_review' ELSE 'pending' END AS queue_status FROM orders), known AS (SELECT * FROM receipts WHERE receipt_id % 4 <> 1), eff AS (SELECT q.job_id, coalesce(a.review_status, b.review_status, queue_status) AS status FROM queue q LEFT JOIN known a ON a.receipt_id = q.rid LEFT JOIN known b ON b.job_id = q.job_id)"
query("effective_status_coalesce", _QUEUE_SQL + " SELECT * FROM eff", True)(lambda s, d: Q.effective_status(_queue(s, d), star_receipts(s, d).where("receipt_id % 4 <> 1")).select("job_id", "status"))
query("queue_summary", _QUEUE_SQL + " SELECT status, count(*) AS n FROM eff GROUP BY 1", True)(lambda s, d: Q.summary(Q.effective_status(_queue(s, d), star_receipts(s, d).where("receipt_id % 4 <> 1"))))
query("latest_job_state", "SELECT conv_id, arg_max(role, turn) AS role, count(*) AS n_events FROM conversations GROUP BY 1")(lambda s, d: Q.latest(read(s, d, "conversations"), "conv_id", "turn", "role"))
query("job_quality_report", "SELECT event_type, count(*) AS n, sum(CAST(abs(value) AS DECIMAL(18,2)))::DOUBLE / count(*) AS mean_difference, max(abs(value)) AS max_difference FROM events GROUP BY 1")(lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (M.exact_sum(F.abs("value")) / F.count("*")).alias("mean_difference"), F.max(F.abs("value")).alias("max_difference")))

# Evidence

query("canonical_rows_explode", r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS row_no, printf('R%04d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS row_id, line FROM (SELECT doc_id, pos, trim(regexp_replace(l, '[ \t\n\v\f\r]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE line <> ''")(lambda s, d: E.canonical_rows(read(s, d, "documents")))


def _matches(s, d) -> DataFrame:
    rows = E.canonical_rows(read(s, d, "documents"))
    names = rows.where(F.col("row_no") % 3 == 1).select("doc_id", F.col("row_no").alias("item_index"), F.upper("line").alias("name"))
    return E.match_items(names, rows.select("doc_id", "row_no", "line")).select("doc_id", "item_index", "row_no", "ratio", "method")


_FOLD = r"trim(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
# every name is a row of its document, so each takes the first equal row after the one that the name before it took
query("ordered_fuzzy_match", r"""WITH RECURSIVE lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS row_no, line FROM (SELECT doc_id, pos, trim(regexp_replace(l, '[ 	

]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE line <> ''),
f AS (SELECT doc_id, row_no, """ + _FOLD.format("line") + r""" AS key FROM lines), keyed AS (SELECT * FROM f WHERE key <> ''),
names AS (SELECT doc_id, row_no AS item_index, key, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS k FROM keyed WHERE row_no % 3 = 1),
step AS (
  SELECT doc_id, k, item_index, (SELECT min(row_no) FROM keyed r WHERE r.doc_id = names.doc_id AND r.key = names.key) AS row_no FROM names WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, n.item_index, (SELECT min(r.row_no) FROM keyed r WHERE r.doc_id = n.doc_id AND r.key = n.key AND r.row_no > s.row_no) AS row_no FROM step s JOIN names n ON n.doc_id = s.doc_id AND n.k = s.k + 1
) SELECT doc_id, item_index, row_no, 1.0::DOUBLE AS ratio, 'exact' AS method FROM step""")(_matches)
query("sequence_ratio")(lambda s, d: FL.similarity(read(s, d, "part").select("p_partkey", "p_name").withColumn("other", F.lit("red bolt")), "p_name", "other"))
#: Queries of planners and whether each is accepted.
GUARD_CASES = [
    ("SELECT COUNT(*) AS n FROM analytics_receipts LIMIT 1", True), ("DELETE FROM analytics_receipts", False), ("SELECT * FROM receipts LIMIT 1", False), ("SELECT * FROM analytics_receipts; SELECT 1", False), ("SELECT * FROM analytics_receipts -- x", False),
    ("SELECT random() AS v FROM analytics_receipts LIMIT 1", False), ("SELECT * FROM analytics_receipts", False), ("SELECT a.* FROM analytics_receipts a, receipts b LIMIT 1", False), ("SELECT 1 AS x LIMIT 1", False),
    ("SELECT receipt_id FROM analytics_receipts WHERE receipt_id < 0 UNION ALL TABLE secret_ids LIMIT 100", False),
    ("SELECT a.x FROM (WITH receipts AS (SELECT 1 AS x FROM analytics_receipts) SELECT x FROM receipts) a JOIN receipts b ON 1 = 1 LIMIT 1", False),
    ("WITH r AS (SELECT * FROM analytics_receipts) SELECT merchant FROM r LIMIT 5", True), ("WITH r AS (SELECT * FROM r2), r2 AS (SELECT * FROM analytics_receipts) SELECT merchant FROM r LIMIT 5", False),
    ("SELECT merchant FROM analytics_receipts WHERE EXISTS (SELECT 1 FROM receipt_items) LIMIT 5", False), ("SELECT merchant FROM analytics_receipts WHERE receipt_id IN (SELECT receipt_id FROM analytics_purchase_items) LIMIT 5", True),
    ("SELECT (SELECT max(id) FROM sqlite_master) AS v FROM analytics_receipts LIMIT 1", False), ("SELECT * FROM range(3), analytics_receipts LIMIT 1", False), ("SELECT merchant FROM analytics_receipts LIMIT 101", False),
    ("SELECT CASE WHEN grand_total > 1 THEN 1 ELSE 0 END AS v FROM analytics_receipts LIMIT 1", True), ("SELECT merchant AS brand FROM analytics_receipts LIMIT 1", False), ("SELECT merchant::text FROM analytics_receipts LIMIT 1", False),
    ("SELECT row_number() OVER (ORDER BY merchant) AS v FROM analytics_receipts LIMIT 1", False), ("WITH RECURSIVE a AS (SELECT 1 FROM analytics_receipts) SELECT * FROM a LIMIT 1", False),
    ("SELECT merchant FROM analytics_receipts UNION SELECT merchant FROM analytics_purchase_items LIMIT 9", True), ("SELECT merchant, SUM(grand_total) AS v FROM analytics_receipts GROUP BY merchant HAVING SUM(grand_total) > 5 LIMIT 9", True),
    ("SELECT merchant FROM analytics_receipts WHERE (merchant = 'a' OR merchant = 'b') AND NOT (grand_total > 3) LIMIT 9", True), ("SELECT a.merchant FROM analytics_receipts a LEFT JOIN analytics_purchase_items b ON (a.receipt_id = b.receipt_id) LIMIT 9", True),
    ("SELECT strftime('%Y', receipt_date) AS y FROM analytics_receipts LIMIT 9", True), ("SELECT strftime('%Q', receipt_date) AS y FROM analytics_receipts LIMIT 9", False), ("SELECT input_file_name() AS f FROM analytics_receipts LIMIT 1", False),
    ("SELECT merchant FROM parquet.`/tmp/x`, analytics_receipts LIMIT 1", False), ("SELECT merchant FROM main.analytics_receipts LIMIT 1", False), ("SELECT x FROM analytics_receipts LATERAL VIEW explode(array(1)) t AS x LIMIT 1", False), ("SELECT drop FROM analytics_receipts LIMIT 1", False),
    ("INSERT INTO analytics_receipts SELECT * FROM analytics_receipts", False), ("SELECT merchant FROM analytics_receipts WHERE merchant = ? LIMIT 1", False), ("SELECT merchant FROM analytics_receipts WHERE merchant = :m LIMIT 1", False), ("SELECT (merchant FROM analytics_receipts LIMIT 1", False),
]


def _guard_decisions(s) -> DataFrame:
    out = []
    for sql, _ in GUARD_CASES:
        try:
            G.validate(G.Plan(sql))
            out.append((sql, True))
        except G.GuardError:
            out.append((sql, False))
    return s.createDataFrame(out, "sql string, accepted boolean")


query("guard_decisions", "SELECT * FROM (VALUES " + ", ".join("('" + sql.replace("'", "''") + f"', {str(ok).lower()})" for sql, ok in GUARD_CASES) + ") c(sql, accepted)")(lambda s, d: _guard_decisions(s))
query("approval_predicate", "SELECT receipt_id FROM receipts WHERE lower(review_status) IN ('approved', 'accepted', 'complete', 'completed')", True)(lambda s, d: star_receipts(s, d).where(approved(F.col("review_status"))).select("receipt_id"))


# Records and answers


def _json(s, d):
    """Orders as JSON of two generations: a wrapped total or a plain one, a new key (null for some) or an old one."""
    k, t = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    total = F.when(k % 2 == 0, F.concat(F.lit('{"grand_total": '), t, F.lit(', "currency": "EUR"}'))).otherwise(t)
    day = F.when(k % 3 == 0, ', "issued": null, "date": "1999-01-01"').when(k % 3 == 1, ', "issued": "2001-02-03"').otherwise(', "date": "1999-01-01"')
    return read(s, d, "orders").select("o_orderkey", F.parse_json(F.concat(F.lit('{"total": '), total, day, F.lit("}"))).alias("v"))


query("two_generation_json", "SELECT o_orderkey, o_totalprice AS total, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2001-02-03' ELSE '1999-01-01' END AS day FROM orders")(
    lambda s, d: _json(s, d).select("o_orderkey", RC.variant_number(F.try_variant_get("v", "$.total", "variant"), "grand_total").alias("total"), RC.either(F.col("v"), "$.issued", "$.date", "string").alias("day")))
query("item_contract", "SELECT l_orderkey AS record_id, code, level, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'MISSING_PRICE' END AS code, 'warning' AS level FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_quantity < 3 THEN 'UNIT_WITHOUT_QUANTITY' END, 'warning' FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber <> 7 AND l_tax = 0.08 THEN 'NEGATIVE_PRICE' END, 'error' FROM lineitem) WHERE code IS NOT NULL GROUP BY ALL")(
    lambda s, d: RC.item_contract(read(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("item_index"), F.lit("x").alias("name"), F.when(F.col("l_quantity") >= 3, F.col("l_quantity")).alias("quantity"), F.lit("kg").alias("unit"), F.when(F.col("l_linenumber") != 7, F.when(F.col("l_tax") == 0.08, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))).alias("price"))).groupBy("record_id", "code", "level").agg(F.count("*").alias("n")))
query("assemble_answers", "SELECT conv_id AS record_id, arg_max(text, turn) FILTER (role = 'user') AS user, arg_max(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY 1")(
    lambda s, d: RC.assemble(read(s, d, "conversations").select(F.col("conv_id").alias("record_id"), F.col("role").alias("task"), F.col("text").alias("value"), F.col("turn").alias("seq")), ["user", "assistant"]))
query("vat_line_checks", "WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS n, sum(CAST(round(CAST(l_extendedprice * 19 / 100 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey AS record_id, CASE WHEN v IS NOT NULL THEN true END AS rates, CASE WHEN v IS NOT NULL THEN o_orderkey % 5 <> 0 END AS sum FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")(lambda s, d: _vat(s, d))


def _vat(s, d) -> DataFrame:
    lines = read(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit(19.0).alias("rate"), F.col("l_extendedprice").alias("net"), F.round((F.col("l_extendedprice") * 19 / 100).cast("decimal(18,6)"), 2).cast("double").alias("vat"))
    sums = lines.groupBy("record_id").agg(F.sum(F.col("vat").cast("decimal(18,2)")).alias("v"))
    records = read(s, d, "orders").join(sums, F.col("o_orderkey") == F.col("record_id"), "left").select(F.col("o_orderkey").alias("record_id"), (F.col("v").cast("double") + F.when(F.col("o_orderkey") % 5 == 0, 1.0).otherwise(0.0)).alias("vat"), F.col("o_totalprice").alias("total"))
    return RC.vat_checks(lines, records).select("record_id", "rates", "sum")


query("semantic_or_metadata_change", "SELECT p_partkey AS record_id, CASE WHEN p_partkey % 10 = 0 THEN 'removed' WHEN p_partkey % 4 = 1 THEN 'semantic' WHEN p_partkey % 3 = 0 THEN 'metadata' ELSE 'same' END AS change FROM part")(lambda s, d: _changes(s, d))


def _changes(s, d) -> DataFrame:
    old = read(s, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(0).alias("item_index"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    k = F.col("record_id")
    new = old.where(k % 10 != 0).select("record_id", "item_index", F.when(k % 4 == 1, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), F.when(k % 3 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return RC.compare_items(old, new, ["name"], ["price"]).select("record_id", "change")


query("number_format_de", "SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.') || ' EUR' AS written FROM orders")(lambda s, d: read(s, d, "orders").select("o_orderkey", AN.written_money(F.col("o_totalprice"), F.lit("EUR"), "de").alias("written")))
query("candidate_records", "SELECT printf('c%03d', row_number() OVER (ORDER BY p_partkey)) AS candidate_id, p_name AS description, [p_partkey] AS item_ids, 1 AS occurrences FROM (SELECT * FROM part WHERE length(p_name) >= 3 ORDER BY p_partkey LIMIT 12)")(lambda s, d: AN.candidates(read(s, d, "part").select(F.col("p_partkey").alias("rank"), F.col("p_name").alias("description"), F.array("p_partkey", "p_partkey").alias("item_ids"))))
query("decision_coverage", "SELECT 'c' || p_partkey AS candidate_id, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'duplicate' END AS fault FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 UNION ALL SELECT 'z1', 'unknown'")(lambda s, d: _coverage(s, d))


def _coverage(s, d) -> DataFrame:
    k = F.col("p_partkey")
    shown = read(s, d, "part").select(F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), k)
    made = shown.where(k % 7 != 0).select("candidate_id", "p_partkey")
    made = made.union(made.where(k % 11 == 0)).select("candidate_id").union(s.createDataFrame([("z1",)], "candidate_id string"))
    return AN.coverage(made, shown)


query("query_stage_summary", "SELECT user_id AS query_id, count(*) FILTER (n > 0 AND event_type = 'view') AS validations, count(*) FILTER (event_type = 'error') AS repairs, sum(n)::BIGINT AS stages FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: AN.query_events(read(s, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") == "view", "validate_sql_attempt_1").when(F.col("event_type") == "error", "repair_sql_attempt_1").otherwise(F.col("event_type")).alias("name"), F.col("value").alias("duration_ms"))).select("query_id", "validations", "repairs", "stages"))
query("prefix_search", "SELECT p_partkey AS doc_id, count(DISTINCT t) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), (VALUES ('re'), ('bo')) q(t) WHERE starts_with(w, t) GROUP BY 1")(lambda s, d: AN.prefix_matches(R.postings(read(s, d, "part"), "p_partkey", "p_name"), AN.prefix_terms("re Bo x")))
query("approval_blockers", "SELECT o_orderkey AS record_id, len(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' END, CASE WHEN o_orderkey % 7 = 0 THEN 'c' END], lambda x: x IS NOT NULL))::INT AS n FROM orders")(
    lambda s, d: RC.blockers(read(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise("m").alias("merchant_name"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("grand_total"), F.lit(1).alias("n_items"), F.array(F.when(F.col("o_orderkey") % 7 == 0, "critical").otherwise("low")).alias("severities"), F.array(F.lit("ITEM_SUM")).alias("codes"))).select("record_id", F.size("blocking").alias("n")))


# Enrichment and patches

_ALIASES = {"jewellery": ["Ring"], "hardware": ["bolt", "gear"]}
query("infer_categories", "SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'a,b' ELSE concat_ws(',', CASE WHEN p_name LIKE '%ring%' THEN 'jewellery' END, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%gear%' THEN 'hardware' END) END AS categories FROM part")(
    lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(EN.infer_categories(F.col("p_name"), _ALIASES, [(["Widget"], ["a", "b"])]), ",").alias("categories")))
query("valid_category", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'promotion_item' WHEN 'ECONOMY' THEN 'economy_item' ELSE 'unknown' END AS category FROM part")(
    lambda s, d: read(s, d, "part").select("p_partkey", EN.valid_category(F.concat("p_type", F.lit("-Item ")), ["promotion_item", "economy_item"], {"promo_item": "promotion_item"}).alias("category")))
query("item_embedding_text", "SELECT p_partkey, 'Merchant: ' || p_brand || chr(10) || 'Date: unknown' || chr(10) || 'Product item: ' || p_name || chr(10) || 'Raw item: unknown' || chr(10) || 'Normalized item: unknown' || chr(10) || 'Line note: none' || chr(10) || 'Category: ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'unknown' END || chr(10) || 'Semantic description: none' || chr(10) || 'Parser row type: unknown' || chr(10) || 'Original price: unknown' || chr(10) || 'Discount amount: unknown' || chr(10) || 'Tax code: unknown' || chr(10) || 'Aliases: x, y' || chr(10) || 'Price: ' || p_size AS text FROM part")(
    lambda s, d: read(s, d, "part").select("p_partkey", EN.embedding_text({"Merchant": F.col("p_brand"), "Product item": F.col("p_name"), "Category": F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""), "Price": F.col("p_size")}, F.array(F.lit("x"), F.lit("y"))).alias("text")))
query("category_overlay", "SELECT p_partkey AS record_id, 0 AS item_index, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 2 THEN 'old' END AS category_key FROM part")(lambda s, d: _overlay(s, d))
query("category_counts", "SELECT l_orderkey AS record_id, count(*) AS n_items, count(*) FILTER (l_returnflag IN ('A', 'N')) AS categorised, count(*) FILTER (l_quantity > 40) AS to_review FROM lineitem GROUP BY 1")(
    lambda s, d: EN.category_counts(read(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.when(F.col("l_returnflag").isin("A", "N"), "food").otherwise(" Unknown").alias("category_key"), F.when(F.col("l_quantity") > 40, True).alias("review_required"))))
query("search_fallback", "SELECT p_partkey AS doc_id, 0.35::DOUBLE AS score, 'fallback' AS path FROM part WHERE contains(p_name, 'idge') ORDER BY p_partkey LIMIT 25")(lambda s, d: EN.search(read(s, d, "part"), "p_partkey", "p_name", "idge"))
query("alias_seed", "WITH c AS (SELECT lower(r_name) AS alias, r_name AS name FROM region), n AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS alias, min(n_name) AS name FROM nation GROUP BY 1) SELECT * FROM c UNION ALL SELECT * FROM n WHERE alias NOT IN (SELECT alias FROM c)")(
    lambda s, d: EN.seed_aliases(read(s, d, "region").select(F.lower("r_name").alias("alias"), F.col("r_name").alias("name")), read(s, d, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("name"))))
query("supported_discount", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS discount FROM orders")(lambda s, d: _discounts(s, d))
query("final_total_patches", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '/totals/final_purchase_total/final_purchase_total' ELSE '/totals/final_purchase_total' END AS path, o_totalprice AS amount FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0")(lambda s, d: _total_patches(s, d))
query("json_patches", "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 2 THEN 'invalid' WHEN 3 THEN 'unchanged' ELSE 'patched' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 7.5 ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 3 END AS n_items FROM orders")(lambda s, d: _json_patches(s, d))


def _overlay(s, d) -> DataFrame:
    k = F.col("p_partkey")
    items = read(s, d, "part").select(k.alias("record_id"), F.lit(0).alias("item_index"), F.col("p_name").alias("name"), F.lit("old").alias("category_key"))
    new = read(s, d, "part").where(k % 3 != 2).select(k.alias("record_id"), F.lit(0).alias("item_index"), F.lit("other").alias("name"), F.when(k % 3 == 0, F.col("p_type")).alias("category_key"))
    return EN.overlay(items, new, ["category_key"])


def _discounts(s, d) -> DataFrame:
    k, printed = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice")
    line = F.when(k % 3 == 0, F.concat(F.lit("Rabatt gesamt -"), printed)).when(k % 3 == 1, F.concat(F.lit("Summe "), printed)).otherwise("Rabatt gesamt 0,01")
    orders = read(s, d, "orders")
    return EN.supported_discount(orders.select(k.alias("doc_id"), F.col("o_totalprice").alias("discount")), orders.select(k.alias("doc_id"), line.alias("line")), "(?i)rabatt")


def _total_patches(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    orders = read(s, d, "orders")
    answers = orders.select(k.alias("doc_id"), F.when(k % 5 == 0, "missing").otherwise("resolved").alias("status"), F.format_string("EUR %.2f", "o_totalprice").alias("value_text"), F.lit("R0001").alias("label_row"), F.lit("R0002").alias("source_row"))
    records = orders.select(k.alias("doc_id"), (F.col("o_totalprice") + F.when(k % 3 == 0, 1).otherwise(0)).alias("total"), F.lit("EUR").alias("currency"), (k % 2 == 0).alias("wrapped"))
    amount = F.coalesce(F.get_json_object("value", "$.final_purchase_total"), F.col("value")).cast("double")
    return P.total_patches(answers, records).select("doc_id", "path", amount.alias("amount"))


def _json_patches(s, d) -> DataFrame:
    k, orders = F.col("o_orderkey"), read(s, d, "orders")
    docs = orders.select(k.alias("doc_id"), F.concat(F.lit('{"totals": {"final": '), F.col("o_totalprice").cast("string"), F.lit('}, "items": [1, 2, 3]}')).alias("json"))
    patch = orders.where(k % 4 != 3).select(
        k.alias("doc_id"), F.lit(0).alias("patch_no"), F.when(k % 4 == 1, "remove_array_elements").otherwise("replace_value").alias("op"),
        F.when(k % 4 == 0, "/totals/final").when(k % 4 == 1, "/items").otherwise("/totals/other").alias("path"), F.lit(None).cast("int").alias("index"),
        F.when(k % 4 == 1, F.array(F.lit(2), F.lit(0))).alias("indices"), F.lit("7.5").alias("value"), F.lit("printed").alias("reason"))
    done = P.apply_patches(docs, patch, P.Target(P.OPERATIONS, ["/totals/final"], ["/items"]))
    return done.select("doc_id", "status", F.get_json_object("json", "$.totals.final").cast("double").alias("total"), F.size(F.from_json(F.get_json_object("json", "$.items"), "array<int>")).alias("n_items"))

from . import catalog_review  # noqa: E402

catalog_review.add(query, _LEX, _hybrid)
