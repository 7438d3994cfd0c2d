"""Registered queries of the review workflow, lookups, reports, backfills and corrections. Values come from the tables' own columns; each SQL states the rule over again."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import answers as AN
from .operators import backfill as B
from .operators import catalogue as CT
from .operators import categories as C
from .operators import correction as K
from .operators import evidence as E
from .operators import filters as FL
from .operators import index as I
from .operators import lookup as L
from .operators import records as RC
from .operators import reports as RP
from .operators import retrieval as R
from .operators import review as Q
from .operators import telemetry as TM
from .operators import workflow as WF
from .plans.views import read, star_items, star_receipts
from .scratch import Scratch
from .sources import records as S

def _p1():
    return F.substr("o_orderpriority", F.lit(1), F.lit(1))


# Review


def _reviews(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    issue = lambda code, level: F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))
    return read(s, d, "orders").select(
        k.alias("job_id"), F.when(_p1() == "1", "approved").when(_p1() == "2", "rejected").when(_p1() == "3", "needs_review").when(_p1() == "5", " Approved ").alias("requested"), F.when(F.col("o_orderstatus") == "F", "import").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("reject").alias("decision"),
        F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, issue("MISSING_TOTAL", "low")), F.when(k % 5 == 0, issue("SUM", "HIGH")), F.when(k % 3 == 0, issue("VAT", "medium")))).alias("issues"),
    )


_FINAL = """WITH r AS (SELECT o_orderkey AS job_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'approved' WHEN '2' THEN 'rejected' WHEN '5' THEN 'approved' ELSE 'needs_review' END AS asked, CASE o_orderstatus WHEN 'F' THEN 'import' WHEN 'O' THEN 'needs_review' ELSE 'reject' END AS decision,
 CASE WHEN o_totalprice < 50000 THEN 'MISSING_TOTAL' END AS c1, CASE WHEN o_orderkey % 5 = 0 THEN 'SUM' END AS c2 FROM orders), b AS (SELECT *, asked = 'approved' AND (c1 IS NOT NULL OR c2 IS NOT NULL OR decision = 'reject') AS blocked FROM r)
SELECT job_id, CASE WHEN blocked THEN 'needs_review' ELSE asked END AS status, CASE WHEN blocked THEN 'reject' WHEN asked = 'approved' THEN 'import' WHEN asked = 'rejected' THEN 'reject' ELSE 'needs_review' END AS import_decision, blocked, asked = 'approved' AND NOT blocked AND decision <> 'import' AS override,
 asked = 'approved' AND NOT blocked AS import_allowed, concat_ws(',', c1, c2) AS blocking FROM b"""


def _queue_sql() -> str:
    return "queue AS (SELECT 'job-' || o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'needs_review' ELSE 'duplicate_candidate' END AS queue_status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS receipt_id, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders)"


def _queue(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(s, d, "orders").select(F.concat(F.lit("job-"), k.cast("string")).alias("job_id"), F.when(k % 2 == 0, "needs_review").otherwise("duplicate_candidate").alias("queue_status"), F.when(k % 3 == 0, k).alias("receipt_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))


def _changed(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    changes = c.select(F.concat(F.lit("job-"), (k * 30).cast("string")).alias("job_id"), F.when(F.col("c_acctbal") > 5000, "duplicate_confirmed").when(F.col("c_acctbal") > 0, "dismissed_duplicate").otherwise("approved").alias("status"), F.when(k % 4 == 0, k * 10).alias("receipt_id"), F.lit("2031-01-01").alias("at"))
    duplicates = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).select(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id"), F.when(F.col("n") > 2, "candidate").otherwise("dismissed").alias("status"), F.lit(None).cast("string").alias("resolved_at"))
    return WF.change_status(_queue(s, d), duplicates, changes)


_CHANGES = "changes AS (SELECT 'job-' || c_custkey * 30 AS job_id, CASE WHEN c_acctbal > 5000 THEN 'duplicate_confirmed' WHEN c_acctbal > 0 THEN 'dismissed_duplicate' ELSE 'approved' END AS status, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 END AS receipt_id FROM customer)"


def _leases(s, d) -> DataFrame:
    return read(s, d, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("job_id"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("owner_id"), F.col("c_acctbal").alias("expires_at"))


def _claimed(s, d) -> DataFrame:
    asks = read(s, d, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("w"), _p1()).alias("owner_id"), F.col("o_orderkey").cast("double").alias("asked_at"), (F.col("o_orderkey") % 3).cast("double").alias("seconds"))
    return WF.claim(_leases(s, d), asks, 1000.0)


def _pairs(s, d) -> DataFrame:
    return read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id_a"), (-F.col("l_partkey")).alias("id_b")).agg(F.max("l_quantity").alias("score"))


def add(query, LEX: str, hybrid_of) -> None:  # noqa: N803, PLR0915
    """Registers the queries by the catalog's decorator. LEX: the SQL of lexical relevance; hybrid_of: the catalog's hybrid search."""
    query("finalize_review", _FINAL)(lambda s, d: WF.finalize(_reviews(s, d)).select("job_id", "status", "import_decision", "blocked", "override", "import_allowed", F.concat_ws(",", "blocking").alias("blocking")))
    query("finalized_item_status", _FINAL.replace("SELECT job_id, CASE WHEN blocked THEN 'needs_review' ELSE asked END AS status,", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN own <> 'rejected' AND asked = 'approved' AND NOT blocked THEN CASE WHEN own = 'corrected' THEN 'corrected' ELSE 'approved' END WHEN blocked AND own = 'approved' THEN 'needs_review' ELSE own END AS status FROM b JOIN (SELECT *, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'corrected' ELSE 'approved' END AS own FROM lineitem) ON l_orderkey = job_id --").split("--")[0])(
        lambda s, d: read(s, d, "lineitem").join(WF.finalize(_reviews(s, d)), F.col("l_orderkey") == F.col("job_id")).select("l_orderkey", "l_linenumber", "l_partkey", WF.item_status(F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "corrected").otherwise("approved"), F.col("status"), F.col("blocked")).alias("status")))
    query("status_update", f"WITH {_queue_sql()}, {_CHANGES} SELECT q.job_id, coalesce(c.status, q.queue_status) AS queue_status, coalesce(c.receipt_id, q.receipt_id) AS receipt_id, CASE WHEN c.job_id IS NOT NULL THEN '2031-01-01' ELSE q.updated_at END AS updated_at FROM queue q LEFT JOIN changes c USING (job_id)")(lambda s, d: _changed(s, d)[0])
    query("duplicate_resolution", f"""WITH {_queue_sql()}, {_CHANGES}, dup AS (SELECT 'job-' || l_orderkey AS job_id, CASE WHEN max(l_linenumber) > 2 THEN 'candidate' ELSE 'dismissed' END AS status FROM lineitem GROUP BY l_orderkey), c AS (SELECT * FROM changes SEMI JOIN queue USING (job_id))
SELECT d.job_id, CASE WHEN d.status = 'candidate' AND c.status = 'duplicate_confirmed' THEN 'confirmed_duplicate' WHEN d.status = 'candidate' AND c.status = 'dismissed_duplicate' THEN 'dismissed' ELSE d.status END AS status, CASE WHEN d.status = 'candidate' AND c.status IN ('duplicate_confirmed', 'dismissed_duplicate') THEN '2031-01-01' END AS resolved_at FROM dup d LEFT JOIN c ON c.job_id = d.job_id""")(lambda s, d: _changed(s, d)[1])
    query("status_update_unknown", f"WITH {_queue_sql()}, {_CHANGES} SELECT job_id, status FROM changes ANTI JOIN queue USING (job_id)")(lambda s, d: _changed(s, d)[2].select("job_id", "status"))
    query("top_duplicates", "WITH p AS (SELECT l_suppkey AS a, -l_partkey AS b, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), u AS (SELECT a AS record_id, b AS candidate_id, score FROM p UNION ALL SELECT b, a, score FROM p) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, candidate_id) AS INT) AS place FROM u) WHERE place <= 10")(lambda s, d: WF.top_duplicates(_pairs(s, d)))
    query("queue_buckets", f"WITH {_queue_sql()} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (queue_status = '{b}') AS {b}" for b in WF.BUCKETS) + " FROM queue")(lambda s, d: WF.buckets(_queue(s, d), "queue_status"))
    query("queue_first_page", f"WITH {_queue_sql()} SELECT job_id, queue_status FROM queue ORDER BY CASE queue_status WHEN 'possible_duplicate' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, updated_at NULLS FIRST, job_id LIMIT 100")(lambda s, d: Q.queue_order(_queue(s, d).withColumnRenamed("queue_status", "status")).select("job_id", F.col("status").alias("queue_status")))
    query("lease_claims", """WITH live AS (SELECT c_custkey AS job_id, 'w' || c_nationkey AS owner_id, c_acctbal AS expires_at FROM customer WHERE c_custkey % 4 <> 1 AND c_acctbal > 1000), a AS (SELECT o_custkey AS job_id, 'w' || substr(o_orderpriority, 1, 1) AS owner_id, o_orderkey AS t, o_orderkey % 3 AS s FROM orders)
SELECT * FROM live UNION ALL SELECT job_id, arg_min(owner_id, t), 1000.0::DOUBLE + greatest(arg_min(s, t), 1) FROM a ANTI JOIN live USING (job_id) GROUP BY job_id""")(_claimed)
    query("recoverable_jobs", "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1 AND c_acctbal > 1000) ORDER BY created_at, job_id LIMIT 16")(
        lambda s, d: WF.recoverable(read(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")), _leases(s, d), 1000.0, 16).select("job_id", "created_at"))
    query("batch_failures", "SELECT user_id AS batch_id, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")(lambda s, d: WF.batch_failures(read(s, d, "events").select(F.col("user_id").alias("batch_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))))

    # Lookups

    _found = "FROM items i JOIN receipts r USING (receipt_id) WHERE coalesce(item_type, 'item') IN ('item', 'product', 'purchase_item', 'purchased_product') AND item_status NOT IN ('rejected', 'needs_review') AND lower(coalesce(review_status, '')) IN ('approved', 'accepted', 'complete', 'completed')"
    query("structured_filter", f"SELECT receipt_id, item_id, item_index, merchant_name, receipt_date {_found} AND (lower(coalesce(merchant_normalized, '')) = 'furniture' OR lower(coalesce(merchant_name, '')) = 'furniture') AND lower(coalesce(category_key, category_group, category, '')) = 'promo' AND receipt_date >= '1995-01-01'", True)(
        lambda s, d: L.structured(star_items(s, d), star_receipts(s, d), " Furniture", "PROMO", date_from="1995-01-01").select("receipt_id", "item_id", "item_index", "merchant_name", "receipt_date"))
    _hit = "hit AS (SELECT p_partkey AS item_id, sum(w * n)::DOUBLE AS score FROM (SELECT p_partkey, 10.0 AS w, len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 'red') OR starts_with(x, 'bo'))) AS n FROM part UNION ALL SELECT p_partkey, 1.0, len(list_filter(string_split(lower(p_type), ' '), lambda x: starts_with(x, 'red') OR starts_with(x, 'bo'))) FROM part) GROUP BY 1 HAVING sum(n) > 0)"
    query("text_items_receipts_join", f", {_hit} SELECT receipt_id, item_index, item_id, score, merchant_name FROM (SELECT receipt_id, i.item_index, i.item_id, merchant_name {_found}) JOIN hit USING (item_id) ORDER BY score DESC, item_id, receipt_id, item_index", True)(_text)
    query("vector_items_receipts_join", f", q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), sim AS (SELECT vec_id AS item_id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS similarity FROM embeddings, q) SELECT item_id, count(*) AS n, floor(max(similarity) * 1e6 + 0.5) / 1e6 AS similarity FROM (SELECT i.item_id {_found}) JOIN sim USING (item_id) GROUP BY 1", True)(_vectors)

    # Reports

    query("query_call_totals", "SELECT user_id AS query_id, count(*) AS call_count, string_agg(DISTINCT p, ',' ORDER BY p) AS providers, floor(sum(CAST(value AS DECIMAL(28,6)))::DOUBLE * 1000 + 0.5) / 1000 AS total_request_duration_ms FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS p FROM events) GROUP BY 1")(
        lambda s, d: RP.call_totals(read(s, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("provider"), F.col("value").alias("request_duration_ms"))).select("query_id", "call_count", F.concat_ws(",", F.map_keys("providers")).alias("providers"), (F.floor(F.col("total_request_duration_ms") * 1000 + 0.5) / 1000).alias("total_request_duration_ms")))
    query("query_provider_counts", "SELECT user_id AS query_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS provider, count(*) AS n FROM events GROUP BY 1, 2")(
        lambda s, d: RP.call_totals(read(s, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("provider"))).select("query_id", F.explode("providers").alias("provider", "n")))
    query("item_totals", "SELECT receipt_id, sum(coalesce(CAST(line_total AS DECIMAL(18,2)), 0))::DOUBLE AS items_total, sum(coalesce(CAST(original_price AS DECIMAL(18,2)), 0))::DOUBLE AS before_discount FROM items GROUP BY 1", True)(lambda s, d: star_items(s, d).groupBy("receipt_id").agg(RP.exact_total(F.col("line_total")).alias("items_total"), RP.exact_total(F.col("original_price")).alias("before_discount")))
    query("queue_search", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', 'job-' || o_orderkey, c_name, nullif(lower(c_mktsegment), ''), strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 2 = 0 THEN 'needs_review' END, CASE WHEN o_totalprice > 100000 THEN 'VAT_SUM' END)), '1996-0')")(
        lambda s, d: RP.queue_search(read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("c_name").alias("merchant_name"), F.lower("c_mktsegment").alias("merchant_normalized"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("receipt_date"), F.when(F.col("o_orderkey") % 2 == 0, "needs_review").alias("queue_status"), F.lit(None).cast("string").alias("decision"), F.array_compact(F.array(F.when(F.col("o_totalprice") > 100000, "VAT_SUM"))).alias("reason_codes")), " 1996-0").select("o_orderkey"))
    query("job_states", "SELECT job_id, min(event_id) AS event_id FROM (SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END, 'f' || lpad(event_id::VARCHAR, 9, '0')) AS job_id FROM events WHERE event_id % 5 <> 0 AND event_type <> 'error' AND (event_type = 'click' OR event_id % 2 = 0)) GROUP BY 1")(_job_states)
    query("job_summary", "SELECT count(*) AS total_jobs, count(*) FILTER (user_id % 3 = 0) AS human_reviewed, count(*) FILTER (user_id % 3 = 0) / count(*) AS review_rate, count(*) FILTER (event_id % 4 > 0) AS jobs_with_issues, floor(sum(CAST(abs(value) AS DECIMAL(18,2)))::DOUBLE / count(value) * 100 + 0.5) / 100 AS avg_abs_difference, max(CAST(abs(value) AS DECIMAL(18,2)))::DOUBLE AS max_abs_difference, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS decisions FROM events")(
        lambda s, d: RP.job_summary(read(s, d, "events").select("event_id", F.col("event_type").alias("decision"), F.col("value").alias("difference"), (F.col("event_id") % 4).alias("issue_count"), F.when(F.col("user_id") % 3 == 0, "approved").alias("review_status"))).select("total_jobs", "human_reviewed", "review_rate", "jobs_with_issues", "avg_abs_difference", "max_abs_difference", F.array_join(F.transform("decisions", lambda x: F.concat(x["decision"], F.lit(":"), x["n"].cast("string"))), ",").alias("decisions")))

    # Backfills

    query("snapshot_backfill", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(CASE WHEN turn % 2 = 0 THEN 'e' END, text) ELSE coalesce(CASE WHEN turn % 2 = 0 THEN 'e' END, NULL) END AS extraction_json, coalesce(CASE WHEN turn % 3 = 0 THEN 'd' END, CASE WHEN role = 'user' THEN text END) AS draft_json, coalesce(CASE WHEN turn % 2 = 0 THEN 'e' END, CASE WHEN role = 'user' THEN text END) AS raw_json FROM conversations")(
        lambda s, d: B.snapshots(read(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("raw_json"), F.when(F.col("turn") % 2 == 0, "e").alias("extraction_json"), F.when(F.col("turn") % 3 == 0, "d").alias("draft_json"))))
    query("item_semantics_backfill", "SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN 'known' END, json_extract_string(props, '$.k')) AS semantic_description FROM events")(
        lambda s, d: B.item_semantics(read(s, d, "events").select("event_id", F.when(F.col("event_type") == "click", "known").alias("semantic_description"), F.regexp_replace("props", '"k"', '"semantic_description"').alias("raw_json"))).select("event_id", "semantic_description"))
    query("price_name_repair", "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'Supplier' ELSE 'supplier' END AS provider, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE replace(upper(s_name), '#', '_') END AS model, s_acctbal AS updated_at FROM supplier")(
        lambda s, d: B.snap_names(read(s, d, "supplier").select(F.lit("supplier").alias("provider"), F.regexp_replace(F.upper("s_name"), "#", "_").alias("model"), F.col("s_acctbal").alias("updated_at")), read(s, d, "supplier").where("s_suppkey % 4 = 0").select(F.lit("Supplier").alias("provider"), F.col("s_name").alias("model"))))
    query("price_checks", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'name' WHEN s_suppkey % 5 = 0 THEN 'currency' WHEN s_suppkey % 3 = 0 THEN 'missing price' WHEN s_acctbal < 0 THEN 'input_price_per_million' END AS fault FROM supplier")(
        lambda s, d: B.checked_prices(read(s, d, "supplier").select("s_suppkey", F.lit("p").alias("provider"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).otherwise(" ").alias("model"), F.when(F.col("s_suppkey") % 5 == 0, "EURO").otherwise("eur").alias("currency"), F.col("s_acctbal").alias(TM.PRICES[0]), F.lit(None).cast("double").alias(TM.PRICES[1]), F.lit(None).cast("double").alias(TM.PRICES[2]), F.when(F.col("s_suppkey") % 3 != 0, 1.0).alias(TM.PRICES[3]))).select("s_suppkey", "fault"))
    query("recalibration_backfill", "SELECT p_partkey AS item_id, p_size / 50.0::DOUBLE AS old, least(p_size / 50.0::DOUBLE, 0.8) AS new FROM part WHERE p_size / 50.0::DOUBLE > 0.8")(_recalibrated)

    # Corrections

    query("vat_patches", """WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS agg, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS net, CASE WHEN l_linenumber <> 5 THEN floor(l_extendedprice * 19 + 0.5) / 100 END AS vat FROM lineitem),
g AS (SELECT l_orderkey, count(DISTINCT CASE WHEN agg THEN CAST(vat AS DECIMAL(18,2)) END) AS vals, min(CASE WHEN agg THEN CAST(vat AS DECIMAL(18,2)) END)::DOUBLE AS v, count(*) FILTER (NOT (agg AND vat IS NOT NULL) AND net IS NOT NULL AND vat IS NOT NULL) AS n, min(CASE WHEN NOT (agg AND vat IS NOT NULL) AND net IS NOT NULL AND vat IS NOT NULL THEN net END) AS first_net,
 count(*) FILTER (NOT (agg AND vat IS NOT NULL) AND NOT coalesce(net IS NOT NULL AND vat IS NOT NULL, false)) AS ignored FROM b GROUP BY 1), s AS (SELECT *, CASE WHEN vals > 1 THEN 'conflicting_aggregates' WHEN n = 0 AND v IS NULL THEN 'no_evidence' ELSE 'patch_built' END AS status FROM g JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey AS record_id, status, CASE WHEN status = 'patch_built' AND n > 0 THEN n END AS lines, CASE WHEN status = 'patch_built' AND n = 1 AND CAST(first_net AS DECIMAL(18,2)) IS DISTINCT FROM CAST(o_totalprice AS DECIMAL(18,2)) THEN first_net END AS new_net, CASE WHEN status = 'patch_built' THEN v END AS new_vat, ignored FROM s""")(_vat)
    query("item_insertions", """WITH m AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber > 2 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS rest, count(*) FILTER (l_linenumber > 2) AS n, sum(CASE WHEN l_linenumber <= 2 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS known FROM lineitem GROUP BY 1)
SELECT l.l_orderkey AS record_id, '/items/' || l_linenumber AS path, l_partkey::VARCHAR AS name, l_extendedprice AS amount FROM lineitem l JOIN m USING (l_orderkey) WHERE l_linenumber > 2 AND n <= 4 AND m.l_orderkey % 2 = 0""")(_inserted)
    query("worst_failed_check", "SELECT o_orderkey AS record_id, CASE WHEN o_totalprice < 60000 THEN 'NONNEGATIVE_AMOUNTS' WHEN o_orderkey % 3 = 0 THEN 'ITEM_SUM_RECONCILIATION' ELSE 'NET_PLUS_VAT' END AS target FROM orders WHERE o_totalprice < 60000 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")(_worst)
    query("correction_rounds", """SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice ELSE o_totalprice + 5 END AS total, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE upper(substr(o_orderpriority, 3, 3)) END AS currency FROM orders""")(_rounds)

    # Filters that the typed fields don't have, sources

    query("filter_operators", "SELECT receipt_id, merchant_normalized <> 'furniture' AS neq, merchant_normalized NOT IN ('furniture', 'building') AS not_in, currency IS NULL AS is_null, currency IS NOT NULL AS not_null, merchant_normalized IN ('furniture', 'household') AS in_list FROM receipts", True)(
        lambda s, d: star_receipts(s, d).select("receipt_id", FL.compare("merchant_normalized", "neq", ["furniture"]).alias("neq"), FL.compare("merchant_normalized", "not_in", ["furniture", "building"]).alias("not_in"), FL.compare("currency", "is_null").alias("is_null"), FL.compare("currency", "not_null").alias("not_null"), FL.compare("merchant_normalized", "in", ["furniture", "household"]).alias("in_list")))
    query("receipt_import", "SELECT 'job-' || c_custkey AS job_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS merchant_name FROM customer UNION ALL SELECT 'job-' || (c_custkey + 1000000), 'new' FROM customer WHERE c_custkey % 2 = 0")(_imported)
    query("receipt_delete", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS receipts, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 3 = 0) AS items")(
        lambda s, d: S.delete_counts(star_receipts(s, d), star_items(s, d), read(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("receipt_id"))))
    query("append_calls_once", "SELECT call_id, recorded_at FROM (SELECT user_id AS call_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS recorded_at FROM events WHERE event_type = 'click' GROUP BY 1) WHERE call_id % 4 <> 0")(_calls_once)
    query("vector_codec", "SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS first FROM embeddings")(lambda s, d: read(s, d, "embeddings").select("vec_id", S.decode_vector(S.encode_vector(F.col("embedding"))).alias("v")).select("vec_id", F.size("v").alias("n"), F.get("v", F.lit(0)).cast("double").alias("first")))
    query("revisions", "SELECT conv_id AS job_id, count(*) AS n FROM (SELECT conv_id, turn FROM conversations WHERE turn < 3 GROUP BY ALL UNION SELECT conv_id, max(turn) + 1 FROM conversations WHERE turn < 3 AND conv_id % 2 = 0 GROUP BY 1) GROUP BY 1")(_revisions)
    query("missing_evidence", "SELECT doc_id, 'R0001' AS row_id FROM documents WHERE NOT coalesce(contains((SELECT trim(regexp_replace(l, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) FROM (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k) WHERE trim(regexp_replace(l, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) <> '' ORDER BY k LIMIT 1), 'the'), false)")(
        lambda s, d: E.missing_evidence(read(s, d, "documents").select("doc_id", F.lit("R0001").alias("row_id"), F.lit("the").alias("literal")), E.canonical_rows(read(s, d, "documents"))).select("doc_id", "row_id"))
    query("category_from_item", """WITH i AS (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 THEN 'Balea ' || p_name WHEN p_size % 7 = 1 THEN 'WC-Reiniger' ELSE p_name END AS name FROM part)
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'personal_care/hygiene' WHEN 1 THEN 'household/cleaning' ELSE CASE WHEN p_size % 3 = 0 THEN 'fashion/unknown' WHEN p_size % 3 = 1 THEN 'fashion/footwear' WHEN p_size % 5 = 0 THEN 'Toys' WHEN p_size % 2 = 0 THEN 'Garden stuff' END END AS category FROM i""")(
        lambda s, d: read(s, d, "part").select("p_partkey", CT.item_category(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Balea "), F.col("p_name"))).when(F.col("p_size") % 7 == 1, "WC-Reiniger").otherwise(F.col("p_name")), [F.lit(""), F.when(F.col("p_size") % 3 == 0, "Clothing-Shoes")], F.when(F.col("p_size") % 3 == 1, "Fashion Footwear").otherwise("Item"), F.when(F.col("p_size") % 5 == 0, "Toys"), F.when(F.col("p_size") % 2 == 0, " Garden stuff").otherwise("discount")).alias("category")))
    query("query_categories", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'personal_care/hygiene,personal_care/shampoo' WHEN 1 THEN 'personal_care/shampoo' WHEN 2 THEN 'baby/baby_products,pharmacy/medicine' ELSE '' END AS categories FROM part")(
        lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(CT.query_categories(F.concat(F.col("p_name"), F.when(F.col("p_size") % 4 == 0, " Körperpflege").when(F.col("p_size") % 4 == 1, " Elvital").when(F.col("p_size") % 4 == 2, " Ibuprofen und WINDELN").otherwise(""))), ",").alias("categories")))
    query("merchant_class", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'fashion_retail' ELSE 'unknown' END AS class FROM customer")(
        lambda s, d: read(s, d, "customer").select("c_custkey", CT.merchant_key(F.when(F.col("c_mktsegment") == "MACHINERY", "Clothing Shoes").otherwise(F.col("c_mktsegment")), ["building", "fashion_retail"]).alias("class")))
    query("described_products", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'It is a ' || p_name || '.' WHEN p_type <> 'PROMO' THEN '„' || p_name || '“ ist als ' || lower(p_type) || ' kategorisiert.' END AS said FROM part")(
        lambda s, d: read(s, d, "part").select("p_partkey", CT.describe("describe_product", F.col("p_name"), F.when(F.col("p_type") == "PROMO", "unknown").otherwise(F.lower("p_type")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("It is a "), F.col("p_name"))), F.lit(""), "de").alias("said")))
    query("brands_in_text", "SELECT p_partkey, concat_ws(',', CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN 'Red' END, CASE WHEN contains(' ' || p_name || ' ', ' bolt ') THEN 'bolt' END) AS brands FROM part")(
        lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(CT.brands(F.col("p_name"), ["Red", "bolt", "red bo"]), ",").alias("brands")))
    query("reason_codes", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING_TOTAL' END, CASE WHEN o_orderkey % 3 = 0 OR o_totalprice > 200000 THEN 'SUM' END, CASE WHEN o_orderkey % 2 = 0 THEN 'VAT' END) AS codes FROM orders")(
        lambda s, d: read(s, d, "orders").select("o_orderkey", F.array_join(Q.reason_codes(F.array_compact(F.array(F.when(F.col("o_orderkey") % 2 == 0, "VAT"), F.when(F.col("o_orderkey") % 3 == 0, "SUM"))), F.when(F.col("o_totalprice") > 200000, F.array(F.lit("SUM"))), F.array_compact(F.array(F.when(F.col("o_orderkey") % 5 == 0, "MISSING_TOTAL")))), ",").alias("codes")))
    query("queue_upsert", "SELECT coalesce(o_custkey, c_custkey) AS job_id, coalesce(c_name, n) AS draft, coalesce(n, c_name) AS extraction FROM (SELECT o_custkey, min(o_orderpriority) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")(_upserted)
    query("review_edits", "SELECT c_custkey AS record_id, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 7.5 ELSE c_acctbal END::DOUBLE AS total, concat_ws(',', CASE WHEN c_custkey % 3 < 2 THEN 'name' END, CASE WHEN c_custkey % 2 = 0 AND c_acctbal <> 7.5 THEN 'total' END) AS changed FROM customer")(_edited)
    query("correction_acceptance", "SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0")(_accepted)
    query("index_refresh", "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'kept' END AS state FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 10 <> 0 OR p_partkey % 5 <> 0")(_refreshed)
    query("model_identities", "SELECT s_suppkey, lower(replace(s_name, '#', '')) AS identity FROM supplier")(lambda s, d: read(s, d, "supplier").select("s_suppkey", AN.identity(F.concat(F.lit(" "), F.upper("s_name"))).alias("identity")))
    query("hybrid_retrieval", LEX.split("SELECT p_partkey, round")[0] + """, lex AS (SELECT p_partkey, round""" + LEX.split("SELECT p_partkey, round")[1] + """), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
c AS (SELECT part.p_partkey AS id, p_name, least(greatest(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), -1), 1) AS sim, lex.score AS lexical FROM part JOIN embeddings ON p_partkey = vec_id JOIN lex ON lex.p_partkey = part.p_partkey, q),
grp AS (SELECT lower(p_name) AS identity, list_sort(list(id)) AS ids, max(sim) AS sim, max(lexical) AS lexical FROM c WHERE sim IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY sim DESC, identity) AS vector_rank, CASE WHEN lexical > 0 THEN row_number() OVER (ORDER BY lexical DESC, sim DESC, identity) END AS lexical_rank FROM grp)
SELECT identity, array_to_string(ids, ',') AS item_ids, vector_rank, lexical_rank, round(1.0::DOUBLE / (60 + vector_rank) + coalesce(1.5::DOUBLE / (60 + lexical_rank), 0), 10) AS fusion FROM ranked ORDER BY 1.0::DOUBLE / (60 + vector_rank) + coalesce(1.5::DOUBLE / (60 + lexical_rank), 0) DESC, lexical DESC, sim DESC, ids[1] LIMIT 20""")(
        lambda s, d: hybrid_of(s, d).select("identity", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"), "vector_rank", "lexical_rank", F.round("fusion", 10).alias("fusion")))
    query("category_coercion", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE lower(p_type) END AS category FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", _coerced().alias("category")))


def _coerced():
    known = ["economy", "standard", "small", "medium", "large", "promo"]
    said = F.when(F.col("p_size") % 3 == 0, "no such key").otherwise(F.concat(F.lit(" "), F.col("p_type")))
    key = F.lower(F.trim(said))
    return F.when(key.isin(known), key).otherwise("unknown")


def _text(s, d) -> DataFrame:
    p = read(s, d, "part")
    words = lambda c, name: p.select(F.col("p_partkey").alias("item_id"), F.explode(F.split(F.lower(c), " ")).alias("term"), F.lit(name).alias("field"))
    postings = words("p_name", "name").union(words("p_type", "category")).groupBy("item_id", "term", "field").agg(F.count("*").alias("tf"))
    return L.text_hits(postings, L.structured(star_items(s, d), star_receipts(s, d)), "Red bo", {"name": 10.0, "category": 1.0}, None).select("receipt_id", "item_index", "item_id", "score", "merchant_name")


def _vectors(s, d) -> DataFrame:
    v = list(read(s, d, "embeddings").where("vec_id = 0").first()["embedding"])
    found = L.structured(star_items(s, d), star_receipts(s, d))
    sim = R.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v]))
    hits = found.join(read(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), sim.alias("similarity")), "item_id")
    return hits.groupBy("item_id").agg(F.count("*").alias("n"), (F.floor(F.max("similarity") * 1e6 + 0.5).cast("double") / 1e6).alias("similarity"))


def _upserted(s, d) -> DataFrame:
    old = read(s, d, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderpriority").alias("draft")).withColumn("extraction", F.col("draft"))
    new = read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("draft")).withColumn("extraction", F.col("draft"))
    return Q.upsert(old, new, "job_id", ("extraction",))


def _edited(s, d) -> DataFrame:
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    before = c.select(k.alias("record_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("total"))
    edits = c.where(k % 3 < 2).select(k.alias("record_id"), F.lit("name").alias("field"), F.when(k % 3 == 0, "new").alias("value")).union(c.where(k % 2 == 0).select(k, F.lit("total"), F.lit("7.5")))
    after = RC.apply_edits(before, edits, ["name", "total"])
    both = before.select("record_id", F.struct("name", "total").alias("a")).join(after.select("record_id", F.struct("name", "total").alias("b")), "record_id")
    return both.select("record_id", "b.name", "b.total", F.array_join(Q.changed_fields(F.col("a"), F.col("b"), ["name", "total"]), ",").alias("changed"))


def _accepted(s, d) -> DataFrame:
    """The target is solved for every fourth record; every third has another check that fails newly."""
    k = F.col("record_id")
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    checks = lambda a, b: o.select("record_id", F.inline(F.array(F.struct(F.lit("A").alias("code"), F.when(a, "passed").otherwise("failed").alias("status")), F.struct(F.lit("B").alias("code"), F.when(b, "passed").otherwise("failed").alias("status")))))
    return K.accepted(checks(F.lit(False), F.lit(True)), checks(k % 4 == 0, k % 3 != 0), o.withColumn("target", F.lit("A")))


def _refreshed(s, d) -> DataFrame:
    """Texts of every fifth part changed; the embedding of every tenth failed."""
    k = F.col("p_partkey")
    docs = read(s, d, "part").select(k.alias("item_id"), F.when(k % 5 == 0, "new").otherwise("kept").alias("document")).withColumn("content_hash", I.content_hash(F.col("document")))
    vector = F.array(F.lit(1.0)).cast("array<float>")
    old = docs.select("item_id", F.when(F.col("item_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), vector.alias("embedding"))
    done = I.pending(docs, old).select("item_id", "content_hash", F.when(F.col("item_id") % 10 != 0, vector).alias("embedding"), F.when(F.col("item_id") % 10 == 0, "no").alias("error"))
    now = I.refresh(old, docs, done)
    return now.join(docs.select("item_id", F.col("content_hash").alias("h"), "document"), "item_id").where("content_hash = h").select("item_id", F.col("document").alias("state"))


def _job_states(s, d) -> DataFrame:
    e = read(s, d, "events")
    k = F.col("event_id")
    path = F.concat(F.when(k % 5 == 0, "/a/b/").otherwise("/a/"), F.format_string("f%09d/job.json", k))
    jobs = e.select("event_id", path.alias("file_path"), F.when(F.col("event_type") == "error", "batch").when(F.col("event_type") == "click", "single_in_batch").alias("type"), F.when(k % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("job_id"), F.when(k % 2 == 0, "x.png").alias("filename"))
    first = RP.job_states(jobs)
    return first.groupBy("job_id").agg(F.min("event_id").alias("event_id"))


def _recalibrated(s, d) -> DataFrame:
    items = read(s, d, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") / 50.0).alias("stored"), F.lit("organic apple juice").alias("description"), F.lit("drinks").alias("category_key"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("The text says juice").alias("reason"), F.lit("contextual").alias("text_certainty"), F.lit(0).alias("unsupported"), F.lit(False).alias("fallback"))
    return B.recalibrate(items, C.calibrate)[1]


def _vat(s, d) -> DataFrame:
    agg = F.col("l_returnflag") == "R"
    vat = F.when(F.col("l_linenumber") != 5, F.floor(F.col("l_extendedprice") * 19 + 0.5).cast("double") / 100)
    blocks = read(s, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("block_no"), F.lit("R0001").alias("source_row"), F.when(agg, "Summe MwSt").alias("row_label"), F.when(~agg, 19.0).alias("rate"), F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("net"), vat.alias("vat"))
    records = read(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("net"), F.lit(None).cast("double").alias("vat"))
    return K.vat_patches(blocks, records).select("record_id", "status", F.when(F.col("vat_lines").isNotNull(), F.size("vat_lines")).alias("lines"), "new_net", "new_vat", "ignored")


def _inserted(s, d) -> DataFrame:
    li = read(s, d, "lineitem")
    source = li.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("item_index"), F.col("l_partkey").cast("string").alias("name"), F.col("l_extendedprice").alias("amount"))
    exact = F.col("l_extendedprice").cast("decimal(18,2)")
    totals = li.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.sum(F.when(F.col("l_linenumber") <= 2, exact).otherwise(0)).alias("item_sum"), F.sum(exact).alias("all"))
    totals = totals.select("record_id", "item_sum", (F.col("all") + F.when(F.col("record_id") % 2 == 0, 0).otherwise(1)).alias("total"))
    return K.insertions(source, source.where("item_index <= 2").select("record_id", "item_index"), totals)


def _worst(s, d) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.when(bad, "failed").otherwise("passed").alias("status"), F.lit(level).alias("severity")) for c, bad, level in (("NET_PLUS_VAT", F.col("o_orderkey") % 5 == 0, "review"), ("ITEM_SUM_RECONCILIATION", F.col("o_orderkey") % 3 == 0, "review"), ("NONNEGATIVE_AMOUNTS", F.col("o_totalprice") < 60000, "error"))])
    from .operators.validation import RULES

    return K.worst_first(read(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.inline(rows)), RULES)


def _rounds(s, d) -> DataFrame:
    """Totals that are 5 too high are put right from the known net where it is there, currencies by the second strategy of their chain; a strategy that changes nothing is refused."""
    k = F.col("o_orderkey")
    word = F.upper(F.substr("o_orderpriority", F.lit(3), F.lit(3)))
    records = read(s, d, "orders").select(k.alias("record_id"), F.when(k % 3 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 5).alias("total"), F.col("o_totalprice").alias("net"), word.alias("currency"), (k % 3).alias("kind"))

    def check(r: DataFrame) -> DataFrame:
        rules = [("TOTAL", F.abs(F.col("total") - F.col("net")) <= 0.02, "error"), ("CURRENCY", F.col("currency") == "EUR", "review")]
        return r.select("record_id", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.when(ok, "passed").otherwise("failed").alias("status"), F.lit(level).alias("severity")) for c, ok, level in rules])))

    def total(r: DataFrame) -> DataFrame:
        return r.withColumn("total", F.when(F.col("kind") == 2, F.col("net")).otherwise(F.col("total")))

    def currency(r: DataFrame) -> DataFrame:
        return r.withColumn("currency", F.when(F.col("record_id") % 2 == 0, "EUR").otherwise(F.col("currency")))

    fixed = K.correct(records, check, {"TOTAL": [total], "CURRENCY": [lambda r: r, currency]}, Scratch(s, "rounds").cut, ["TOTAL", "CURRENCY"])
    return fixed.select("record_id", "total", "currency")


def _imported(s, d) -> DataFrame:
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    doc = lambda job, name: F.from_json(F.to_json(F.struct(job.alias("job_id"), F.struct(name.alias("name")).alias("merchant"), F.array(F.struct(F.lit("milk").alias("description"))).alias("items"))), S.RECEIPT)
    job = lambda n: F.concat(F.lit("job-"), n.cast("string"))
    old = S.flatten(c.select(doc(job(k), F.col("c_name")).alias("r")).select("r.*"))
    new = c.where(k % 2 == 0).select(F.explode(F.array(doc(job(k), F.lit("new")), doc(job(k + 1000000), F.lit("new")))).alias("r")).select("r.*")
    return S.import_receipts(*old, new)[0].select("job_id", "merchant_name")


def _calls_once(s, d) -> DataFrame:
    e = read(s, d, "events")
    calls = e.select(F.col("user_id").alias("call_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("recorded_at"), F.when(F.col("event_type") == "click", "model.call.completed").otherwise("other").alias("event_name"))
    log = e.where("user_id % 4 = 0").select(F.col("user_id").alias("call_id"))
    return S.append_once(log, calls.where("event_name = 'model.call.completed'"), order="recorded_at").select("call_id", "recorded_at")


def _revisions(s, d) -> DataFrame:
    c = read(s, d, "conversations").where("turn < 3").select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("revision")).distinct().withColumn("draft", F.lit("x"))
    last = c.groupBy("job_id").agg(F.max("revision").alias("base_revision"))
    edits = last.where("job_id % 2 = 0").select("job_id", "base_revision", F.lit("y").alias("draft")).union(last.where("job_id % 2 = 1").select("job_id", F.col("base_revision") - 1, F.lit("late")))
    return Q.add_revisions(c, edits)[0].groupBy("job_id").agg(F.count("*").alias("n"))
