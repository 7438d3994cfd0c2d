"""Golden cases of the engine's operators."""
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money as M
from tallyforge.functions import text as T
from tallyforge.operators import categories as C
from tallyforge.operators import duplicates as D
from tallyforge.operators import evidence as E
from tallyforge.operators import filters as FL
from tallyforge.operators import guard as G
from tallyforge.operators import index as I
from tallyforge.operators import retrieval as R
from tallyforge.operators import review as Q
from tallyforge.operators import telemetry as TM
from tallyforge.operators import validation as V
from tallyforge.plans.views import items_view, receipts_view
from tallyforge.sources import records as S


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for n, v in zip(names, values, strict=True))).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.fixture(scope="module")
def receipts(spark):
    docs = [
        {"job_id": "t01", "merchant": {"name": "Seebad Kiosk"}, "date": "2031-03-04", "currency": "EUR", "totals": {"grand_total": 6.4}, "human_review": {"status": "approved"}, "items": [{"description": "FENCHELTEE LOSE", "normalized_name": "fencheltee lose", "category_key": "tea", "line_total": 5.15}, {"description": "KERZE", "line_total": 1.25}]},
        {"job_id": "t02", "merchant": {"name": "Nordlicht Markt"}, "date": "2031-03-21", "currency": "EUR", "totals": {"grand_total": 31.5}, "human_review": {"status": "approved"}, "items": [{"description": "HAFER", "line_total": 1.5}, {"description": " ", "line_total": 8.0}, {"description": "STIEFEL", "line_total": 30.0}]},
        {"job_id": "t03", "merchant": {"name": "Nordlicht Markt"}, "date": "2031-04-02", "currency": "EUR", "totals": {"grand_total": 52.25}, "human_review": {"status": "Accepted"}, "items": [{"description": "RADIESCHEN", "line_total": 2.2}, {"description": "KERZE", "line_total": 1.75}]},
        {"job_id": "t04", "merchant": {"name": "Nordlicht Markt"}, "date": "2031-04-02", "currency": "EUR", "totals": {"grand_total": 9.0}, "human_review": {"status": "rejected"}, "items": [{"description": "X", "line_total": 1.0}]},
    ]
    raw = spark.read.schema(S.RECEIPT).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))
    r, i = S.flatten(raw)
    r = r.withColumn("merchant_normalized", F.when(T.merchant_name(F.col("merchant_name")) == "nordlicht markt", "nordlicht")).withColumn("payment_method", F.lit("card"))
    i = i.withColumns({"brand": F.lit(None).cast("string"), "discount_amount": F.lit(0.0)})
    return r.persist(), i.persist()


def run_sql(spark, receipts, sql, parameters=None, **kw):
    r, i = receipts
    return G.run(spark, G.Plan(sql, parameters or {}, kw.pop("shape", "rows")), {"analytics_receipts": receipts_view(r, i), "analytics_purchase_items": items_view(r, i)}, seconds=120, **kw)


def test_query_corpus(spark, receipts):
    run = lambda *a, **k: run_sql(spark, receipts, *a, **k).rows
    assert run("SELECT ROUND(SUM(grand_total), 2) AS value, currency FROM analytics_receipts WHERE merchant = :m AND receipt_month = :d GROUP BY currency LIMIT 10", {"m": "nordlicht", "d": "2031-03"}) == [(31.5, "EUR")]
    assert run("SELECT merchant, SUM(grand_total) AS v FROM analytics_receipts GROUP BY merchant ORDER BY merchant LIMIT 10") == [("Seebad Kiosk", 6.4), ("nordlicht", 83.75)]
    assert run("SELECT COUNT(*) AS n FROM analytics_receipts WHERE merchant = :m", {"m": "nordlicht"}, shape="scalar") == [(2,)]
    assert run("SELECT ROUND(SUM(grand_total), 2) AS value FROM analytics_receipts WHERE lower(merchant_name) = :merchant AND receipt_date BETWEEN :a AND :b", {"merchant": "nordlicht markt", "a": "2031-03-01", "b": "2031-03-31"}, shape="scalar") == [(31.5,)]
    assert run("SELECT lower(description), min(line_total) AS p FROM analytics_purchase_items GROUP BY lower(description) ORDER BY p LIMIT 1", shape="row") == [("kerze", 1.25)]
    assert run("SELECT SUM(line_total) AS v FROM analytics_purchase_items WHERE description IN (:a)", {"a": "fencheltee lose"}, shape="scalar") == [(5.15,)]
    assert run("SELECT item_count FROM analytics_receipts WHERE (merchant = 'nordlicht' OR merchant = 'x') AND CASE WHEN grand_total > 40 THEN 1 ELSE 0 END = 0 LIMIT 5") == [(2,)]
    got = run_sql(spark, receipts, "SELECT receipt_id FROM analytics_receipts LIMIT 3", most=2)
    assert len(got.rows) == 2 and got.truncated
    with pytest.raises(G.GuardError, match="more than one"):
        run("SELECT merchant FROM analytics_receipts", shape="scalar")


@pytest.mark.parametrize("sql, why", [
    ("DELETE FROM analytics_receipts", "SELECT or WITH"), ("SELECT * FROM receipts LIMIT 1", "storage object"), ("SELECT 1 FROM analytics_receipts; SELECT 1", "exactly one"), ("SELECT 1 FROM analytics_receipts -- c", "comments"), ("SELECT /* c */ 1 FROM analytics_receipts", "comments"),
    ("SELECT random() FROM analytics_receipts LIMIT 1", "function"), ("SELECT 1 FROM analytics_receipts WHERE merchant = :x LIMIT 1", "parameters"), ("SELECT merchant FROM analytics_receipts", "LIMIT"), ("SELECT merchant FROM analytics_receipts LIMIT 101", "LIMIT"), ("SELECT 1 LIMIT 1", "one of the views"),
    ("SELECT a.merchant FROM analytics_receipts a, receipt_items b LIMIT 1", "storage object"), ("SELECT merchant::text FROM analytics_receipts LIMIT 1", "::"), ("WITH RECURSIVE a AS (SELECT 1 FROM analytics_receipts) SELECT * FROM a LIMIT 1", "recursive"), ("SELECT 1 FROM analytics_receipts WHERE merchant IN (SELECT x FROM sqlite_master) LIMIT 1", "storage object"),
    ("", "characters"), ("SELECT drop FROM analytics_receipts LIMIT 1", "drop"), ("SELECT row_number() OVER (ORDER BY merchant) FROM analytics_receipts LIMIT 1", "function"), ("SELECT merchant FROM analytics_receipts WHERE merchant = ? LIMIT 1", "parameters"),
])
def test_rejected(sql, why):
    with pytest.raises(G.GuardError, match=why):
        G.validate(G.Plan(sql))


def test_strict_and_protected():
    case = "SELECT CASE WHEN grand_total > 1 THEN 1 ELSE 0 END AS v FROM analytics_receipts LIMIT 1"
    G.validate(G.Plan(case))
    with pytest.raises(G.GuardError):
        G.validate(G.Plan(case), strict=True)
    sql = "WITH r AS (SELECT * FROM analytics_receipts) SELECT merchant FROM r WHERE merchant IN (:f1_merchant_0, :f1_merchant_1) LIMIT 5"
    p = {"f1_merchant_0": "a", "f1_merchant_1": "b"}
    f = G.Filter(["merchant"], "in", list(p))
    assert G.validate(G.Plan(sql, p), protected=p, filters=[f]) == sql
    with pytest.raises(G.GuardError, match="protected"):
        G.validate(G.Plan(sql, p | {"f1_merchant_0": "z"}), protected=p)
    with pytest.raises(G.GuardError, match="isn't applied"):
        G.validate(G.Plan(sql, p), filters=[G.Filter(["category"], "in", list(p))])


@pytest.mark.parametrize("sql, ok", [
    ("SELECT receipt_id FROM analytics_receipts WHERE merchant IN (:p) OR 1 = 1 LIMIT 1", False), ("SELECT receipt_id FROM analytics_receipts WHERE merchant IN (:p) AND grand_total > 1 LIMIT 1", True), ("SELECT receipt_id FROM analytics_receipts WHERE :p = lower(merchant) LIMIT 1", True),
    ("SELECT receipt_id FROM analytics_receipts WHERE merchant = :p UNION ALL SELECT receipt_id FROM analytics_receipts LIMIT 1", False), ("SELECT receipt_id FROM (SELECT * FROM analytics_receipts WHERE merchant = :p) t LIMIT 1", True),
    ("SELECT receipt_id, (SELECT count(*) FROM analytics_receipts WHERE merchant = :p) AS n FROM analytics_receipts LIMIT 1", False), ("SELECT a.receipt_id FROM analytics_receipts a LEFT JOIN analytics_receipts b ON (a.receipt_id = b.receipt_id AND b.merchant = :p) LIMIT 1", False),
    ("WITH r AS (SELECT * FROM analytics_receipts WHERE merchant = :p) SELECT receipt_id FROM r LIMIT 1", True), ("SELECT receipt_id FROM analytics_receipts WHERE receipt_id IN (SELECT receipt_id FROM analytics_receipts WHERE merchant = :p) LIMIT 1", True), ("SELECT receipt_id FROM analytics_receipts WHERE NOT merchant = :p LIMIT 1", False),
])
def test_filters_have_to_hold_for_every_row(spark, sql, ok):
    f = G.Filter(["merchant"], "matches", ["p"])
    if ok:
        G.validate(G.Plan(sql, {"p": "a"}), filters=[f])
    else:
        with pytest.raises(G.GuardError, match="isn't applied"):
            G.validate(G.Plan(sql, {"p": "a"}), filters=[f])


def test_views_of_a_query_are_dropped(spark, receipts):
    r, i = receipts
    spark.range(3).createOrReplaceTempView("analytics_receipts")
    run_sql(spark, receipts, "SELECT COUNT(*) AS n FROM analytics_receipts", shape="scalar")
    assert spark.table("analytics_receipts").count() == 3 and not spark.catalog.tableExists("analytics_purchase_items")
    spark.catalog.dropTempView("analytics_receipts")
    with pytest.raises(G.GuardError, match="brand"):
        G.validate(G.Plan("SELECT merchant FROM analytics_receipts LIMIT 1"), question="Which brand do I buy most?")


@pytest.mark.parametrize("expression, want", [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("1 / 0", None), ("8 / 2 * 3", 12), ("CAST('12abc' AS INTEGER)", 12), ("CAST('abc' AS REAL)", 0.0), ("CAST(-3.9 AS INTEGER)", -3), ("MAX(1, NULL)", None), ("MIN(4, 2, 3)", 2), ("'Abc' LIKE 'aB%'", True), ("'abc' GLOB 'A*'", False), ("'a-1' GLOB 'a-[0-9]'", True),
    ("strftime('%d.%m.%Y %H', '2031-03-04 05:06:07')", "04.03.2031 05"), ("date('2031-01-31', '+1 day')", "2031-02-01"), ("date('none')", None), ("julianday('2000-01-01 12:00:00')", 2451545.0), ("upper('straße')", "STRAßE"), ("lower('ÄB')", "Äb"), ("'it''s \\ x'", "it's \\ x"), ("ifnull(NULL, 3)", 3), ("printf('%.2f', 1.5)", "1.50"),
])
def test_dialect(spark, expression, want):
    from tallyforge.operators.dialect import translate

    assert spark.sql(translate(f"SELECT {expression} AS v")).first()["v"] == want


def test_filters():
    catalog = ["REWE", "dm-drogerie markt", "Müller", "Edeka Nord", "Edeka Süd"]
    assert FL.match_catalog("rewe", catalog, "matches") == ["REWE"]
    assert FL.match_catalog("muller", catalog, "equals") == ["Müller"]
    assert FL.match_catalog("edeka", catalog, "equals") == []
    assert FL.resolve(FL.QueryFilter("merchant", "matches", "Edeka"), catalog).status == "needs_clarification"
    assert FL.resolve(FL.QueryFilter("merchant", "contains", "Edeka"), catalog).values == ["Edeka Nord", "Edeka Süd"]
    assert FL.match_catalog("dm drogeri marktt", catalog, "matches") == ["dm-drogerie markt"]
    assert FL.resolve(FL.QueryFilter("merchant", "matches", "zzz"), catalog).status == "not_found"
    assert FL.QueryFilter("amount", "between", [1, 2]).clean == [1.0, 2.0]
    for bad in (("amount", "between", [2, 1]), ("amount", "equals", True), ("receipt_id", "equals", 0), ("purchase_date", "equals", "2026-13-01"), ("product", "in", ["a"])):
        with pytest.raises(ValueError):
            FL.QueryFilter(*bad)


@pytest.mark.parametrize("text, value", [("1.234,56 €", 1234.56), ("1,5", 1.5), ("1,234.56", 1.23456), ("12", 12.0), ("1.5", 1.5), ("x", None), ("EUR 3,10", 3.1), ("", None)])
def test_german_numbers(spark, text, value):
    assert one(spark, T.as_float_de, text) == value


def test_text(spark):
    assert one(spark, T.normalize_text, "Käse & Brot+ Öl  ß!") == "kaese and brot plus oel ss"
    assert one(spark, T.fold_text, "Käse & Brot") == one(spark, FL.fold, "Käse & Brot") == "kase brot"
    assert one(spark, T.merchant_name, "ALDI SÜD 12") == "aldi" and one(spark, T.merchant_name, "Admiral") == "dm" and one(spark, T.merchant_name, " ") is None
    score = lambda q, t: one(spark, lambda c: T.lexical_relevance(q, c), t)
    assert score("Wasser", "MINERALWASSER") > 12 and score("Schuhe", "KRAWATTE") == 0 and score("wasser", "wasser") == 28.0
    assert one(spark, T.trigram_score, "mineral", "minerals") == pytest.approx(2.5 * 5 / 6)
    assert [one(spark, T.is_indexable, x) for x in ("None", "ab", " n/a ", "Brot", None)] == [False, False, False, True, False]
    assert one(spark, M.currency, " euro ") == "EUR" and one(spark, M.currency, "n/a") is None
    assert float(one(spark, M.money, 1.005)) == 1.01
    assert float(one(spark, M.decimal_literal, "Summe 1.234,50 EUR")) == 1234.5 and one(spark, M.decimal_literal, "1,20 2,30") is None


def test_cost(spark):
    calls = spark.createDataFrame([("a", "p", "m", 1000, 250, None, None, 2000.0, "completed"), ("b", "p", "c", 4092, 2812, 2000, 1000, 0.0, "completed"), ("c", "p", "none", 5, 5, None, None, None, "failed"), ("d", "p", "none", 0, 0, None, None, None, "failed")],
        "call_id string, provider string, model string, input_tokens long, output_tokens long, cached_input_tokens long, cache_write_input_tokens long, generation_duration_ms double, status string")
    prices = spark.createDataFrame([("p", "m", "EUR", 2.0, None, None, 8.0), ("p", "c", "EUR", 0.20, 0.02, 0.25, 1.20)], "provider string, model string, currency string, " + ", ".join(f"{p} double" for p in TM.PRICES))
    got = {r["call_id"]: r for r in TM.with_cost(calls, prices).collect()}
    assert got["a"]["estimated_cost"] == pytest.approx(0.004) and got["a"]["tokens_per_second"] == 125.0
    assert got["b"]["standard_input_tokens"] == 1092 and got["b"]["estimated_cost"] == pytest.approx((1092 * 0.20 + 2000 * 0.02 + 1000 * 0.25 + 2812 * 1.20) / 1e6)
    assert got["c"]["estimated_cost"] is None and got["c"]["missing_prices"] == ["standard_input", "output"] and got["d"]["estimated_cost"] == 0


def test_hybrid(spark):
    rows = [(1, "SCHUHENGEL GRAU", [0.8, 0.2]), (2, "KRAWATTE", [1.0, 0.0]), (3, "MINERALWASSER", [0.0, 1.0]), (4, "DENKMIT WC BLAUSPÜLER", [0.98, 0.02]), (5, "KRAWATTE", [1.0, 0.0])]
    c = spark.createDataFrame(rows, "item_id long, description string, embedding array<float>").select("*", T.identity_key(F.col("description"), F.col("item_id")).alias("identity"), F.lit(None).cast("int").alias("fts_rank"))
    assert R.hybrid(c, "Schuhe", [1.0, 0.0]).first()["item_ids"] == [1]
    assert R.hybrid(c, "Wasser", [1.0, 0.0]).first()["item_ids"] == [3]
    assert [2, 5] in [r["item_ids"] for r in R.hybrid(c, "Schuhe", [1.0, 0.0]).collect()]
    assert R.hybrid(c, "Schuhe", [1.0, 0.0], deduplicate=False).count() == 5
    with pytest.raises(ValueError):
        R.hybrid(c, " ", [1.0, 0.0])


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "red bolt"), (2, "red red red"), (3, "blue gear"), (4, None)], "id long, t string")
    got = R.bm25(d, "id", "t", ["red", "bolt"]).collect()
    assert [r["doc_id"] for r in got] == [1, 2]


BASE = dict(record_id=1, total=8.0, pre_discount_total=None, discount_total=None, net=6.72, vat=1.28, vat_rate=19.0, paid=10.0, change=2.0, currencies=["EUR", None])


def validate(spark, record, items):
    r = spark.createDataFrame([tuple(record.values())], "record_id long, total double, pre_discount_total double, discount_total double, net double, vat double, vat_rate double, paid double, change double, currencies array<string>")
    i = spark.createDataFrame(items, "record_id long, name string, final_price double, quantity double, unit string, original_price double, discount_amount double")
    checks = V.check_records(r, V.item_facts(i))
    return {c["code"]: c["status"] for c in checks.collect()}, V.roll_up(checks).first()["status"]


def test_validation(spark):
    items = [(1, "a", 5.0, None, None, None, None), (1, "b", 3.0, None, None, None, None)]
    codes, status = validate(spark, BASE, items)
    assert status == "valid" and codes["ITEM_SUM_RECONCILIATION"] == "passed" and codes["PRE_DISCOUNT_TOTAL"] == "skipped"
    codes, status = validate(spark, BASE, [items[0], (1, "b", None, None, None, None, None)])
    assert status == "review_required" and codes["ITEM_SUM_RECONCILIATION"] == "skipped" and codes["ITEM_PRICES_COMPLETE"] == "failed"
    codes, status = validate(spark, BASE | {"vat": 2.0}, items)
    assert codes["NET_PLUS_VAT"] == codes["VAT_RATE"] == "failed"
    assert validate(spark, BASE | {"total": -8.0}, items)[1] == "invalid"
    assert validate(spark, BASE | {"currencies": ["EUR", "USD"]}, items)[0]["CURRENCY_CONSISTENCY"] == "failed"
    assert validate(spark, BASE, [items[0], items[0]])[0]["REPEATED_IDENTICAL_ITEMS"] == "observed"


def test_noise_and_calibration(spark):
    noise = lambda t: one(spark, C.noise, t)
    assert noise("") == ["empty_description"] and noise("organic apple juice") == []
    assert "code_like_or_numeric_description" in noise("8043.00.549.B.01") and "contains_ocr_marker" in noise("milk # fresh") and "truncated_or_punctuation_ending" in noise("fresh milk,")
    df = spark.createDataFrame([("apple juice", "unknown", 0.99, "It says so", "explicit", 0, False), ("apple juice", "drinks", 0.99, "It says so", "explicit", 0, False)], "description string, category_key string, confidence double, reason string, text_certainty string, unsupported int, fallback boolean")
    a, b = C.calibrate(df).collect()
    assert (a["calibrated"], a["review_required"]) == (0.35, True) and (b["calibrated"], b["review_required"]) == (0.99, False)


def test_duplicates(spark):
    rows = [(1, "h", "rewe", 10.0, "2026-01-01", "10:00", ["a", "b"]), (2, "h", "x", 99.0, None, None, None), (3, None, "rewe", 10.01, "2026-01-01", None, ["a", "b"]), (4, None, "rewe", 10.0, "2026-02-01", None, ["a", "b"]), (5, None, "aldi", 10.0, "2026-01-01", None, ["c"])]
    got = {(r["id_a"], r["id_b"]): r["score"] for r in D.candidate_pairs(spark.createDataFrame(rows, "id long, file_sha256 string, merchant string, grand_total double, receipt_date string, receipt_time string, names array<string>")).collect()}
    assert got == {(1, 2): 100, (1, 3): 95, (1, 4): 75, (3, 4): 75}


def test_index(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, document string").withColumn("content_hash", I.content_hash(F.col("document")))
    index = docs.limit(2).select("item_id", F.when(F.col("item_id") == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding")).union(spark.createDataFrame([(9, "z", [1.0])], "a long, b string, c array<float>"))
    todo = I.pending(docs, index)
    assert sorted(r["item_id"] for r in todo.collect()) == [1, 3] and [r["item_id"] for r in I.stale(index, docs).collect()] == [9]

    def provider(texts):
        if "c" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    done = I.embed(todo.coalesce(1), provider, batch=1)
    assert {r["item_id"]: r["error"] for r in done.collect()} == {1: None, 3: "no"}
    assert sorted(r["item_id"] for r in I.refresh(index, docs, done).collect()) == [1, 2]


def test_review(spark):
    h = spark.createDataFrame([("a", 1, "x")], "job_id string, revision int, draft string")
    edits = spark.createDataFrame([("a", 1, "y"), ("b", 0, "z"), ("a", 0, "late")], "job_id string, base_revision int, draft string")
    new, stale = Q.add_revisions(h, edits)
    assert sorted(tuple(r) for r in new.collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")] and [r["draft"] for r in stale.collect()] == ["late"]
    old, upd = spark.createDataFrame([("a", "1", "first")], "k string, v string, snap string"), spark.createDataFrame([("a", None, "second"), ("b", "2", "s")], "k string, v string, snap string")
    assert sorted(tuple(r) for r in Q.upsert(old, upd, "k", ("snap",)).collect()) == [("a", "1", "first"), ("b", "2", "s")]


def test_matching_prefers_equal_then_extending_then_alike():
    assert E.match_in_order(["milch", "milch"], ["milch", "milch"]) == [(0, 0, 1.0), (1, 1, 1.0)]
    assert [m[3] for m in E.matches(["Bio Milch", "Brot dunkel", "Zwiebeln"], ["BIO MILCH 3,5", "brot dunkel", "Zwiebeln"])] == ["ordered_token_prefix", "exact", "exact"]
    assert E.matches(["kartoffelsalat", "x"], ["kartoffelsalta", "y"])[0][3] == "fuzzy_unique"
    assert E.matches(["tomatenmarks"], ["tomatenmarsk"]) == [] and E.matches(["tomatenmarks"], ["tomatenmarsk"], [True])[0][3] == "missing_price_fuzzy_unique"
    assert E.matches(["apfelsaft klar", "birne"], ["birne", "apfelsaft klar"]) == [(0, 1, 1.0, "exact")]  # rows only go on
    assert E.matches(["kaffee mild a"], ["kaffee mild b", "kaffee mild c"]) == []  # two as much alike
    long_ = [f"position {i} " + "wort " * 40 for i in range(3000)]
    assert len(E.matches(long_, long_)) == 3000


def test_evidence(spark):
    assert E.match_in_order(["milk", "bread"], ["milk 1,20", "milk", "bread"]) == [(0, 1, 1.0), (1, 2, 1.0)]
    rows = E.canonical_rows(spark.createDataFrame([(1, "a  b\n\n c \n"), (2, None)], "doc_id long, text string"))
    assert [tuple(r) for r in rows.orderBy("row_no").collect()] == [(1, 1, "R0001", "a b"), (1, 2, "R0002", "c")]
    claims = spark.createDataFrame([(1, "R0001", "b"), (1, "R0002", "x"), (1, "R0009", "c")], "doc_id long, row_id string, literal string")
    assert sorted(r["row_id"] for r in E.missing_evidence(claims, rows).collect()) == ["R0002", "R0009"]
    boxes = spark.createDataFrame([(1, 1, 10.0, 0.0, 10.0, "b"), (1, 2, 0.0, 1.0, 11.0, "a"), (1, 3, 0.0, 20.0, 30.0, "c")], "image_id long, box_id int, x double, y0 double, y1 double, text string")
    assert [r["text"] for r in E.cluster_lines(boxes).orderBy("line_no").collect()] == ["a b", "c"]
    items = spark.createDataFrame([(1, 0, "milk", 1.0), (1, 1, "bread", 2.0)], "doc_id long, item_index int, name string, price double")
    src = spark.createDataFrame([(1, 1, "milk", 1.5), (1, 2, "bread", 2.0)], "doc_id long, row_no int, line string, amount double")
    patch = E.price_patches(items, src, spark.createDataFrame([(1, 3.5)], "doc_id long, total double")).collect()
    assert [(p["path"], p["old"], p["new"]) for p in patch] == [("/items/0/final_price", 1.0, 1.5)]


def test_sources(spark, tmp_path):
    for folder, name, doc in (("j1", "approved.json", '{"job_id": "a", "currency": "EUR"}'), ("j1", "other_final.json", '{"job_id": "a2"}'), ("j2", "x_final.json", '{"job_id": "b"}'), ("j3", "bad.json", "{")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(doc)
    docs = S.read_json_documents(spark, str(tmp_path), S.RECEIPT)
    assert sorted(r["job_id"] for r in docs.collect()) == ["a", "a2", "b"]
    assert sorted(r["job_id"] for r in S.newest_per_folder(docs, "approved.json").collect()) == ["a", "b"]
    assert S.list_files(spark, str(tmp_path), [".JSON"], 2).count() == 2
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(S.encode_vector(F.col("v")).alias("b"))
    assert [r["v"] for r in v.select(S.decode_vector(F.col("b")).alias("v")).collect()] == [[1.5, -2.0], None]


def test_streams(spark, tmp_path):
    from tallyforge.streaming import events as EV

    src = spark.createDataFrame([("a", "2026-01-01 00:10:00", 1.0), ("a", "2026-01-01 00:10:00", 1.0), ("b", "2026-01-01 00:40:00", 2.0), ("c", "2026-01-01 05:00:00", 3.0)], "call_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = EV.read_events(spark, str(tmp_path / "in"), "call_id string, ts timestamp, value double", "parquet")
    EV.to_table(EV.once_per_call(events), str(tmp_path / "c1"), str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = []
    EV.fan_out(events, str(tmp_path / "c2"), lambda df, b: seen.append(df.count()), lambda df, b: df.write.mode("append").json(str(tmp_path / "json"))).awaitTermination(120)
    assert seen == [4] and spark.read.json(str(tmp_path / "json")).count() == 4
    w = EV.windowed(src.withColumn("g", F.lit("x")), "ts", "g", "value").collect()
    assert sorted((r["n"], r["total"]) for r in w) == [(1, 3.0), (3, 4.0)]
    assert EV.sessions(src, "ts", "call_id").count() == 3
