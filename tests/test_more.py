"""Golden cases of the workflow, reports, lookups, sources and corrections that queries don't show."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import backfill as B
from tallyforge.operators import correction as K
from tallyforge.operators import duplicates as D
from tallyforge.operators import filters as FL
from tallyforge.operators import lookup as L
from tallyforge.operators import reports as RP
from tallyforge.operators import workflow as WF
from tallyforge.operators.ranking import global_rank, nearest_rank
from tallyforge.scratch import Scratch
from tallyforge.sources import records as S


def test_unknown_statuses_are_errors(spark):
    r = spark.createDataFrame([(1, "later", None, [])], "job_id long, requested string, decision string, issues array<struct<code:string,severity:string>>")
    with pytest.raises(Exception, match="unsupported review status"):
        WF.finalize(r).collect()
    blank = spark.createDataFrame([(1, None, None, None), (2, "approved", "llm_failed", []), (3, "approved", "needs_review", [("X", None)])], r.schema)
    got = {x["job_id"]: (x["status"], x["import_decision"], x["override"]) for x in WF.finalize(blank).collect()}
    assert got == {1: ("needs_review", "needs_review", False), 2: ("needs_review", "llm_failed", False), 3: ("approved", "import", True)}


def test_leases(spark):
    leases = spark.createDataFrame([("a", "w1", 10.0), ("b", "w2", 99.0)], "job_id string, owner_id string, expires_at double")
    asks = spark.createDataFrame([("a", "w3", 2.0, 30.0), ("a", "w4", 1.0, 0.0), ("b", "w3", 1.0, 30.0), ("c", "w3", 1.0, 30.0)], "job_id string, owner_id string, asked_at double, seconds double")
    got = sorted(tuple(r) for r in WF.claim(leases, asks, 50.0).collect())
    assert got == [("a", "w4", 51.0), ("b", "w2", 99.0), ("c", "w3", 80.0)]
    assert [r["expires_at"] for r in WF.renew(leases, "w1", 50.0, 0.2).orderBy("job_id").collect()] == [51.0, 99.0]
    assert WF.release(leases, "a", "w2").count() == 2 and WF.release(leases, "a", "w1").count() == 1


def test_reports(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "import", -1.5, 0, "approved"), ("b", None, None, 2, None)], "job_id string, decision string, difference double, issue_count int, review_status string")
    r = RP.job_summary(jobs).first()
    assert (r["total_jobs"], r["human_reviewed"], r["review_rate"], r["jobs_with_issues"], r["max_abs_difference"]) == (2, 1, 0.5, 1, 1.5) and [tuple(x) for x in r["decisions"]] == [("import", 1), ("unknown", 1)]
    assert RP.job_summary(jobs.limit(0)).first()["total_jobs"] == 0
    text = RP.markdown("Report", [("jobs", 2)], ["job", "note"], [("a", "x|y"), ("b", None)])
    assert "- jobs: **2**" in text and "| a | x\\|y |" in text and "| b |  |" in text and "_none_" in RP.markdown("R", [], ["a"], [])
    path = tmp_path / "out" / "report.json"
    RP.write_whole(str(path), {"b": 1, "a": "ä"})
    RP.write_whole(str(path), {"a": 2})
    assert json.loads(path.read_text()) == {"a": 2} and [p.name for p in path.parent.iterdir()] == ["report.json"]
    with pytest.raises(TypeError):
        RP.write_whole(str(path), {"a": object()})
    assert json.loads(path.read_text()) == {"a": 2}
    q = spark.createDataFrame([("q1", "2031-01-02T03:04:05", "x")], "query_id string, asked_at string, answer string")
    RP.log_queries(q, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["day"].isoformat() == "2031-01-02"
    done = spark.createDataFrame([("j", "c", "r", "k", "m", "t")], "job_id string, checks string, record string, categories string, metadata string, trace string")
    RP.write_artifacts(done, str(tmp_path / "art"))
    assert sorted(p.name for p in (tmp_path / "art").iterdir()) == sorted(RP.ARTIFACTS)
    assert RP.queue_search(spark.createDataFrame([("j", "Käse", None, None, None, None, ["VAT"])], "job_id string, merchant_name string, merchant_normalized string, receipt_date string, queue_status string, decision string, reason_codes array<string>"), " vat ").count() == 1


def test_product_resolution(spark):
    items = spark.createDataFrame([(1, "KRAWATTE ROT", [1.0, 0.0]), (2, "krawatte rot", [0.9, 0.1]), (3, "WASSER", [0.0, 1.0])], "item_id long, description string, embedding array<float>")
    items = items.select("*", F.lower("description").alias("identity"), F.lit(None).cast("int").alias("fts_rank"))
    decide = lambda name, rows: {r["candidate_id"]: "selected" if "rot" in r["description"].lower() else "rejected" for r in rows}
    got = L.resolve_products("Krawatte", items, [1.0, 0.0], decide)
    assert got["status"] == "resolved" and got["item_ids"] == [1, 2] and len(got["rejected"]) == 1
    with pytest.raises(ValueError, match="once"):
        L.resolve_products("Krawatte", items, [1.0, 0.0], lambda n, rows: {})
    assert L.resolve_products("Krawatte", items.limit(0), [1.0, 0.0], decide)["status"] == "not_found"
    with pytest.raises(Exception, match="dimensions"):
        L.resolve_products("Krawatte", items, [1.0, 0.0, 0.0], decide)


def test_ranks(spark):
    df = spark.createDataFrame([(i * 37 % 500,) for i in range(500)], "k long").repartition(7)
    assert all(r["k"] == 500 - r["place"] for r in global_rank(df, [F.desc("k")], "place").collect())
    assert global_rank(df.limit(0), [F.desc("k")], "place").count() == 0


def test_nearest_rank(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 5.0, rng.lognormvariate(0, 3)]) if rng.random() > 0.1 else None) for g in ("a", "b", None) for _ in range(700)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["x"] for r in nearest_rank(df.where("g is not null"), ["g"], "v", 0.95, "x").collect()}
    for g in ("a", "b", "one"):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        assert got.pop(g) == vs[math.ceil(len(vs) * 0.95) - 1]
    assert not got
    vs = sorted(v for _, v in rows if v is not None)
    assert nearest_rank(df, [], "v", 0.5, "x").first()["x"] == vs[math.ceil(len(vs) * 0.5) - 1]
    assert nearest_rank(df.limit(0), [], "v", 0.5, "x").first()["x"] is None


def test_prices(spark):
    cols = "provider string, model string, currency string, input_price_per_million double, cached_input_price_per_million double, cache_write_input_price_per_million double, output_price_per_million double"
    rows = [(" p ", "m", "eur", 1.0, None, None, 2.0), ("p", "m", "eur", float("nan"), None, None, 2.0), ("p", "m", "eur", 1.0, -1.0, None, 2.0), ("p", None, "eur", 1.0, None, None, 2.0)]
    got = B.checked_prices(spark.createDataFrame(rows, cols)).collect()
    assert [r["fault"] for r in got] == [None, "input_price_per_million", "cached_input_price_per_million", "name"] and (got[0]["provider"], got[0]["currency"]) == ("p", "EUR")


def test_compare(spark):
    df = spark.createDataFrame([("Ab", 1), (None, 2)], "t string, n int")
    count = lambda *a: df.where(FL.compare(*a)).count()
    assert [count("t", "contains", ["aB"]), count("t", "neq", ["x"]), count("t", "is_null"), count("n", "gte", [2]), count("n", "between", [1, 2]), count("t", "not_in", ["x"])] == [1, 1, 1, 1, 2, 1]
    for bad in (("t", "is_null", [1]), ("t", "in", []), ("t", "near", ["a"])):
        with pytest.raises(ValueError):
            FL.compare(*bad)


def test_reopened_queue(spark):
    q = spark.createDataFrame([("a", 1, "imported"), ("b", 2, "imported"), ("c", None, "rejected")], "job_id string, receipt_id long, queue_status string")
    got = sorted(S.reopen(q, spark.createDataFrame([(1,)], "receipt_id long")).collect())
    assert [tuple(r) for r in got] == [("a", None, "needs_review"), ("b", 2, "imported"), ("c", None, "rejected")]


def test_engine(spark, tmp_path):
    from tallyforge.engine import STAGES, Engine, extract
    from tallyforge.scratch import Scratch

    for job, name, total, status in (("a", "Seebad", 3.0, "approved"), ("b", "Markt", 9.0, "needs_review")):
        (tmp_path / job).mkdir()
        (tmp_path / job / "approved.json").write_text(json.dumps({"job_id": job, "merchant": {"name": name}, "date": "2031-03-04", "currency": "EUR", "totals": {"grand_total": total}, "human_review": {"status": status}, "items": [{"description": "kerze gelb", "line_total": total, "category_key": "light"}]}))
    e = Engine.from_json(spark, str(tmp_path))
    e.receipts, e.items = e.receipts.withColumn("merchant_normalized", F.lower("merchant_name")), e.items.withColumn("brand", F.lit(None).cast("string"))
    assert tuple(e.row_counts().first()) == (2, 2)
    assert e.ask("SELECT SUM(grand_total) AS v FROM analytics_receipts", shape="scalar", seconds=60).rows == [(3.0,)]
    assert e.find_items(merchant="SEEBAD", category="Light").count() == 1 and e.find_items(merchant="Markt").count() == 0
    assert e.search("Kerze").count() == 2 and e.search("kerz").count() == 2  # the second by parts of words
    assert e.aggregate("sum").first()["value"] == 12.0 and e.list_receipts("total_desc", 1).first()["grand_total"] == 9.0
    ids = e.receipts.where("job_id = 'a'").select("receipt_id")
    e.queue = e.receipts.select("job_id", "receipt_id", F.lit("imported").alias("queue_status"), F.lit("2031-01-01").alias("updated_at"))
    left = e.delete(ids)
    assert left.receipts.count() == 1 and sorted(r["queue_status"] for r in left.queue.collect()) == ["imported", "needs_review"]
    assert e.review_queue().count() == 2 and e.queue_buckets().first()["approved"] == 1
    scratch = Scratch(spark, "extract")
    out = extract(spark.range(2), {n: (lambda df, n=n: df.withColumn(n, F.lit(1))) for n in STAGES}, scratch.cut)
    assert out.columns == ["id", *STAGES]
    with pytest.raises(ValueError, match="missing or unknown"):
        extract(spark.range(1), {}, scratch.cut)


def test_rounds_broadcast_no_records(spark):
    """Written ids are small files, but as many as the records."""
    records = spark.range(300).select(F.col("id").alias("record_id"), (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"))
    check = lambda r: r.select("record_id", F.inline(F.array(*[F.struct(F.lit(c.upper()).alias("code"), F.when(F.col(c) == 0, "passed").otherwise("failed").alias("status"), F.lit("error").alias("severity")) for c in "ab"])))
    scratch, plans = Scratch(spark, "rounds"), []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.cut(df)

    fixed = K.correct(records, check, {"A": [lambda r: r.withColumn("a", F.col("a") - 1)], "B": [lambda r: r, lambda r: r.withColumn("b", F.lit(0))]}, cut, ["A", "B"])
    assert {tuple(r) for r in fixed.collect()} == {(i, 2 if i % 3 == 2 else 0, 0) for i in range(300)}
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_pairs_of_copies_meet_no_shuffle(spark):
    """All pairs of a class of equal records, over more than one unit, each once and with the right points; they go from the join to the result."""
    copies = [(i, None, "rewe", 10.0, "2026-01-01", None, ["a", "b", "c"]) for i in range(150)]
    others = [(200, None, "rewe", 10.01, "2026-01-01", "10:00", ["c", "b", "a"]), (201, "h", "", 10.0, "2026-01-01", None, ["a", "b", None]), (202, "h", None, 10.01, None, "10:00", None), (203, None, "aldi", 9.98, "2026-01-01", None, ["a", "b", "c"])]
    rows = copies + others + [(300 + i, None, "rewe", None, "2026-01-01", None, ["x", "y"]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, file_sha256 string, merchant string, grand_total double, receipt_date string, receipt_time string, names array<string>")
    pairs = D.candidate_pairs(df)
    got = [tuple(r) for r in pairs.collect()]
    every = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id"), F.col("b.id"), D.score().alias("score")).where("score >= 70")
    assert sorted(got) == sorted(tuple(r) for r in every.collect()) and len(got) > 150 * 149 / 2
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.index("SortMergeJoin") > plan.rindex("Generate explode(ids") and "Broadcast" not in plan


def test_pairs_of_few_totals_and_names(spark, tmp_path):
    """Records that differ, but in few totals and few names: all pairs and points, few meetings a record, one exchange for both sides of the join."""
    r = random.Random(3)
    sizes = [0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6, 7]
    few = [(i, None, r.choice(["rewe", "aldi", "", None]), r.choice([-0.01, -0.08, -0.09, 0.07, 0.08, 0.09, 5.0, None]), f"2026-01-{r.randrange(28)}", r.choice([None, "", "10:00", "11:00"]), r.sample(range(16), r.choice(sizes))) for i in range(900)]
    # around the number of names from which on one of them makes a key
    many = [(2000 + i, None, "rewe", 7.5, f"2025-{i}", None, r.sample(range(22), r.randrange(12, 22))) for i in range(120)]
    rows = [(*x[:6], [f"name {n}" for n in x[6]]) for x in few + many]
    df = spark.createDataFrame(rows, "id long, file_sha256 string, merchant string, grand_total double, receipt_date string, receipt_time string, names array<string>")
    df.write.parquet(f"{tmp_path}/records")
    df = spark.read.parquet(f"{tmp_path}/records")
    pairs = D.candidate_pairs(df)
    every = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id"), F.col("b.id"), D.score().alias("score")).where("score >= 70")
    want = sorted(tuple(x) for x in every.collect())
    assert sorted(tuple(x) for x in pairs.collect()) == want and sum(a < 2000 for a, _, _ in want) > 60 and sum(a >= 2000 for a, _, _ in want) > 100
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(key" in x and "Reused" not in x]) == 1
    met = D._keyed(D._units(df.where("id < 2000"))).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert met < 0.04 * 900 * 899 / 2, met / (900 * 899 / 2)
