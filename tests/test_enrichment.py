"""Patches and enrichment: golden cases."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import enrichment as EN
from tallyforge.operators import patches as P

DOC = json.dumps({"a/b": 1, "items": [{"p": 1.0}, {"p": 2.0}], "m~n": None})


def made(op, path, index=None, indices=None, value=None, reason="seen"):
    return {"patch_no": 0, "op": op, "path": path, "index": index, "indices": indices, "value": value, "reason": reason}


TARGET = P.Target(P.OPERATIONS, ["/a~1b", "/items/1/p", "/m~0n", "/gone"], ["/items", "/a~1b"], most=2)


@pytest.mark.parametrize(
    "patch, want",
    [
        (made("replace_value", "/a~1b", value="[]"), {"a/b": []}), (made("replace_value", "/items/1/p", value="null"), {"items": [{"p": 1.0}, {"p": None}]}), (made("replace_value", "/m~0n", value='"x"'), {"m~n": "x"}),
        (made("insert_array_element", "/items", value="5"), {"items": [{"p": 1.0}, {"p": 2.0}, 5]}), (made("insert_array_element", "/items", 0, value="5"), {"items": [5, {"p": 1.0}, {"p": 2.0}]}),
        (made("insert_array_element", "/items", 2, value="5"), {"items": [{"p": 1.0}, {"p": 2.0}, 5]}), (made("replace_array_element", "/items", 1, value="5"), {"items": [{"p": 1.0}, 5]}),
        (made("remove_array_elements", "/items", indices=[1, 0]), {"items": []}),
    ],
)
def test_patch(patch, want):
    text, faults = P.patched(DOC, [patch], TARGET)
    assert faults == [] and json.loads(text) == json.loads(DOC) | want


@pytest.mark.parametrize(
    "patches, fault",
    [
        ([made("replace_value", "/gone", value="1")], "INVALID_PATCH_OPERATION"), ([made("replace_value", "/items", value="1")], "INVALID_PATCH_OPERATION"), ([made("replace_value", "/a~1b", value="{")], "INVALID_PATCH_OPERATION"),
        ([made("replace_array_element", "/items", 2, value="1")], "INVALID_PATCH_OPERATION"), ([made("replace_array_element", "/items", value="1")], "INVALID_PATCH_OPERATION"), ([made("insert_array_element", "/items", 3, value="1")], "INVALID_PATCH_OPERATION"),
        ([made("insert_array_element", "/a~1b", value="1")], "INVALID_PATCH_OPERATION"), ([made("remove_array_elements", "/items", indices=[])], "INVALID_PATCH_OPERATION"), ([made("remove_array_elements", "/items", indices=[0, 0])], "INVALID_PATCH_OPERATION"),
        ([made("drop_table", "/items")], "UNSUPPORTED_PATCH_OPERATION"), ([made("replace_value", "/a~1b", value="1", reason=" ")], "INVALID_PATCH_REASON"), ([made("replace_value", "/a~1b", value="1", reason="x" * 241)], "INVALID_PATCH_REASON"),
        ([made("replace_value", "/a~1b", value="1")] * 3, "TOO_MANY_PATCHES"),
    ],
)
def test_faulty_patch_changes_nothing(patches, fault):
    assert P.patched(DOC, patches, TARGET) == (DOC, [fault])


def test_not_permitted_and_broken_document():
    assert P.patched(DOC, [made("replace_value", "/a~1b", value="1")], P.Target([], ["/a~1b"]))[1] == ["OPERATION_NOT_PERMITTED_FOR_TARGET"]
    assert P.patched(None, [], TARGET) == (None, ["INVALID_DOCUMENT"])


def test_apply_in_order_all_or_none(spark):
    docs = spark.createDataFrame([(1, DOC), (2, DOC), (3, None), (4, DOC)], "doc_id long, json string")
    rows = [(1, 1, "remove_array_elements", "/items", None, [0], None, "r"), (1, 0, "insert_array_element", "/items", 0, None, "9", "r"), (2, 0, "replace_value", "/a~1b", None, None, "2", "r"), (2, 1, "replace_value", "/gone", None, None, "2", "r")]
    got = {r["doc_id"]: r for r in P.apply_patches(docs, spark.createDataFrame(rows, f"doc_id long, {P.PATCH}"), TARGET).collect()}
    assert json.loads(got[1]["json"])["items"] == [{"p": 1.0}, {"p": 2.0}] and got[1]["status"] == "patched"
    assert (got[2]["status"], got[2]["json"], got[2]["faults"]) == ("invalid", DOC, ["INVALID_PATCH_OPERATION"])
    assert (got[3]["status"], got[3]["json"]) == ("unchanged", None) and got[4]["json"] == DOC


def test_discount_needs_a_printed_label(spark):
    records = spark.createDataFrame([(1, 1234.5), (2, 5.0), (3, 5.0), (4, None)], "doc_id long, discount double")
    rows = spark.createDataFrame([(1, "Rabatt -1.234,50"), (2, "Summe 5,00"), (3, "Rabatt 4,00 5.01"), (4, "Rabatt 1,00"), (9, None)], "doc_id long, line string")
    assert {r[0]: r[1] for r in EN.supported_discount(records, rows, "(?i)rabatt").collect()} == {1: 1234.5, 2: None, 3: 5.0, 4: None}


def test_categories_and_codes(spark):
    df = spark.createDataFrame([("Haar Shampoo & Seife", " eur "), ("nothing", "EURO"), (None, None)], "q string, c string")
    got = df.select(EN.infer_categories(F.col("q"), {"hair": ["shampoo"], "soap": ["seife"], "food": ["brot"]}).alias("k"), EN.currency_code(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(["hair", "soap"], "EUR"), ([], None), ([], None)]


def test_search_falls_back_only_without_hits(spark):
    docs = spark.createDataFrame([(1, "red bolt"), (2, "redbolt")], "id long, t string")
    full, part = EN.search(docs, "id", "t", "red").collect(), EN.search(docs, "id", "t", "edb").collect()
    assert [(r["doc_id"], r["path"]) for r in full] == [(1, "full_text")] and [(r["doc_id"], r["score"], r["path"]) for r in part] == [(2, 0.35, "fallback")]


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r["path"][-5:]: (r["size"], r["sha256"]) for r in EN.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (3, hashlib.sha256(b"abc").hexdigest())}  # the empty file has no row
