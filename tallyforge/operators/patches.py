"""Correction patches: JSON documents changed at permitted paths by four operations, checked before they take effect."""
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import decimal_literal

# The four operations and the longest reason.
OPERATIONS = ["replace_value", "replace_array_element", "insert_array_element", "remove_array_elements"]
LONGEST_REASON = 240
PATCH = "patch_no int, op string, path string, index int, indices array<int>, value string, reason string"


@dataclass(frozen=True)
class Target:
    """What a patch set may do: which operations, at which value and array paths, how many."""

    operations: list[str]
    value_paths: list[str] = field(default_factory=list)
    array_paths: list[str] = field(default_factory=list)
    most: int = 1


def _step(box, token: str):
    """The key or position of a pointer's token in an object or array."""
    if isinstance(box, dict) and token in box:
        return token
    if isinstance(box, list) and token.isascii() and token.isdecimal() and int(token) < len(box):
        return int(token)
    raise LookupError(f"nothing at {token!r}")


def locate(doc, pointer: str):
    """The object or array that holds what a JSON pointer names, and its key there. LookupError if there is nothing; the root has no holder."""
    if not pointer.startswith("/"):
        raise LookupError("a pointer starts with /")
    *way, last = (t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/"))
    for token in way:
        doc = doc[_step(doc, token)]
    return doc, _step(doc, last)


def _between(n: int | None, end: int) -> int:
    if n is None or not 0 <= n < end:
        raise LookupError(f"position {n} of {end}")
    return int(n)


def _elements(old: list, p: dict, value) -> list:
    """The array after an operation on its elements."""
    if p["op"] == "remove_array_elements":
        gone = [_between(i, len(old)) for i in (p["indices"] if p["indices"] is not None else [])]
        if not gone or len(set(gone)) < len(gone):
            raise LookupError("positions are missing or repeated")
        return [x for i, x in enumerate(old) if i not in gone]
    if p["op"] == "insert_array_element":
        at = len(old) if p["index"] is None else _between(p["index"], len(old) + 1)
        return [*old[:at], value, *old[at:]]
    at = _between(p["index"], len(old))
    return [*old[:at], value, *old[at + 1 :]]


def patched(text: str | None, patches: list[dict], target: Target) -> tuple[str | None, list[str]]:
    """The document after all patches, and the faults found. With any fault the document stays as it is."""
    faults = ["TOO_MANY_PATCHES"] if len(patches) > target.most else []
    try:
        doc = json.loads(text or "")
    except ValueError:
        return text, [*faults, "INVALID_DOCUMENT"]
    for p in patches:
        if p["op"] not in OPERATIONS:
            faults.append("UNSUPPORTED_PATCH_OPERATION")
            continue
        if p["op"] not in target.operations:
            faults.append("OPERATION_NOT_PERMITTED_FOR_TARGET")
        if not (p["reason"] or "").strip() or len(p["reason"]) > LONGEST_REASON:
            faults.append("INVALID_PATCH_REASON")
        try:
            whole = p["op"] == "replace_value"
            if p["path"] not in (target.value_paths if whole else target.array_paths):
                raise LookupError("path not permitted")
            value = None if p["op"] == "remove_array_elements" else json.loads(p["value"] or "")
            box, key = locate(doc, p["path"])
            if not whole and not isinstance(box[key], list):
                raise LookupError("not an array")
            box[key] = value if whole else _elements(box[key], p, value)
        except (LookupError, ValueError):
            faults.append("INVALID_PATCH_OPERATION")
    return (text, faults) if faults else (json.dumps(doc, ensure_ascii=False), faults)


def apply_patches(docs: DataFrame, patches: DataFrame, target: Target) -> DataFrame:
    """docs: doc_id, json; patches: doc_id and PATCH (value is JSON text). Gives doc_id, status (unchanged, patched, invalid), faults, json.

    A document's patches are applied in the order of patch_no, all or none. Documents without patches don't reach Python's JSON parser.
    """
    names = [c.split()[0] for c in PATCH.split(", ")]
    packed = patches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("patches"))
    joined = docs.select("doc_id", "json").join(packed, "doc_id", "left")
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, status string, faults array<string>, json string"

    def run(batches):
        for t in batches:
            got = [patched(j, list(ps), target) for j, ps in zip(t["json"], t["patches"], strict=True)]
            yield pd.DataFrame({"doc_id": t["doc_id"], "status": ["invalid" if f else "patched" for _, f in got], "faults": [f for _, f in got], "json": [j for j, _ in got]})

    plain = joined.where("patches is null").select("doc_id", F.lit("unchanged").alias("status"), F.array().cast("array<string>").alias("faults"), "json")
    # structs in arrays reach pandas as dicts
    return plain.union(joined.where("patches is not null").mapInPandas(run, out))


def total_patches(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Patches that set a record's final total to the amount printed beside its label.

    answers: doc_id, status, value_text, label_row, source_row; records: doc_id, total, currency, wrapped (whether the total is an object). None where
    the answer isn't resolved, holds no single amount or a negative one, or agrees with the total.
    """
    amount = decimal_literal(F.col("value_text"))
    j = answers.where("status = 'resolved'").join(records, "doc_id").withColumn("amount", amount)
    j = j.where((F.col("amount") >= 0) & ~F.col("amount").eqNullSafe(F.col("total").cast("decimal(18,2)")))
    whole = F.to_json(F.struct(F.col("amount").cast("double").alias("final_purchase_total"), "currency"), {"ignoreNullFields": "false"})
    reason = F.concat(F.lit("printed total "), "value_text", F.lit(" at "), F.coalesce("source_row", F.lit("?")), F.lit(", label at "), F.coalesce("label_row", F.lit("?")))
    return j.select(
        "doc_id", F.lit(0).alias("patch_no"), F.lit("replace_value").alias("op"),
        F.when(F.col("wrapped"), "/totals/final_purchase_total/final_purchase_total").otherwise("/totals/final_purchase_total").alias("path"), F.lit(None).cast("int").alias("index"),
        F.lit(None).cast("array<int>").alias("indices"), F.when(F.col("wrapped"), F.col("amount").cast("double").cast("string")).otherwise(whole).alias("value"), F.substring(reason, 1, LONGEST_REASON).alias("reason"),
    )
