"""Source evidence: numbered rows, ordered matching of rows to items, line clustering, and correction patches."""
from bisect import bisect_right
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import fold_value

# Bounds of a correction; least ratio of a name, where the item has no price, and by how much the best must lead.
MOST_REPLACED, MOST_INSERTED, LEAST_COVERED, NAME_SCORE, UNPRICED_SCORE, NAME_MARGIN = 8, 4, 0.60, 0.92, 0.88, 0.08


def canonical_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that aren't blank, spaces collapsed, numbered R0001 and on: doc_id, row_no, row_id, line."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(lines).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).alias("row_no"), F.format_string("R%04d", F.col("at") + 1).alias("row_id"), "line")


def row_reference(c):
    """R0001 out of `R0001 :: text`; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\A\s*(R\d{4,})", 1), F.lit(""))


def missing_evidence(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """claims: doc_id, row_id, literal. Those whose row doesn't exist or doesn't contain the literal."""
    found = claims.join(rows, ["doc_id", "row_id"], "left")
    return found.where(F.col("line").isNull() | ~F.contains("line", "literal")).select("doc_id", "row_id", "literal")


def _counts(names: list[str]) -> np.ndarray:
    """How often each of a-z, 0-9 and space is in each name."""
    out = np.zeros((len(names), 37), "i4")
    for i, n in enumerate(names):
        b = np.frombuffer(n.encode("ascii", "replace"), "u1")
        at = np.where(b >= 97, b - 97, np.where(b >= 48, b - 22, 36))
        out[i] = np.bincount(at, minlength=37)[:37]
    return out


def _extends(a: str, b: str) -> bool:
    """Whether the shorter name's words, two or more, begin the longer one's, which has at most two more."""
    x, y = sorted((a.split(), b.split()), key=len)
    return len(x) >= 2 and len(y) - len(x) <= 2 and y[: len(x)] == x


def matches(names: list[str], rows: list[str], unpriced: list[bool] | None = None) -> list[tuple[int, int, float, str]]:
    """(name, row, ratio, method): one to one, rows rising with names. Each name in turn takes, among the rows after the last one taken, the first equal one; else the only one whose words
    extend its words or the other way round; else the one most alike, if its ratio is high enough (lower where `unpriced` says that the row has no price) and leads the next by the margin.

    Names are compared without case, marks and punctuation. Rows that can't come near the least ratio by their letters are never compared in full, and equal
    and extending rows are found by keys, so a long document costs little more than its own length for each name that has neither.
    """
    names, rows = [fold_value(n) for n in names], [fold_value(r) for r in rows]
    equal: dict[str, list[int]] = {}
    begin: dict[tuple, list[int]] = {}
    for j, r in enumerate(rows):
        equal.setdefault(r, []).append(j)
        begin.setdefault(tuple(r.split()[:2]), []).append(j)
    letters, size = _counts(rows), np.array([len(r) for r in rows])
    out, last = [], -1
    for i, (name, own) in enumerate(zip(names, _counts(names), strict=True)):
        if not name:
            continue
        found = equal.get(name, [])
        k = bisect_right(found, last)
        if k < len(found):
            last = found[k]
            out.append((i, last, 1.0, "exact"))
            continue
        found = begin.get(tuple(name.split()[:2]), [])
        near = [j for j in found[bisect_right(found, last) :] if _extends(name, rows[j])]
        if len(near) == 1:
            last = near[0]
            out.append((i, last, SequenceMatcher(None, name, rows[last]).ratio(), "ordered_token_prefix"))
            continue
        # no ratio is above what the common letters allow; only rows within the margin of the least score matter
        bound = 2.0 * np.minimum(letters[last + 1 :], own).sum(1) / np.maximum(size[last + 1 :] + len(name), 1)
        best, second, at = 0.0, 0.0, -1
        for j in np.flatnonzero((bound >= UNPRICED_SCORE - NAME_MARGIN) & (size[last + 1 :] > 0)) + last + 1:
            r = SequenceMatcher(None, name, rows[j]).ratio()
            if r >= best:  # of equal ones the last; they don't lead anyway
                best, second, at = r, best, int(j)
            elif r > second:
                second = r
        loose = at >= 0 and unpriced is not None and unpriced[at]
        if at >= 0 and best >= (UNPRICED_SCORE if loose else NAME_SCORE) and best - second >= NAME_MARGIN:
            last = at
            out.append((i, at, best, "missing_price_fuzzy_unique" if loose else "fuzzy_unique"))
    return out


def match_in_order(names: list[str], rows: list[str], unpriced: list[bool] | None = None) -> list[tuple[int, int, float]]:
    """`matches` without the methods."""
    return [m[:3] for m in matches(names, rows, unpriced)]


def match_items(items: DataFrame, rows: DataFrame) -> DataFrame:
    """items: doc_id, item_index, name; rows: doc_id, row_no, line, and unpriced (boolean) if known. doc_id, item_index, row_no, ratio, method. A record's rows are one group: records are small, however many there are."""
    if "unpriced" not in rows.columns:
        rows = rows.withColumn("unpriced", F.lit(False))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("item_index"), right.sort_values("row_no")
        got = matches(left["name"].fillna("").tolist(), right["line"].fillna("").tolist(), right["unpriced"].fillna(False).tolist())
        return pd.DataFrame({
            "doc_id": [left["doc_id"].iloc[0]] * len(got) if len(left) else [], "item_index": [left["item_index"].iloc[g[0]] for g in got], "row_no": [right["row_no"].iloc[g[1]] for g in got], "ratio": [g[2] for g in got], "method": [g[3] for g in got],
        })

    return items.groupBy("doc_id").cogroup(rows.groupBy("doc_id")).applyInPandas(run, "doc_id long, item_index int, row_no int, ratio double, method string")


def cluster_lines(boxes: DataFrame, overlap: float = 0.5, look_back: int = 4) -> DataFrame:
    """boxes: image_id, box_id, x, y0, y1, text. Boxes become lines: from top to bottom, a box joins the one of the last `look_back` lines that it overlaps most in height, if by half of the lower height."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict] = []
        for b in t.sort_values(["y0", "x", "box_id"]).itertuples():
            best, share = None, overlap
            for line in lines[-look_back:]:
                both = min(b.y1, line["y1"]) - max(b.y0, line["y0"])
                part = both / max(1e-9, min(b.y1 - b.y0, line["y1"] - line["y0"]))
                if part >= share:
                    best, share = line, part
            if best is None:
                lines.append(best := {"y0": b.y0, "y1": b.y1, "boxes": []})
            best["boxes"].append((b.x, b.box_id, b.text))
            k = len(best["boxes"])
            best["y0"], best["y1"] = best["y0"] + (b.y0 - best["y0"]) / k, best["y1"] + (b.y1 - best["y1"]) / k
        lines.sort(key=lambda line: line["y0"])
        return pd.DataFrame({"image_id": [t["image_id"].iloc[0]] * len(lines), "line_no": range(1, len(lines) + 1), "text": [" ".join(x[2] for x in sorted(line["boxes"])) for line in lines]})

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, line_no int, text string")


def price_patches(items: DataFrame, rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Replaces item prices by the amounts of their matched rows where that makes the items add up to the total.

    items: doc_id, item_index, name, price; rows: doc_id, row_no, line, amount; totals: doc_id, total. A patch needs 1 to 8 replacements, matches for
    0.6 of the items, and a sum within 0.02 of the total. Gives doc_id, item_index, path, old, new.
    """
    matched = match_items(items.select("doc_id", "item_index", "name"), rows.select("doc_id", "row_no", "line")).join(rows.select("doc_id", "row_no", "amount"), ["doc_id", "row_no"])
    new = items.join(matched.select("doc_id", "item_index", "amount"), ["doc_id", "item_index"], "left").withColumn("new", F.coalesce(F.col("amount").cast("decimal(18,2)"), F.col("price").cast("decimal(18,2)")))
    differs = ~F.col("new").eqNullSafe(F.col("price").cast("decimal(18,2)"))
    per = new.groupBy("doc_id").agg(F.sum("new").alias("sum"), F.count_if(differs).alias("n"), (F.count("amount") / F.count("*")).alias("covered"))
    good = per.join(totals, "doc_id").where(F.col("n").between(1, MOST_REPLACED) & (F.col("covered") >= LEAST_COVERED) & (F.abs(F.col("sum") - F.col("total").cast("decimal(18,2)")) <= 0.02)).select("doc_id")
    return new.where(differs).join(good, "doc_id", "left_semi").select("doc_id", "item_index", F.concat(F.lit("/items/"), F.col("item_index").cast("string"), F.lit("/final_price")).alias("path"), F.col("price").alias("old"), F.col("new").cast("double").alias("new"))
