"""Typed filters: a field, an operator and a value become canonical values, a condition and protected parameters."""
import datetime
import re
import unicodedata
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guard import Filter

# Fields, their operators, kinds of value, parameter suffixes and columns.
TEXT, NUMBER = ["matches", "equals", "contains", "in"], ["equals", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "between"]
FIELDS = {
    "product": (["matches", "equals"], "text", "item", ["item_id"]), "merchant": (TEXT, "text", "merchant", ["merchant"]), "category": (TEXT, "text", "category", ["category"]),
    "purchase_date": (["equals", "before", "after", "between"], "date", "date", ["receipt_date"]), "amount": (NUMBER, "number", "amount", ["grand_total", "line_total"]),
    "payment_method": (TEXT, "text", "payment_method", ["payment_method"]), "currency": (TEXT, "text", "currency", ["currency"]), "receipt_id": (["equals", "in"], "positive_integer", "receipt_id", ["receipt_id"]),
}
FUZZY, MARGIN = 0.84, 0.08


@dataclass
class QueryFilter:
    field: str
    operator: str
    value: object
    filter_id: str = "f001"

    def __post_init__(self):
        operators, kind, *_ = FIELDS[self.field]
        if self.operator not in operators:
            raise ValueError(f"{self.field} has no operator {self.operator}")
        values = self.values
        if (self.operator == "between") != (len(values) == 2 and self.operator == "between") or any(isinstance(v, bool) or v is None for v in values) or not values:
            raise ValueError("between takes two values, and no value is boolean or null")
        self.clean = [_scalar(v, kind) for v in values]
        if self.operator == "between" and self.clean[0] > self.clean[1]:
            raise ValueError("between takes ascending values")

    @property
    def values(self) -> list:
        return list(self.value) if isinstance(self.value, (list, tuple)) else [self.value]


def _scalar(v, kind: str):
    if kind == "date":
        return datetime.date.fromisoformat(str(v)).isoformat()
    if kind == "number":
        return float(v)
    if kind == "positive_integer":
        n = int(v)
        if n <= 0 or n != float(v):
            raise ValueError("a positive whole number is needed")
        return n
    if not str(v).strip():
        raise ValueError("a text is needed")
    return str(v)


def fold_value(text: str | None) -> str:
    """Marks dropped by compatibility decomposition, case folded, all but a-z and 0-9 one space (ä: a)."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", t).split())


def fold(c: Column) -> Column:
    """fold_value of a column; there is no built-in decomposition."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fold_value)

    return run(c)


def match_catalog(requested: str, catalog: list[str], operator: str, is_currency: bool = False) -> list[str]:
    """Exact matches; else, unless the operator is equals, values that contain the text, or contain each other; else those most alike."""
    norm = (lambda x: str(x or "").strip().upper()) if is_currency else fold_value
    want = norm(requested)
    if not want:
        return []
    keyed = [(v, norm(v)) for v in dict.fromkeys(catalog)]
    exact = [v for v, k in keyed if k == want]
    if exact or operator == "equals":
        return exact
    if operator == "contains":
        return [v for v, k in keyed if want in k]
    inside = [v for v, k in keyed if want in k or (k and k in want)]
    if inside:
        return inside
    ranked = sorted(((SequenceMatcher(None, want, k).ratio(), v) for v, k in keyed if k), reverse=True)
    if not ranked or ranked[0][0] < FUZZY:
        return []
    close = [v for r, v in ranked if ranked[0][0] - r < MARGIN]
    return close if operator == "in" else close[:2]


@dataclass
class Resolved:
    status: str  # resolved, not_found, needs_clarification
    values: list = field(default_factory=list)
    candidates: list[str] = field(default_factory=list)


def resolve(f: QueryFilter, catalog: list[str] | None = None) -> Resolved:
    """Catalog fields take their values from the catalog (a distinct list, already limited); the rest are normalised. More than one match is a question, unless the operator is contains."""
    if FIELDS[f.field][1] != "text":
        return Resolved("resolved", f.clean)
    out, doubt = [], []
    for v in f.clean:
        found = match_catalog(v, catalog or [], f.operator, f.field == "currency")
        if not found:
            return Resolved("not_found")
        (doubt if len(found) > 1 and f.operator != "contains" else out).extend(found)
    return Resolved("needs_clarification", candidates=list(dict.fromkeys(doubt))[:10]) if doubt else Resolved("resolved", list(dict.fromkeys(out)))


def parameters(f: QueryFilter, r: Resolved) -> dict[str, object]:
    return {f"{f.filter_id}_{FIELDS[f.field][2]}_{i}": v for i, v in enumerate(r.values)}


def guard_filter(f: QueryFilter, r: Resolved) -> Filter:
    return Filter(FIELDS[f.field][3], f.operator if FIELDS[f.field][1] != "text" else "in", list(parameters(f, r)))


def condition(f: QueryFilter, r: Resolved, column: str) -> Column:
    """The same filter on a DataFrame column."""
    c, v = F.col(column), r.values
    one = {"greater_than": lambda: c > v[0], "greater_than_or_equal": lambda: c >= v[0], "less_than": lambda: c < v[0], "less_than_or_equal": lambda: c <= v[0], "before": lambda: c < v[0], "after": lambda: c > v[0], "between": lambda: c.between(v[0], v[1])}
    return one[f.operator]() if f.operator in one else c.isin(v)


def compare(column: str, operator: str, values: list | None = None) -> Column:
    """A condition of the planner's language: eq, neq, in, not_in, contains (any case), gt, gte, lt, lte, between, is_null, not_null. A null value fits none but is_null."""
    c, v = F.col(column), list(values or [])
    most = {"is_null": 0, "not_null": 0, "between": 2}.get(operator, len(v) if operator in ("in", "not_in") else 1)
    if len(v) != most or (operator in ("in", "not_in") and not v):
        raise ValueError(f"{operator} takes {most or 'no' if operator not in ('in', 'not_in') else 'some'} values")
    conditions = {
        "eq": lambda: c == v[0], "neq": lambda: c != v[0], "in": lambda: c.isin(v), "not_in": lambda: ~c.isin(v), "contains": lambda: F.contains(F.lower(c), F.lower(F.lit(v[0]))), "gt": lambda: c > v[0], "gte": lambda: c >= v[0],
        "lt": lambda: c < v[0], "lte": lambda: c <= v[0], "between": lambda: c.between(v[0], v[1]), "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
    }
    if operator not in conditions:
        raise ValueError(f"operator {operator} isn't known")
    return conditions[operator]()


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ratcliff/Obershelp ratio of two columns: no built-in measures it. For short catalog texts."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", ratio(a, b))
