"""Money and number functions over columns."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of currencies, and words that mean none.
CURRENCIES = {"€": "EUR", "EURO": "EUR", "$": "USD", "US$": "USD", "£": "GBP", "¥": "JPY"}
NO_CURRENCY = ["", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "UNK", "-"]
TOLERANCE = 0.02


def money(c: Column) -> Column:
    """decimal(18,2), half up."""
    return F.round(c.cast("decimal(18,6)"), 2).cast("decimal(18,2)")


def currency(c: Column) -> Column:
    t = F.upper(F.trim(c))
    out = t
    for a, b in CURRENCIES.items():
        out = F.when(t == a, b).otherwise(out)
    return F.when(~t.isin(NO_CURRENCY), out)


def exact_sum(c: Column) -> Column:
    """A sum of money that doesn't depend on the order of rows, as a double; null for no rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def cents(c: Column) -> Column:
    """Rounded to two places by the floor of x * 100 + 0.5, the same in every engine."""
    return F.floor(c * 100 + 0.5).cast("double") / 100.0


def within(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a.cast("decimal(18,2)") - b.cast("decimal(18,2)")) <= F.lit(tolerance).cast("decimal(18,2)")


def decimal_literal(c: Column) -> Column:
    """The one money amount in a text, its last mark being the decimal mark; null unless there is exactly one."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\d.,])(-?\d{1,3}(?:[.,]\d{3})*[.,]\d{2}|-?\d+[.,]\d{2})(?![\d.,]*\d)"), F.lit(1))
    one = F.regexp_replace(F.get(found, F.lit(0)), r"[.,](?=.*[.,])", "")
    return F.when(F.size(found) == 1, F.replace(one, F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))
