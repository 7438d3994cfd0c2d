"""Categories of purchases: the alias catalogue, taxonomy keys and what they are called now, and an item's category from all that is known of it."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import category_by_alias, first_present, normal_literal, normalize_text
from .enrichment import infer_categories, taxonomy_key

# Aliases of each category, in the order in which they are tried.
CATEGORY_ALIASES = {
    "personal_care/shampoo": ["shampoo", "hair shampoo", "haar shampoo", "haarpflege shampoo", "head shoulders", "head&shoulders", "h&s", "elvital", "fructis", "pantene", "dove shampoo", "nivea shampoo", "guhl", "schauma", "gliss kur"],
    "personal_care/hygiene": [
        "hygiene", "personal care", "körperpflege", "hygieneartikel", "shampoo", "duschgel", "shower gel", "deo", "deodorant", "zahnpasta", "toothpaste", "seife", "soap", "rasierer", "toilet paper", "toilettenpapier", "tampon", "binden",
        "always", "elmex", "oral b", "nivea", "dove", "balea", "isana",
    ],
    "household/cleaning": ["cleaning supplies", "cleaner", "reiniger", "spülmittel", "waschmittel", "detergent", "domestos", "wc reiniger", "allzweckreiniger"],
    "baby/baby_products": ["baby", "windeln", "diapers", "feuchttücher", "wipes", "hipp", "bebivita", "milupa", "aptamil"],
    "pharmacy/medicine": ["medicine", "medication", "arznei", "apotheke", "tabletten", "ibuprofen", "paracetamol", "nasenspray"],
}
# Kinds of rows, which aren't categories; questions that settle their categories before the catalogue; renamed keys; paths of the fashion keys.
ROW_KINDS = ["item", "discount", "deposit", "refund", "fee", "tax", "subtotal", "total", "payment", "info", "unknown"]
FIRST_RULES = [
    (["hygiene", "hygieneartikel", "personal care", "koerperpflege", "körperpflege"], ["personal_care/hygiene", "personal_care/shampoo"]),
    (["shampoo", "hair shampoo", "haar shampoo", "haarpflege", "head shoulders", "headandshoulders", "h s", "elvital", "fructis"], ["personal_care/shampoo"]),
]
ITEM_KEYS, MERCHANT_KEYS = {"clothing_shoes": "fashion_unknown"}, {"clothing_shoes": "fashion_retail"}
FASHION_PATHS = {"fashion_apparel": "fashion/apparel", "fashion_footwear": "fashion/footwear", "fashion_accessories": "fashion/accessories", "fashion_sportswear": "fashion/sportswear", "fashion_underwear": "fashion/underwear", "fashion_unknown": "fashion/unknown"}


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def item_key(c: Column) -> Column:
    """The key by its present name."""
    k = taxonomy_key(c)
    return F.coalesce(_mapped(k, ITEM_KEYS), k)


def merchant_key(c: Column, valid: list[str]) -> Column:
    """A merchant's key by its present name; `unknown` if it isn't valid."""
    k = taxonomy_key(c)
    k = F.coalesce(_mapped(k, MERCHANT_KEYS), k)
    return F.when(k.isin(valid), k).otherwise("unknown")


def spending_category(c: Column) -> Column:
    """The path of a fashion key, else the text itself, trimmed; null for none."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(_mapped(item_key(text), FASHION_PATHS), text)


def _told(c: Column) -> Column:
    """Null for nothing and for the name of a kind of row."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.when(~F.replace(normalize_text(text), F.lit(" "), F.lit("_")).isin(ROW_KINDS), text)


def item_category(description: Column, explicit: list[Column], key: Column, group: Column, legacy: Column) -> Column:
    """Of an item: a category whose alias is part of its description; else the first explicit one; else its key, its group and its old category, where they say more than a kind of row."""
    return F.coalesce(category_by_alias(description, CATEGORY_ALIASES), spending_category(_told(first_present(*explicit))), spending_category(_told(key)), _told(group), spending_category(_told(legacy)))


def query_categories(query: Column) -> Column:
    """The categories that a question is about."""
    return infer_categories(query, CATEGORY_ALIASES, FIRST_RULES)


def brands(text: Column, known: list[str]) -> Column:
    """Which of the known brands stand in a text as words, in the order of `known`. A brand is only what the text itself says."""
    padded = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    return F.array_compact(F.array(*[F.when(padded.contains(f" {normal_literal(b)} "), b) for b in known]))


def describe(operation: str, label: Column, category: Column, semantic: Column, reason: Column, language: str = "en") -> Column:
    """One sentence about a product, from its record only: what it is (the semantic text, else the reason, else its category) or what type it is recorded as. Null without evidence."""
    text = first_present(semantic, reason)
    sentence = F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))
    human = F.replace(F.replace(_told(category), F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" / "))
    said = reduce(lambda a, b: F.concat(a, b), [F.lit("„" if language == "de" else "“"), label, F.lit("“" if language == "de" else "”")])
    typed = {
        ("describe_product", "en"): (" is categorized as ", "."), ("describe_product", "de"): (" ist als ", " kategorisiert."),
        ("identify_product_type", "en"): (" is recorded as product type “", "”."), ("identify_product_type", "de"): (" ist als Produkttyp „", "“ erfasst."),
    }[operation, language]
    by_category = F.concat(said, F.lit(typed[0]), human, F.lit(typed[1]))
    return F.coalesce(sentence, by_category) if operation == "describe_product" else F.coalesce(by_category, sentence)
