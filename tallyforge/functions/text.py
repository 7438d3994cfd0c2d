"""Text functions over columns. All are built-in expressions, so they stay in generated code."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that merchant names are recognised by, in the order in which they are tried.
MERCHANTS = {
    "dm": ["dm", "dm-drogerie", "dm drogerie", "dm-drogerie markt", "drogerie markt"],
    "rossmann": ["rossmann", "rossmann drogerie"],
    "rewe": ["rewe"],
    "aldi": ["aldi", "aldi süd", "aldi sued", "aldi nord"],
    "lidl": ["lidl"],
    "edeka": ["edeka"],
    "kaufland": ["kaufland"],
}
# Descriptions that name no product.
PLACEHOLDERS = ["none", "null", "unknown", "n/a", "na", "item", "product", "product purchase", "purchase"]
# What a plain-text normaliser spells out.
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "&": " and ", "+": " plus "}
# Latin letters with marks and what they fold to.
MARKED, PLAIN = "áàâãåäçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normal_literal(text: str) -> str:
    """The same as normalize_text for a literal."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", reduce(lambda t, kv: t.replace(*kv), SPELLED.items(), text.lower())).strip()


def normalize_text(c: Column | str) -> Column:
    """Lower case, umlauts spelled out (ä: ae), & and + as words, all else but a-z and 0-9 one space. Null gives ''."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    for a, b in SPELLED.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def fold_text(c: Column) -> Column:
    """Like normalize_text, but marks are dropped (ä: a). Built-in for Latin letters; see operators.filters.fold for any script."""
    t = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    return F.trim(F.regexp_replace(F.replace(t, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    """Distinct words of a normalised text in order; none for ''."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: w != ""))


def first_present(*cols: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def as_float_de(c: Column) -> Column:
    """A number as written in German: one comma is the decimal mark; with a comma, dots are dropped. Signs € and EUR and spaces are ignored; null for anything else."""
    t = F.regexp_replace(F.trim(c), "€|EUR| ", "")
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
    t = F.when((commas == 1) & (dots == 0), F.replace(t, F.lit(","), F.lit("."))).when((commas == 1) & (dots >= 1), F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))).otherwise(t)
    return F.when(t.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), t.try_cast("double"))


def merchant_name(c: Column) -> Column:
    """The first merchant one of whose spellings is part of the normalised name; else the normalised name; null for ''."""
    n = normalize_text(c)
    out = n
    for name, spellings in reversed(MERCHANTS.items()):
        out = F.when(reduce(lambda a, b: a | b, [n.contains(normal_literal(s)) for s in spellings]), F.lit(name)).otherwise(out)
    return F.when(n != "", out)


def category_by_alias(c: Column, aliases: dict[str, list[str]]) -> Column:
    """The first category (in the order of aliases) with an alias that is part of the normalised text; null if none."""
    n = normalize_text(c)
    out = F.lit(None).cast("string")
    for name, words in reversed(aliases.items()):
        out = F.when(reduce(lambda a, b: a | b, [n.contains(normal_literal(w)) for w in words]), F.lit(name)).otherwise(out)
    return out


def is_indexable(c: Column) -> Column:
    """Whether a description says something: three characters or more once spaces are collapsed, and no placeholder."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return (F.length(t) >= 3) & ~t.isin(PLACEHOLDERS)


def identity_key(name: Column, fallback_id: Column) -> Column:
    return F.coalesce(F.nullif(normalize_text(name), F.lit("")), F.concat(F.lit("item:"), fallback_id.cast("string")))


def ngrams(word: Column, size: int = 3) -> Column:
    """Distinct runs of `size` characters; a shorter word is its own."""
    return F.when(F.length(word) <= size, F.array(word)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (size - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(size)))))


def trigram_score(a: Column, b: Column) -> Column:
    """2.5 times the Jaccard overlap of trigrams if that is 0.45 or more, else 0; 0 for words under four characters."""
    x, y = ngrams(a), ngrams(b)
    j = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.length(a) >= 4) & (F.length(b) >= 4) & (j >= 0.45), F.lit(2.5) * j).otherwise(F.lit(0.0))


def _word_fit(w: str):
    """How well a text's word fits the query's word w."""
    k = float(len(w))

    def fit(x: Column) -> Column:
        size = F.length(x)
        inside = F.lit(len(w) >= 4) & F.contains(x, F.lit(w))
        around = (size >= 4) & F.contains(F.lit(w), x)
        return F.when(x == w, 8.0).when(inside, 6.0 + F.least(F.lit(1.0), k / size)).when(around, 4.0 + F.least(F.lit(1.0), size / F.lit(k))).otherwise(trigram_score(F.lit(w), x))

    return fit


def contains_tokens(text: Column, part: Column) -> Column:
    """Whether the words of part stand in text one after the other."""
    pad = lambda c: F.concat(F.lit(" "), normalize_text(c), F.lit(" "))
    return (normalize_text(part) != "") & F.contains(pad(text), pad(part))


def lexical_relevance(query: str, name: Column) -> Column:
    """How well a product name fits the words of a query: whole-text matches, then the best match of each query word."""
    q = normal_literal(query)
    t = normalize_text(name)
    words = list(dict.fromkeys(q.split()))
    if not words:
        return F.lit(0.0)
    n = float(len(q))
    whole = F.when(t == q, 20.0).when(t.contains(q), 12.0 + F.least(F.lit(2.0), n / F.greatest(F.length(t), F.lit(1)))).when(F.contains(F.lit(q), t), 5.0).otherwise(0.0)
    score = whole
    for w in words:
        score = score + F.array_max(F.transform(tokens(t), _word_fit(w)))
    return F.when(t == "", F.lit(0.0)).otherwise(F.round(score.cast("decimal(20,12)"), 8).cast("double"))


def sql_like(c: Column, pattern: str) -> Column:
    """LIKE that ignores case, as the stored procedures of embedded databases do."""
    return c.ilike(pattern)
