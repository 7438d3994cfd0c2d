"""Noisy descriptions and calibration of category confidence."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps of the confidence, and from where on no review is needed.
CAPS = {"noisy": 0.75, "ambiguous": 0.75, "contextual": 0.80, "incomplete": 0.60, "unsupported": 0.60, "unknown": 0.35}
ENOUGH = 0.80
# Signs that point to reading errors, and short words that are common in product names.
MARKERS = ["�", "|", "§", "#", "@", "~", "^", "_", "<", ">", "{", "}", "[", "]"]
SHORT_WORDS = ["BIO", "XL", "XXL", "L", "M", "S", "XS", "2ER", "3ER", "4ER", "6ER", "TK", "WC", "SB", "FH"]
# Phrases by which a reason says that it guesses, and by which it explains words.
GUESSES = [
    r"\blikely\b", r"\bprobably\b", r"\bpossibly\b", r"\bperhaps\b", r"\bmaybe\b", r"\bassum", r"\bguess", r"\bunclear\b", r"\bambiguous\b", r"\bvague\b", r"\btruncated\b", r"\babbreviat", r"\bocr\b", "not enough", "insufficient",
    "could be", "may be", "might be", "wahrscheinlich", "vermutlich", "möglicherweise", "moeglicherweise", "unklar", "nicht eindeutig", "könnte", "koennte", "scheint", "abgekürzt", "abgekuerzt",
]
EXPLANATIONS = [r"\brefers to\b", r"\bmeans\b", r"\bshort for\b", r"\babbreviation for\b", r"\bis a type of\b", r"\bstands for\b", r"\bbedeutet\b", r"\bsteht für\b", r"\bsteht fuer\b", r"\bkurz für\b", r"\bkurz fuer\b"]


def noise(description: Column) -> Column:
    """Reasons why a description may be misread, as an array in fixed order; empty if none."""
    t = F.substr(F.trim(F.coalesce(description, F.lit(""))), F.lit(1), F.lit(240))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    letters = lambda w: F.regexp_replace(w, "[^A-Za-zÄÖÜäöüß]", "")
    bare = F.regexp_replace(t, r"\s+", "")
    size, digits, marks = F.length(bare), F.length(F.regexp_replace(bare, r"\P{Nd}", "")), F.length(F.regexp_replace(bare, r"[\p{L}\p{N}]", ""))
    code = bare.rlike(r"\d{5,}") | ((digits >= 4) & (digits / size >= 0.3)) | ((marks >= 3) & (marks / size >= 0.2)) | (~bare.rlike(r"\p{L}") & (digits > 0)) | bare.rlike(r"(?:\d+[./-]){2,}\d+")
    short = F.size(F.filter(words, lambda w: (F.length(letters(w)) <= 2) & ~F.upper(w).isin(SHORT_WORDS)))
    last = F.upper(letters(F.get(words, F.size(words) - 1)))
    found = [
        F.when(F.length(t) <= 3, "very_short_description"), F.when((F.size(words) == 1) & (F.length(t) <= 5), "single_short_token"),
        F.when(sum((t.contains(m).cast("int") for m in MARKERS), F.lit(0)) > 0, "contains_ocr_marker"), F.when(code, "code_like_or_numeric_description"),
        F.when(t.rlike(r"[.,:;/-]\z"), "truncated_or_punctuation_ending"), F.when(t.rlike(r"\b[A-Za-zÄÖÜäöüß]{1,2}\.\z"), "abbreviated_last_token"),
        F.when((F.size(words) >= 2) & (short >= 2), "many_short_tokens"), F.when(F.length(last).between(2, 3) & ~last.isin(SHORT_WORDS) & (F.length(t) > 8), "truncated_last_token"),
    ]
    return F.when(t == "", F.array(F.lit("empty_description"))).otherwise(F.array_compact(F.array(*found)))


def calibrate(df: DataFrame) -> DataFrame:
    """df: description, category_key, confidence, reason, text_certainty, unsupported (number of evidence terms that aren't found), fallback (boolean). Adds calibrated, review_required, review_reasons."""
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    reason = F.lower(F.substr(F.trim(F.coalesce("reason", F.lit(""))), F.lit(1), F.lit(400)))
    noisy = noise(F.col("description"))
    guess = (reason == "") | reason.rlike("|".join(GUESSES))
    sure = F.col("text_certainty") == "explicit"
    weak = F.col("text_certainty").isin("incomplete_or_unfamiliar", "ambiguous")
    explains = reason.rlike("|".join(EXPLANATIONS))
    unknown = F.col("category_key") == "unknown"
    cap = lambda cond, name: F.when(cond, CAPS[name]).otherwise(1.0)
    value = F.least(conf, cap(F.size(noisy) > 0, "noisy"), cap(guess, "ambiguous"), cap(~sure, "contextual"), cap(weak, "incomplete"), cap((F.col("unsupported") > 0) | explains, "unsupported"), cap(unknown, "unknown"))
    value = F.round(value.cast("decimal(18,9)"), 3).cast("double")
    reasons = F.concat(noisy, F.array_compact(F.array(
        F.when(reason == "", "missing_category_reason").when(guess, "ambiguous_reason"), F.when(~sure & (conf > CAPS["contextual"]), "non_explicit_text_cannot_receive_high_confidence"),
        F.when(weak, F.concat(F.lit("text_certainty:"), F.col("text_certainty"))), F.when(F.col("unsupported") > 0, "unsupported_category_evidence_terms"), F.when(explains, "semantic_expansion_not_explicit_in_receipt_text"),
        F.when(unknown, "unknown_category"), F.when(F.col("fallback"), "fallback_category_source"), F.when(value < ENOUGH, "low_calibrated_confidence"),
    )))
    return df.select("*", value.alias("calibrated"), F.array_distinct(reasons).alias("review_reasons"), (F.size(reasons) > 0).alias("review_required"))


def coerce(answers: DataFrame, items: DataFrame, valid_keys: list[str]) -> DataFrame:
    """answers: record_id, item_index, category_key, seq. The last answer for an item wins, unknown keys and missing answers give `unknown`, answers to no item are left out."""
    last = answers.where("item_index is not null").groupBy("record_id", "item_index").agg(F.max_by("category_key", "seq").alias("key"))
    return items.join(last, ["record_id", "item_index"], "left").select(*items.columns, F.when(F.col("key").isin(valid_keys), F.col("key")).otherwise("unknown").alias("category_key"))
