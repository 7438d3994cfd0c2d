"""Corrections of records from source evidence: VAT patches, inserted items, and the rounds that choose among strategies."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import MOST_INSERTED

# Rounds of a correction at most, and severities from worst to mildest.
MOST_ROUNDS, SEVERITIES = 6, ["error", "review"]


def vat_patches(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """blocks: record_id, block_no, source_row, row_label, rate, net, vat (null where not printed); records: record_id, net, vat. One row a record with evidence: status, vat_lines (to replace the
    record's), new_net, new_vat (null: stays).

    A labelled block with a VAT amount and no rate is the aggregate; different aggregates make the record abstain. Blocks with net and VAT are lines. The net of a single line is the record's net.
    """
    labelled = (F.trim(F.coalesce("row_label", F.lit(""))) != "") & F.col("vat").isNotNull() & F.col("rate").isNull()
    line = ~labelled & F.col("net").isNotNull() & F.col("vat").isNotNull()
    money = lambda c: F.col(c).cast("decimal(18,2)")
    g = blocks.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.when(line, F.struct("block_no", "rate", money("net").cast("double").alias("net"), money("vat").cast("double").alias("vat"))))).alias("vat_lines"),  # lines of one record
        F.count_distinct(F.when(labelled, money("vat"))).alias("_values"), F.min(F.when(labelled, money("vat"))).alias("_vat"), F.count_if(~labelled & ~line).alias("ignored"),
    )
    j = g.join(records.select("record_id", F.col("net").cast("decimal(18,2)").alias("_net")), "record_id")
    only = F.when(F.size("vat_lines") == 1, F.get("vat_lines", F.lit(0))["net"])
    new_net = F.when(~only.cast("decimal(18,2)").eqNullSafe(F.col("_net")), only)
    status = F.when(F.col("_values") > 1, "conflicting_aggregates").when((F.size("vat_lines") == 0) & F.col("_vat").isNull(), "no_evidence").otherwise("patch_built")
    out = j.withColumn("status", status)
    built = F.col("status") == "patch_built"
    return out.select("record_id", "status", F.when(built & (F.size("vat_lines") > 0), F.col("vat_lines")).alias("vat_lines"), F.when(built, new_net).alias("new_net"), F.when(built, F.col("_vat").cast("double")).alias("new_vat"), "ignored")


def insertions(source: DataFrame, matched: DataFrame, totals: DataFrame) -> DataFrame:
    """Source items that no item of the record was matched with, where they alone explain what is missing. source: record_id, item_index, name, amount; matched: record_id, item_index; totals: record_id, item_sum, total.

    At most 4 for a record, all with an amount; their sum has to bring the record's items within 0.02 of its total. record_id, path, name, amount.
    """
    left = source.join(matched, ["record_id", "item_index"], "left_anti")
    per = left.groupBy("record_id").agg(F.count("*").alias("n"), F.count("amount").alias("priced"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("sum"))
    gap = F.abs(F.col("item_sum").cast("decimal(18,2)") + F.col("sum") - F.col("total").cast("decimal(18,2)"))
    good = per.join(totals, "record_id").where((F.col("n") <= MOST_INSERTED) & (F.col("priced") == F.col("n")) & (gap <= 0.02)).select("record_id")
    return left.join(good, "record_id", "left_semi").select("record_id", F.format_string("/items/%d", "item_index").alias("path"), "name", "amount")


def worst_first(checks: DataFrame, order: list[str], *more: str) -> DataFrame:
    """The failed check of each record that a round works on: by severity, then by the order of the rules. record_id, target and the check's other columns that are named."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), c), F.lit(0)), F.lit(len(names) + 1))
    key = F.struct(place(F.col("severity"), SEVERITIES).alias("s"), place(F.col("code"), order).alias("o"))
    worst = checks.where("status = 'failed'").groupBy("record_id").agg(F.min_by(F.struct(F.col("code").alias("target"), *more), key).alias("w"))
    return worst.select("record_id", "w.*")


def accepted(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """Records whose target passes now and of whose checks none failed newly: record_id. Targets may be as many as the records, however small their file, so no side is broadcast."""
    b, a = before.select("record_id", "code", F.col("status").alias("was")), after.select("record_id", "code", F.col("status").alias("now"))
    j = b.join(a.hint("merge"), ["record_id", "code"], "full_outer").join(targets.hint("merge"), "record_id")
    solved = F.bool_or((F.col("code") == F.col("target")) & (F.col("now") == "passed"))
    worse = F.bool_or((F.coalesce("was", F.lit("passed")) != "failed") & F.coalesce(F.col("now") == "failed", F.lit(False)))
    return j.groupBy("record_id").agg((solved & ~worse).alias("ok")).where("ok").select("record_id")


def correct(records: DataFrame, check: Callable[[DataFrame], DataFrame], strategies: dict[str, list[Callable[[DataFrame], DataFrame]]], cut: Callable[[DataFrame], DataFrame], order: list[str], rounds: int = MOST_ROUNDS) -> DataFrame:
    """Corrects records in rounds: each record's worst failed check picks a chain of strategies, the next of which is tried; a change stays if the target passes and nothing else fails newly.

    records: record_id and the fields that strategies change; check: records -> record_id, code, status, severity; a strategy: records -> the same columns, changed; cut writes a table, so that rounds
    don't pile up. All records with the same target go through a strategy together. Ends when nothing is left to try, at most after `rounds`. Written columns of ids are
    small files of many rows, which Spark would take for small tables, so every join is told to merge.
    """
    tried: DataFrame | None = None
    for _ in range(rounds):
        checks = cut(check(records))
        if tried is not None:
            open_ = checks.join(tried.hint("merge"), ["record_id", "code"], "left")
        else:
            open_ = checks.withColumn("times", F.lit(0))
        steps = F.element_at(F.create_map(*[F.lit(x) for code, chain in strategies.items() for x in (code, len(chain))]), F.col("code"))
        open_ = open_.withColumn("times", F.coalesce("times", F.lit(0))).where(F.coalesce(steps, F.lit(0)) > F.col("times"))
        targets = cut(worst_first(open_, order, "times"))
        if targets.isEmpty():
            break
        changed = None
        for code, chain in strategies.items():
            for k, strategy in enumerate(chain):
                mine = records.join(targets.where((F.col("target") == code) & (F.col("times") == k)).select("record_id").hint("merge"), "record_id", "left_semi")
                made = strategy(mine).select(records.columns)
                changed = made if changed is None else changed.union(made)
        changed = cut(changed)
        good = cut(accepted(checks, check(changed), targets.select("record_id", "target")))
        good = good.hint("merge")
        records = cut(records.join(good, "record_id", "left_anti").union(changed.join(good, "record_id", "left_semi").select(records.columns)))
        now = targets.select("record_id", F.col("target").alias("code"), (F.col("times") + 1).alias("times"))
        tried = cut(now if tried is None else tried.join(now.select("record_id", "code").hint("merge"), ["record_id", "code"], "left_anti").unionByName(now))
    return records


def edited_currency(currency: Column, wrappers: Column) -> Column:
    """Money wrappers (array of name, amount, currency) after the record's currency was edited: all of them take it."""
    return F.transform(wrappers, lambda w: w.withField("currency", currency))
