"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.shared import discard, store, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def fill_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, null last.

    Weights go to the sources in code point order, repeating. Every source gets min(cap, level * weight), where the cap
    is `max_epochs` times its size and the level is such that the targets add up to the size of all sources: the excess
    of capped sources goes to the others by weight. Sorted by cap over weight, the capped sources are a prefix, so the
    level comes from running sums over one row per source instead of rounds.
    """
    table = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("_rank", F.row_number().over(table))
    ranked = ranked.withColumns(
        {
            "_weight": F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, len(weights)) + 1).cast("int")).cast("long"),
            "_cap": F.col("source_size") * max_epochs,
        }
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filling = Window.orderBy("_ratio", "_rank")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "_level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(after),
    )
    level = F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(whole)
    share = level * F.col("_weight")
    target = F.when(share < F.col("_cap"), share).otherwise(F.col("_cap").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def _order(doc_id: str, size: Column, seed: int) -> Column:
    """Seeded order of documents: a digest of the id, then id and size for ties."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.struct(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")).alias("digest"), F.col(doc_id).alias("id"), size.alias("size"))


def _bucket(order: Column) -> Column:
    return F.substring(order["digest"], 1, 3)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The documents with size, source_size, target, copies (whole repetitions) and taken (words, repeats counted).

    A source's target is a number of whole passes and a rest. All documents get the whole passes; the rest goes to the
    first documents in a seeded order of the source, as long as half of the next still fits, so that the taken words
    are within half a document of the target. The cut is found from sums of 4,096 digest buckets per source and then
    inside one bucket, so no source is sorted as a whole; the documents themselves meet only one row per source.

    Null text has size 0; a null source is a source of its own, the last; null ids are ordered by size; repeated rows
    get the same copies; an empty table gives an empty result. Columns called size, source_size, target, copies or
    taken are replaced.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    narrow = docs.select(F.col(source).alias("source"), word_count(text).alias("size"), F.col(doc_id).alias("id"))
    order = _order("id", F.col("size"), seed)
    stored = store(narrow.select("source", "size", order.alias("order")), "mix")
    sums = store(
        stored.groupBy("source", _bucket(F.col("order")).alias("bucket")).agg(F.sum("size").alias("words")), "mix-sums"
    )
    targets = store(fill_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", passes.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    null_safe = lambda left, right: left["source"].eqNullSafe(right["source"])
    running = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(running))
    edge = (
        sums.join(plan.select(F.col("source").alias("_s"), "rest"), sums["source"].eqNullSafe(F.col("_s")))
        .filter("upto > rest")
        .groupBy("source", "rest")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
        .select(F.col("source").alias("_s"), "rest", "e.bucket", "e.before")
    )
    inside = stored.join(edge, stored["source"].eqNullSafe(edge["_s"]) & (_bucket(F.col("order")) == edge["bucket"]))
    rows = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(rows), F.lit(0)))
    cuts = inside.groupBy(F.col("source").alias("_c")).agg(
        F.first("bucket").alias("bucket"),
        F.max(F.when(F.col("upto") + F.col("size") / 2.0 <= F.col("rest"), F.col("order"))).alias("cut"),
    )
    cuts = store(plan.join(cuts, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"), "mix-cuts")
    for frame in (stored, sums, targets):
        discard(frame)
    kept = docs.drop(*[c for c in new if c in docs.columns])
    sized = kept.withColumn("size", word_count(text))
    table = cuts.withColumnRenamed("source", "_source")
    joined = sized.withColumn("_order", _order(doc_id, F.col("size"), seed)).join(table, F.col(source).eqNullSafe(F.col("_source")))
    b = _bucket(F.col("_order"))
    first = F.col("bucket").isNull() | (b < F.col("bucket")) | ((b == F.col("bucket")) & F.coalesce(F.col("_order") <= F.col("cut"), F.lit(False)))
    copies = F.col("whole") + F.when(first, 1).otherwise(0)
    return (
        joined.withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select(*kept.columns, *new)
    )


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row as often as its `copies` say."""
    times = F.expr("sequence(1, CAST(copies AS INT))")
    return mixed.filter("copies > 0").withColumn("_n", F.explode(times)).select(*columns)
