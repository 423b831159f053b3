"""Ranks and medians over groups of any size.

A window over one huge group is one task. For ranks the rows are range-partitioned on (group, order), written once, and
ranked inside their partition; the rows of the same group in earlier partitions are added from a count table with
one row per (partition, group). Medians are selected by counting, without order.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.scalars import number
from winnow.session import materialise, release

BIN_BITS = 16
LARGEST = sys.float_info.max


def running_totals(df: DataFrame, groups: Sequence[str], order: Sequence[Column], weight: Column, out_col: str) -> DataFrame:
    """Sum of `weight` over the rows of the group up to and including the row, whatever the size of a group.

    The frame should be narrow. It is range-partitioned on group and order and written once; totals are taken inside the
    partitions and raised by those of the partitions before, one row per partition and group.
    """
    ranged = df.withColumn("_w", weight).repartitionByRange(*[F.col(g).asc() for g in groups], *order)
    stored = materialise(ranged.withColumn("_part", F.spark_partition_id()), "rank")
    sums = stored.groupBy("_part", *groups).agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = stored.withColumn("_upto", F.sum("_w").over(inside))
    total = (F.col("_upto") + F.col("_before")).cast("long").alias(out_col)
    return null_safe_join(local, before, ["_part", *groups]).select(*df.columns, total)


def rank_in_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    rank_col: str = "rank",
    order_columns: Sequence[str] = (),
) -> DataFrame:
    """Exact 1..n rank by `order` within each group (or over all rows); `order` must end in a unique key.

    With `order_columns`, the columns that `order` reads, the input is written once with a row number and only the
    group and order columns are ranked; the ranks join the rest by that number. Without them whole rows are ranked,
    which suits narrow frames.
    """
    if not order_columns:
        return running_totals(df, groups, order, F.lit(1), rank_col)
    source = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rank-input")
    narrow = source.select(*dict.fromkeys([*groups, *order_columns, "_row"]))
    ranked = running_totals(narrow, groups, order, F.lit(1), rank_col).select("_row", rank_col)
    return source.join(ranked, "_row").select(*df.columns, rank_col)


def rank_top(df: DataFrame, order: Sequence[Column], limit: int, rank_col: str = "rank") -> DataFrame:
    """First `limit` rows numbered from 1; the single-task window only ever sees those rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def assign_ids(
    df: DataFrame,
    prefix: str,
    key: str,
    order: Sequence[Column],
    id_col: str = "design_id",
    key_length: int = 8,
    order_columns: Sequence[str] = (),
) -> DataFrame:
    """Ids such as B_001_ABCDEFGH in rank order; `order_columns` as in `rank_in_group`."""
    text = F.format_string(f"{prefix}_%03d_%s", F.col("_rank"), F.substring(F.col(key).cast("string"), 1, key_length))
    return rank_in_group(df, [], order, "_rank", order_columns).withColumn(id_col, text).drop("_rank")


def ordered_bits(df: DataFrame, value: str, out_col: str) -> DataFrame:
    """The frame with a long that orders like the double `value`: its sign, exponent and mantissa as one number.

    Built from arithmetic that is exact (scaling by powers of two), so it stays in generated code. Both zeros give 0,
    infinities the ends of the scale, null gives null.
    """
    size = F.least(F.abs(value), F.lit(LARGEST))
    first = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2("_size")).cast("int")))
    power = F.pow(F.lit(2.0), F.col("_e"))
    exact = F.when(F.col("_size") < power, F.col("_e") - 1).when(F.col("_size") >= power * 2.0, F.col("_e") + 1).otherwise(F.col("_e"))
    tiny = (F.least(F.col("_size"), F.lit(2.0**-1022)) * 2.0**537 * 2.0**537).cast("long")
    mantissa = ((F.col("_size") / F.pow(F.lit(2.0), F.col("_x")) - 1.0) * 2.0**52).cast("long")
    place = F.shiftleft((F.col("_x") + 1023).cast("long"), 52) + mantissa
    bits = (
        F.when(F.abs(value) == float("inf"), F.lit(2047 << 52))
        .when(F.col("_size") < 2.0**-1022, tiny)
        .otherwise(place)
    )
    stepped = df.withColumn("_size", size).withColumn("_e", first).withColumn("_x", exact)
    return stepped.withColumn(out_col, F.when(F.col(value) < 0, -bits).when(F.col(value) >= 0, bits)).drop("_size", "_e", "_x")


def medians(
    df: DataFrame, groups: Sequence[str], value_col: str, out_col: str = "median", also: Sequence[Column] = ()
) -> DataFrame:
    """Exact median of the non-null values per group, with further aggregates of the first pass.

    Radix selection: the first pass counts the values and finds their range; each further one counts the values inside
    the range by the leading bits of their place in it (2 ** `BIN_BITS` counters a group, added up in the tasks) and goes on in the
    bin that holds the middle, between the least and the largest value seen there. Two middle values in different bins
    are the largest of one and the least of the next. At most five passes read the input, and two or three do as a rule;
    only the counters are shuffled, and one row per group is stored between passes. Jobs run when this is called.
    """
    keys = list(groups) or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(1))
    # no filter on the value: it would be pushed below the projection and copy the value's whole expression
    value = number(value_col)
    first = source.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.lit(0).cast("long").alias("_below"), *also
    )
    first = materialise(first, "groups")
    answer = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).cast("double")
    columns = [*keys, "_n", "_lo", "_hi", "_below", out_col]
    state, stored = first.withColumn(out_col, answer).select(columns), None
    data = source.select(*keys, value.alias("_v"))
    carried = [*keys, "_n", "_below"]
    is_open = F.col(out_col).isNull() & (F.col("_n") > 0)
    while not (open_groups := state.filter(is_open)).isEmpty():
        ranges = ordered_bits(ordered_bits(open_groups, "_lo", "_from"), "_hi", "_to")
        width = F.ceil(F.log2(F.col("_to").cast("double") - F.col("_from").cast("double") + 1)).cast("int")
        ranges = ranges.select(*carried, "_lo", "_hi", "_from", F.greatest(F.lit(0), width - BIN_BITS).alias("_shift"))
        # without groups the range is one row; with groups AQE picks the join from their measured size
        near = null_safe_join(data, ranges if groups else F.broadcast(ranges), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        placed = ordered_bits(near, "_v", "_bits")
        shift = lambda c: F.call_function("shiftright", F.col(c), F.col("_shift"))
        counted = placed.groupBy(*carried, (shift("_bits") - shift("_from")).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        upto = Window.partitionBy(*carried).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("_upto", F.sum("_c").over(upto))
        low, high = F.floor((F.col("_n") + 1) / 2) - F.col("_below"), F.floor(F.col("_n") / 2) + 1 - F.col("_below")

        def hit(rank: Column, column: str) -> Column:
            return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col(column)))

        found = counted.groupBy(*carried).agg(
            hit(low, "_bin").alias("_b1"), hit(high, "_bin").alias("_b2"), hit(low, "_least").alias("_lo1"), hit(low, "_most").alias("_hi1"),
            hit(high, "_least").alias("_lo2"), (hit(low, "_upto") - hit(low, "_c")).alias("_skipped"),
        )
        apart = F.when(F.col("_b1") < F.col("_b2"), (F.col("_hi1") + F.col("_lo2")) / 2.0).when(F.col("_lo1") == F.col("_hi1"), F.col("_lo1"))
        newer = found.select(
            *keys, "_n", F.col("_lo1").alias("_lo"), F.col("_hi1").alias("_hi"), (F.col("_below") + F.col("_skipped")).alias("_below"), apart.alias(out_col)
        )
        older, stored = stored, materialise(state.filter(~is_open).unionByName(newer), "median")
        state = stored
        if older is not None:
            release(older)
    rest = [c for c in first.columns if c not in (*keys, "_n", "_lo", "_hi", "_below")]
    return null_safe_join(first.select(*keys, *rest), state.select(*keys, out_col), keys).select(*groups, out_col, *rest)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, how).select(*[F.col(f"l.{c}") for c in left.columns], *extra)
