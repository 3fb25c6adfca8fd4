"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only.

Each source is cut into blocks of equal length. Of weights p out of Q, block k of a source is released at slot
floor(k Q / p) and due at slot ceil((k + 1) Q / p); in each slot the released block of the earliest deadline goes.
With integer weights the schedule repeats after Q slots, so the machine runs for one frame of Q slots, whose size
only the weights decide, and every later block's slot follows from its place in its frame. At any slot each source is
less than one block from its share; a source that has run out leaves its slots empty and the others in their order.

Running lengths that cut blocks need no task that holds a whole source: rows are ordered by a digest of their id and
length, sums of the digest's 65,536 ranges come first, and rows add up within their range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._rows import col, frees

#: Name under which sources without a weight of their own are pooled.
OTHER = "*"
#: Hexadecimal digits of a digest that tell its range.
RANGE_DIGITS = 4


def frame_of(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """``group_, p_, q_, j_, at_``: the slot of each of a group's p blocks in a frame of Q slots."""
    names = sorted(weights)
    q, n = sum(weights.values()), len(names)
    p = F.array(*(F.lit(weights[x]) for x in names))
    start = F.struct(F.array(*[F.lit(0)] * n).alias("next"), F.array().cast("array<int>").alias("out"))

    def step(state, t):
        def due(i):
            k, w = F.get(state["next"], i), F.get(p, i)
            released = (k < w) & (F.floor(k * q / w) <= t)
            return F.when(released, F.struct(F.ceil((k + 1) * q / w).alias("deadline"), i.alias("i")))

        now = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), due))["i"]
        following = F.transform(state["next"], lambda x, i: x + F.when(i == now, 1).otherwise(0))
        return F.struct(following.alias("next"), F.concat(state["out"], F.array(now)).alias("out"))

    order = F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), start, step, lambda s: s["out"])
    slots = spark.range(1).select(F.posexplode(order).alias("at_", "i_"))
    j = F.row_number().over(Window.partitionBy("i_").orderBy("at_")) - 1
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("i_") + 1)
    return slots.select(name.alias("group_"), F.element_at(p, F.col("i_") + 1).alias("p_"), F.lit(q).alias("q_"), j.alias("j_"), "at_")


def place_names(columns: list[str]) -> list[str]:
    """The names of group, block, slot and start that ``mix_sources`` adds to these columns."""
    return frees(columns, "group_", "block_", "slot_", "start_")


def mix_sources(docs: DataFrame, weights: dict[str, int], other: int = 1, block_chars: int = 65_536, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows and columns with their place: ``group_, block_, slot_, start_``; sort by slot_, start_.

    ``start_`` is the distance in characters from the beginning of the row's block; every row counts one character
    more than its text, so null and empty texts have a length too and a block's rows are bounded. Sources without a
    weight, and null sources, are one group of weight ``other``. Rows are ordered within a group by the MD5 digest of
    id and length, so neither a source nor an id of many rows meets in one task; rows equal in both are
    interchangeable. No row is dropped or repeated. A row longer than a block takes the time of all blocks it fills.
    Input columns pass whatever their names; added names that the input has too take underscores until they are free
    (``place_names``). An empty table gives an empty result.
    """
    if not weights or min([*weights.values(), other]) < 1:
        raise ValueError("weights are positive integers")
    shares = dict(weights) | {OTHER: other}
    group_, block_, slot_, start_ = place_names(docs.columns)
    key_, size_, range_, wide_, sum_, total_, base_, within_, p_, q_, j_, at_ = frees([*docs.columns, group_, block_, slot_, start_], "key_", "size_", "range_", "wide_", "sum_", "total_", "base_", "within_", "p_", "q_", "j_", "at_")
    group = F.when(col(source_col).isin(*weights), col(source_col)).otherwise(F.lit(OTHER))
    size = (F.length(F.coalesce(col(text_col), F.lit(""))) + 1).cast("long")
    key = F.md5(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), size.cast("string")))
    sized = docs.select(*map(col, docs.columns), group.alias(group_), key.alias(key_), size.alias(size_)).withColumn(range_, F.substring(key_, 1, RANGE_DIGITS))
    ranges = sized.groupBy(group_, range_).agg(F.sum(size_).alias(sum_)).withColumn(wide_, F.substring(range_, 1, RANGE_DIGITS // 2))
    # sums before a range: of the wider ranges before its own, 256 for a group, and of the ranges before it in that
    inside, across = (Window.partitionBy(group_, *more).orderBy(by).rowsBetween(Window.unboundedPreceding, -1) for more, by in (((wide_,), range_), ((), wide_)))
    wider = ranges.groupBy(group_, wide_).agg(F.sum(sum_).alias(total_)).select(group_, wide_, F.coalesce(F.sum(total_).over(across), F.lit(0)).alias(total_))
    ranges = ranges.withColumn(sum_, F.coalesce(F.sum(sum_).over(inside), F.lit(0))).join(wider, [group_, wide_]).select(group_, range_, (F.col(sum_) + F.col(total_)).alias(base_))
    order = Window.partitionBy(group_, range_).orderBy(key_).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(within_, F.coalesce(F.sum(size_).over(order), F.lit(0))).join(ranges, [group_, range_])
    begin = F.col(base_) + F.col(within_)
    placed = placed.withColumns({block_: F.floor(begin / block_chars), start_: begin % block_chars})
    # one row for each unit of weight: the parameter bounds this side
    frame = F.broadcast(frame_of(docs.sparkSession, shares).toDF(group_, p_, q_, j_, at_))
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    placed = placed.withColumn(j_, (F.col(block_) % F.element_at(share, F.col(group_))).cast("int")).join(frame, [group_, j_])
    slot = F.floor(F.col(block_) / F.col(p_)) * F.col(q_) + F.col(at_)
    return placed.select(*map(col, docs.columns), group_, block_, slot.alias(slot_), start_)


def in_mixed_order(docs: DataFrame, weights: dict[str, int], **options) -> DataFrame:
    """The input's rows and columns, sorted into the mix by ranges of slots."""
    _, _, slot, start = place_names(docs.columns)
    return mix_sources(docs, weights, **options).orderBy(slot, start).select(*map(col, docs.columns))
