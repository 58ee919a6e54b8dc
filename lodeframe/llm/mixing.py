"""Time-varying curriculum: mix sources to target weights and place every document on the training line.

Each source has a weight w and a linear schedule w * (1 + tilt * (1 - 2t)) over training time t in [0, 1]; its
integral is the cumulative demand w * G(t), G(t) = t + tilt * t * (1 - t). A source meets its target by walking
its documents in a fixed pseudo-random order, again from the start up to the cap; the word at share y of the
target trains at the time t where G(t) = y. Range-sorting by that position gives the training order.

All steps are DataFrame operations. A source with any share of the rows is summed in hash buckets
(common.with_prefix); no step gathers a source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import cut, n_words, spread, with_prefix

WEIGHTS = (5.0, 2.0, 1.0)
#: Tilts of the schedules, repeating as the weights do: positive trains a source early, negative late.
TILTS = (0.5, 0.0, -0.5)
CAP = 3.0


def _pick(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, cap: float = CAP) -> DataFrame:
    """From (source, size): (source, source_size, weight, tilt, target).

    Sources rank by code point, null last; weights repeat over the ranks. Targets share the total of all sizes
    by weight, none above cap times its source's size; the excess is shared again by weight until none is above.
    The fill is a water level: target = min(level * weight, cap * size), found by sorting cap * size / weight.
    A source of size 0 has target 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("source", "source_size", _pick(weights, F.col("rank")).alias("weight"), _pick(tilts, F.col("rank")).alias("tilt"), "rank")
    full = ranked.withColumn("room", F.lit(cap) * F.col("source_size")).withColumn("fills_at", F.col("room") / F.col("weight"))
    order = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = full.select("*", F.coalesce(F.sum("room").over(order), F.lit(0.0)).alias("full_before"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))).alias("weight_left"), F.sum("source_size").over(every).alias("total"))
    # with all sources before this one full, the level at which the rest share what is left
    full = full.withColumn("level_here", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    level = F.min(F.when(F.col("level_here") <= F.col("fills_at"), F.struct("fills_at", "rank", "level_here"))).over(every)["level_here"]
    target = F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("weight"), F.col("room"))
    return full.select("source", "source_size", "weight", "tilt", target.alias("target"))


def position(share: Column, tilt: Column) -> Column:
    """The time t in [0, 1] at which G(t) = share."""
    y = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    b = 1 + tilt
    root = F.sqrt(F.greatest(b * b - 4 * tilt * y, F.lit(0.0)))
    return F.when(F.abs(tilt) < 1e-9, y).otherwise(F.least(F.greatest((b - root) / (2 * F.when(tilt == 0, F.lit(1.0)).otherwise(tilt)), F.lit(0.0)), F.lit(1.0)))


def curriculum(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, cap: float = CAP, per_bucket: int = 5_000) -> DataFrame:
    """One row for each row of docs: (doc_id, source, size, source_size, target, taken, positions).

    size is the number of words [^\\x20\\x09-\\x0D]+ (null: 0). Over a source, the taken words sum to its target
    rounded down: every document is taken whole for each full pass, and the last pass ends within one document.
    positions holds the training time of each pass that takes words from the document, the first word's.
    Documents without words take none. Repeated rows are separate documents; their order among themselves does
    not change what a document id takes in all by more than its own size. Null sources form one source. An
    empty table gives an empty result. Reruns agree: the order is a hash of the id, ties by id and size.
    """
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    sized = cut(sized.withColumn("_hash", spread(F.col("doc_id"))), "sized")
    aims = targets(sized, weights=weights, tilts=tilts, cap=cap)
    aims = aims.select(F.col("source").alias("_aim"), "source_size", "tilt", "target")
    walked = with_prefix(sized, ["source"], ["_hash", "doc_id", "size"], "size", sized.count(), per_bucket=per_bucket)
    joined = walked.join(aims, F.col("source").eqNullSafe(F.col("_aim")))
    goal = F.floor(F.col("target") + 1e-6).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long")
    share = lambda k: (k * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1e-9))
    count = F.when(F.col("size") == 0, F.lit(0)).otherwise(passes + F.when(last > 0, 1).otherwise(0)).cast("int")
    times = F.transform(F.filter(F.sequence(F.lit(0), F.lit(int(cap) + 1)), lambda k: k < count), lambda k: position(share(k), F.col("tilt")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + last).alias("taken"), times.alias("positions"))


def training_line(mixed: DataFrame) -> DataFrame:
    """The rows and columns of mixed (a curriculum) and places: for each of a row's positions its exact rank, from 0 and
    gapless, among those of all rows. Ties go by id, size and source; rows without positions have no places.

    Positions are range-sorted; a rank is the count of all earlier ranges and the place in its own.
    """
    held = cut(mixed.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    each = held.select("_row", "doc_id", "size", "source", F.explode("positions").alias("position"))
    order = ["position", "doc_id", "size", "source"]
    line = cut(each.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", "position", F.monotonically_increasing_id().alias("_at")), "line")
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # as that function numbers rows
    ranges = line.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_part", F.coalesce(earlier, F.lit(0)).alias("_past"))  # a row for each range
    ranked = line.join(F.broadcast(ranges), part == F.col("_part")).select(F.col("_row").alias("_of"), "position", (F.col("_past") + own).alias("place"))
    places = ranked.groupBy("_of").agg(F.sort_array(F.collect_list("place")).alias("places"))  # as many as passes
    none = F.array().cast("array<long>")
    return held.join(places, F.col("_row") == F.col("_of"), "left").select(*mixed.columns, F.coalesce("places", none).alias("places"))


def training_order(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs once for each position, range-sorted by it, with the columns of docs alone.

    docs may repeat an id; each repeated row is then placed at the positions of one mixed row of that id. Null ids are
    one id. Rows that mixed gives no position go. Empty tables give an empty result; columns may have any names.
    """
    whole = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = mixed.groupBy("doc_id").agg(F.max("positions").alias("positions"))
    placed = whole.join(one, F.col("id").eqNullSafe(F.col("doc_id")), "inner").select("id", "row", F.explode("positions").alias("position"))
    return placed.repartitionByRange("position").sortWithinPartitions("position", "id").select("row.*")
