"""Exact percentiles of groups of any size, and bootstrap medians, without a task that holds a group.

Spark's percentile keeps every distinct value of a group in one task. Here the values of large groups are counted,
dealt by ranges of (group, value) and stored; the ranges are counted, which tells the range that holds a rank, and
only in those ranges the counts are added up. So the rows are read twice, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.shared import small_side, stored

#: Values of a group that one task may hold.
MOST = 100_000


def large(df: DataFrame, keys: list[str], most: int = MOST) -> bool:
    """Whether any group of df has more rows than that."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).limit(1).count() > 0


def percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...], out: str, most: int = MOST) -> DataFrame:
    """(keys, out): for each group that has a value the percentiles at the points, as Spark's percentile gives them. Null keys are a group; nulls and NaN are no values."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    direct = lambda d: d.groupBy(*keys).agg(F.percentile("__v", F.array(*map(F.lit, points))).alias(out))
    if not large(rows, keys, most):
        return direct(rows)
    # A group's key as one value, nulls included.
    counted = rows.withColumn("__g", F.to_json(F.struct(*keys))).groupBy(*keys, "__g", "__v").agg(F.count("*").alias("__c"))
    held = stored(counted.repartitionByRange("__g", "__v").withColumn("__part", F.spark_partition_id()), "values")
    ranges = stored(held.groupBy(*keys, "__g", "__part").agg(F.sum("__c").alias("n")), "ranges")  # a row a group and part that holds it
    sizes = stored(ranges.groupBy(*keys, "__g").agg(F.sum("n").alias("n")), "groups")
    asked = sizes.select("__g", "n", F.posexplode(F.array(*[((F.col("n") - 1) * F.lit(float(p))) for p in points])).alias("q", "at"))
    picked = select_ranks(held, ranges.select("__g", "__part", F.col("n").alias("c")), asked)
    by_point = picked.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda s: s["x"]).alias(out))
    return sizes.join(by_point, "__g").select(*keys, out)


def select_ranks(held: DataFrame, ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """(__g, q, x): the value at rank `at` (from 0) of each asked (__g, q, at), between its two neighbours where it falls between.

    held: (__g, __v, __c, __part), values and their counts dealt to parts in order; ranges: (__g, __part, c), the counts of parts.
    """
    run = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    placed = ranges.withColumn("start", F.coalesce(F.sum("c").over(run), F.lit(0)))
    ranks = asked.select("__g", "q", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    hit = stored(ranks.join(placed, "__g").where((F.col("start") <= F.col("rank")) & (F.col("start") + F.col("c") > F.col("rank"))), "ranks")
    sought = hit.groupBy("__g", "__part", "start").agg(F.collect_list(F.struct("q", "at", "rank")).alias("asked"))  # of as many as there are points
    inside = held.select("__g", "__part", "__v", "__c").join(small_side(stored(sought.select("__g", "__part").distinct(), "sought")), ["__g", "__part"])
    own = Window.partitionBy("__g", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    summed = inside.withColumn("before", F.coalesce(F.sum("__c").over(own), F.lit(0))).join(sought, ["__g", "__part"])
    found = summed.select("__g", "__v", (F.col("start") + F.col("before")).alias("lo"), "__c", F.explode("asked").alias("a")).where("a.rank >= lo and a.rank < lo + __c")
    low, high = F.min_by("__v", "a.rank"), F.max_by("__v", "a.rank")
    at = F.first("a.at")
    mean = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
    return found.groupBy("__g", F.col("a.q").alias("q")).agg(F.when(F.floor(at) == F.ceil(at), low).otherwise(mean).alias("x"))


def draw(replicate: Column, number: Column, n: int) -> Column:
    """The place (from 1) that a replicate's draw takes among n: a hash of both numbers."""
    hashed = F.md5(F.concat_ws(":", replicate.cast("string"), number.cast("string")))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % n + 1


def bootstrap_medians(placed: DataFrame, value: str, place: str, n: int, replicates: int, ranges: int = 1024) -> DataFrame:
    """(r, m): the median of each replicate's n draws with replacement from n placed rows (place from 1 in order of value).

    Draws are made anew in every round and never moved: they are counted by replicate and range of places, the
    range that holds a median's rank is divided again, down to one place. A round moves replicates * ranges counts at most a task.
    """
    spark = placed.sparkSession
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("r"), draw(F.floor(F.col("id") / n), F.col("id") % n + 1, n).alias("place"))
    width = 1
    while width * ranges < n:
        width *= ranges
    ranks = F.array(F.lit((n - 1) // 2), F.lit(n // 2))
    state = spark.range(replicates).select(F.col("id").alias("r"), F.posexplode(ranks).alias("side", "rank")).select("r", "side", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("first"), F.lit(n).cast("long").alias("span"))
    while True:
        known = stored(state, "median-ranges")
        # Both medians of a replicate are sought in one pass: 2 * replicates rows are sent.
        inside = draws.join(F.broadcast(known), "r").where((F.col("place") > F.col("first")) & (F.col("place") <= F.col("first") + F.col("span")))
        cut = F.floor((F.col("place") - 1 - F.col("first")) / width)
        counted = inside.groupBy("r", "side", "rank", "first", cut.alias("c")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("r", "side").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `ranges` rows
        hit = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("before") + F.col("n") > F.col("rank")))
        state = hit.select("r", "side", (F.col("rank") - F.col("before")).alias("rank"), (F.col("first") + F.col("c") * width).alias("first"), F.lit(width).cast("long").alias("span"))
        if width == 1:
            break
        width //= ranges
    found = placed.select(F.col(place).alias("place"), F.col(value).alias("x"))
    medians = stored(state.select("r", (F.col("first") + 1).alias("place")), "median-places")
    return found.join(F.broadcast(medians), "place").groupBy("r").agg(F.avg("x").alias("m"))
