"""Exact quantiles, running totals and ranks without a global sort in one task.

A value v gets a bucket number made of its sign, its binary exponent e and the first 44 bits of
|v| / 2**e, which never decreases as v grows. Dropping 16 bits at a time gives a tree of buckets:
a bucket has at most 65,536 children at every level, the top level has one bucket per 16 powers
of two (some 280 for all doubles), and a lowest bucket holds at most some 256 distinct doubles,
however close to zero. Every window below runs over the children of one bucket, however many
rows, and however hot a value, the input has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialise, settings

LEAF_BITS = 44
STEP = 16
TOP = 3  # steps from the lowest to the highest level
HISTOGRAM = 2  # level of the first pass of a quantile search: 4,096 buckets per power of two
LOWEST_EXPONENT = -1100  # below that of every double
# Shuffled bytes that a task sorts at a time where almost every value is distinct.
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB"}


def leaf_bucket(value: Column) -> Column:
    """Lowest bucket of a value; zero has bucket 0, NaN and infinities the outermost ones.

    log2 never falls as its argument grows, so neither does the exponent. Where rounding gives
    the next exponent too early the fraction is just below 1, and the bucket still in order.
    """
    v = value.cast("double")
    size = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(F.abs(v))
    exponent = F.floor(F.log2(F.when(size < F.lit(float("inf")), F.nullif(size, F.lit(0.0)))))
    half = F.floor(exponent / 2)  # 2**exponent itself may not be a double
    fraction = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    inside = ((exponent - LOWEST_EXPONENT).cast("bigint") * F.lit(2 ** LEAF_BITS)
              + F.floor((fraction - 1) * F.lit(float(2 ** LEAF_BITS))).cast("bigint"))
    ranked = F.when(size == 0, F.lit(0).cast("bigint")).otherwise(
        F.coalesce(inside, F.lit(2200 * 2 ** LEAF_BITS)))
    return F.when((v < 0) & ~F.isnan(v), -ranked).otherwise(ranked)


def parent(bucket: Column, steps: int = 1) -> Column:
    return F.shiftright(bucket, STEP * steps)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match, keeping the left copy of the keys."""
    out = left.join(right, _same(left, right, keys), how)
    return out if how == "left_semi" else out.drop(*[right[k] for k in keys])


def value_totals(df: DataFrame, value: str, sums: dict[str, Column],
                 by: list[str] | None = None) -> DataFrame:
    """Sums of row expressions per distinct non-null `value` within `by`, written out."""
    totals = df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()])
    return materialise(totals, "value-totals")


def running_totals(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None,
                   descending: bool = False) -> DataFrame:
    """One row per distinct `value` (within `by`) with sums and running sums.

    `sums` maps names to row expressions. For each name the result has the sum
    at the value (`name`) and the sum up to and including it (`cum_name`).
    """
    return accumulate(value_totals(df, value, sums, by), value, list(sums), by, descending)


def accumulate(totals: DataFrame, value: str, names: list[str], by: list[str] | None = None,
               descending: bool = False) -> DataFrame:
    """Running sums of a table with one row per distinct `value` within `by`.

    Sums go up the tree of buckets; what lies before a bucket comes down it,
    one join per level on the parent bucket.
    """
    by = by or []
    sign = -1 if descending else 1
    base = totals.withColumn("_b0", leaf_bucket(sign * F.col(value)))

    def roll(child: DataFrame, level: int) -> DataFrame:
        return (child.withColumn(f"_b{level}", parent(F.col(f"_b{level - 1}")))
                .groupBy(*by, f"_b{level}").agg(*[F.sum(n).alias(n) for n in names]))

    leaves = base.groupBy(*by, "_b0").agg(*[F.sum(n).alias(n) for n in names])
    levels = [leaves]
    for level in range(1, TOP + 1):
        levels.append(roll(levels[-1], level))

    def before(rows: DataFrame, within: list[str], order: Column, keys: list[str],
               above: DataFrame | None) -> DataFrame:
        """Sums over everything that sorts before each row."""
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        local = rows.withColumns({
            f"_o_{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
        if above is None:
            return local.select(*keys, *[f"_o_{n}" for n in names])
        ahead = above.select(*within, *[F.col(f"_o_{n}").alias(f"_a_{n}") for n in names])
        joined = _join(local, ahead, within)
        return joined.select(*keys, *[(F.col(f"_o_{n}") + F.col(f"_a_{n}")).alias(f"_o_{n}")
                                      for n in names])

    offsets = before(levels[TOP], by, F.col(f"_b{TOP}"), [*by, f"_b{TOP}"], None)
    for level in reversed(range(TOP)):
        rows = levels[level].withColumn(f"_b{level + 1}", parent(F.col(f"_b{level}")))
        offsets = before(rows, [*by, f"_b{level + 1}"], F.col(f"_b{level}"),
                         [*by, f"_b{level}"], offsets)

    order = F.col(value).desc() if descending else F.col(value)
    last = before(base, [*by, "_b0"], order, [*by, value, *names], offsets)
    return last.select(*by, value, *names,
                       *[(F.col(f"_o_{n}") + F.col(n)).alias(f"cum_{n}") for n in names])


def positions(df: DataFrame, value: str, by: list[str] | None = None,
              name: str = "position") -> DataFrame:
    """Place of each distinct non-null `value` (of any sortable type) within `by`, from 0.

    The distinct values are dealt out by range; a place is that within the range plus the sizes
    of the ranges before. No window holds more than a range, or a row per range.
    """
    by = by or []
    dealt = materialise(
        df.where(F.col(value).isNotNull()).select(*by, value).distinct()
        .repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = dealt.withColumn("_at", F.row_number().over(
        Window.partitionBy(*by, "_range").orderBy(value)))
    return _join(local, starts.drop("_n"), [*by, "_range"]).select(
        *by, value, (F.col("_start") + F.col("_at") - 1).cast("bigint").alias(name))


def rank_rows(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Rank by `value`, highest first, ties sharing the best rank; null values have no rank.

    `df` is written out once: ranks are joined to the very values they were made from, which a
    second evaluation of a sum of doubles might miss by a bit.
    """
    df = materialise(df, "ranked")
    ranks = running_totals(df, value, {"_n": F.lit(1)}, descending=True)
    ranks = ranks.select(F.col(value).alias("_v"),
                         (F.col("cum__n") - F.col("_n") + 1).alias(name))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles of `columns` within `by`.

    Result: `by`, `metric`, `probability`, `value`. Nulls and NaN are ignored.

    The first pass counts rows per bucket and finds the bucket each wanted
    rank lies in. The second pass keeps the rows of those buckets only and
    counts them per distinct value. Both passes combine before they shuffle;
    both results are written out, so their real size decides how the next step
    joins them. The search then goes down the levels of the counted values.
    Columns of a small integer type have few values, so one pass counts them all.
    """
    by = by or []
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in columns]))
    long = (df.select(*by, pairs.alias("p")).select(*by, "p.metric", "p.value")
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
            .withColumn("_b0", leaf_bucket(F.col("value"))))
    group = [*by, "metric"]

    def locate(hist: DataFrame, within: list[str], bucket: str) -> DataFrame:
        w = (Window.partitionBy(*within).orderBy(bucket)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return hist.withColumn("_end", F.sum("_n").over(w)).withColumn(
            "_start", F.col("_end") - F.col("_n"))

    hit = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))

    first, top = f"_b{HISTOGRAM}", f"_b{TOP}"
    marked = long.withColumn(first, parent(F.col("_b0"), HISTOGRAM))
    one, types = F.count(F.lit(1)).alias("_n"), dict(df.dtypes)
    few_values = all(types[c] in ("int", "smallint", "tinyint") for c in columns)
    if few_values:
        counts = materialise(marked.groupBy(*group, first, "_b0", "value").agg(one),
                             "quantile-values")
        hist = counts.groupBy(*group, first).agg(F.sum("_n").alias("_n"))
    else:
        hist = materialise(marked.groupBy(*group, first).agg(one), "quantile-histogram")
    hist = hist.withColumn(top, parent(F.col(first), TOP - HISTOGRAM))
    last = F.sum("_n").over(Window.partitionBy(*group)) - 1
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = F.col("probability") * F.col("_last")
    rank_inside = (F.col("_rank") - F.col("_start")).alias("_rank")
    picks = (locate(hist.groupBy(*group, top).agg(F.sum("_n").alias("_n")), group, top)
             .withColumn("_last", last)
             .withColumn("probability", wanted)
             .withColumn("_weight", position - F.floor(position))
             .withColumn("_rank", F.explode(F.array_distinct(
                 F.array(F.floor(position), F.ceil(position)))))
             .where(hit).select(*group, "probability", "_weight", rank_inside, top))

    def descend(picks: DataFrame, hist: DataFrame, up: str, here: str) -> DataFrame:
        return (_join(locate(hist, [*group, up], here), picks, [*group, up]).where(hit)
                .select(*group, "probability", "_weight", rank_inside, here))

    picks = materialise(descend(picks, hist, top, first), "quantile-buckets")
    if not few_values:
        rows = _join(marked, picks.select(*group, first).distinct(), [*group, first], "left_semi")
        counts = materialise(rows.groupBy(*group, first, "_b0", "value").agg(one),
                             "quantile-values")
    for level in reversed(range(HISTOGRAM)):
        up, here = f"_b{level + 1}", f"_b{level}"
        smaller = (counts.select(*group, parent(F.col("_b0"), level + 1).alias(up),
                                 parent(F.col("_b0"), level).alias(here), "_n")
                   .groupBy(*group, up, here).agg(F.sum("_n").alias("_n")))
        picks = descend(picks, smaller, up, here)

    found = _join(locate(counts, [*group, "_b0"], "value"), picks, [*group, "_b0"]).where(hit)
    low, high = F.min("value"), F.max("value")
    return (found.groupBy(*group, "probability")
            .agg((low + (high - low) * F.max("_weight")).alias("value")))


def exact_median(df: DataFrame, column: str, by: list[str] | None = None,
                 name: str = "median") -> DataFrame:
    by = by or []
    return exact_quantiles(df, [column], [0.5], by).select(*by, F.col("value").alias(name))


def area_under_curve(df: DataFrame, score: str, positive: Column,
                     by: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC: the share of (positive, negative) pairs ranked rightly.

    Ties count half. Pairs are counted level by level: pairs that differ in
    the lowest bucket only, then pairs that first differ one level up, and so
    on, so no rank over all scores is needed. Null with only one class. The lower levels, which
    have about as many rows as there are scores, run at once in small tasks.
    """
    by = by or []
    pos = F.sum(F.when(positive, 1.0).otherwise(0.0))
    neg = F.sum(F.when(positive, 0.0).otherwise(1.0))
    rows = (df.where(F.col(score).isNotNull())
            .groupBy(*by, F.col(score).alias("_key")).agg(pos.alias("_p"), neg.alias("_q"))
            .withColumn("_up", leaf_bucket(F.col("_key")))
            .withColumn("_pairs", F.col("_p") * F.col("_q") / 2))
    for level in range(TOP + 2):
        within = [*by, "_up"] if level <= TOP else by
        w = (Window.partitionBy(*within).orderBy("_key")
             .rowsBetween(Window.unboundedPreceding, -1))
        counted = rows.withColumn(
            "_pairs", F.col("_pairs") + F.col("_p") * F.coalesce(F.sum("_q").over(w), F.lit(0.0)))
        sums = [F.sum(c).alias(c) for c in ("_p", "_q", "_pairs")]
        if level <= TOP:
            rows = (counted.groupBy(*within).agg(*sums)
                    .withColumnRenamed("_up", "_key")
                    .withColumn("_up", parent(F.col("_key"))))
            if level == HISTOGRAM:
                with settings(df.sparkSession, SMALL):
                    rows = materialise(rows, "pairs")
        else:
            rows = counted.groupBy(*by).agg(*sums)
    auc = F.col("_pairs") / F.nullif(F.col("_p") * F.col("_q"), F.lit(0.0))
    return rows.select(*by, F.col("_p").cast("bigint").alias("positives"),
                       F.col("_q").cast("bigint").alias("negatives"), auc.alias("auc"))
