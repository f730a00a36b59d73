"""Rankings: best and second best, thresholds relative to the best, top-k and slots kept for some lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessara.operators.sizes import small


def best_two(df: DataFrame, by: list[str], order: list[Column], score: str, into: str = "second") -> DataFrame:
    """The best row of each group with the score of the second (null if it is alone). The two come from a bounded
    aggregate, so a group of any size is combined before rows move."""
    named = df.withColumn("__all", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    ranked = named.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # Spark limits each map task's rows of a group to the two best before the shuffle (window group limit).
    top = ranked.where("__rank <= 2").groupBy(*by).agg(
        F.max(F.when(F.col("__rank") == 1, F.col("__all"))).alias("__best"),
        F.max(F.when(F.col("__rank") == 2, F.col(score))).alias(into),
    )
    return top.select("__best.*", into)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def max_relative(df: DataFrame, by: list[str], value: str, factor: float, strict: bool = False) -> DataFrame:
    """Rows whose value is at least (strict: above) int(factor * the group's largest). The largest is aggregated and joined
    back, so a hot group isn't gathered; where groups are few, by a broadcast, so that rows stay where they are."""
    least = df.groupBy(*by).agg(F.floor(F.max(value) * F.lit(factor)).alias("__least"))
    kept = df.join(small(least, 200_000), by)
    return kept.where(F.col(value) > F.col("__least") if strict else F.col(value) >= F.col("__least")).drop("__least")


def reserved_top_k(df: DataFrame, query: list[str], k: int, located: bool, has_lost: bool, score: str = "score", id_col: str = "ref") -> DataFrame:
    """The k best of the merged lists of a query, column `lost` telling the list of rows.

    located false: the first two places go to the best rows that aren't lost; located and has_lost: the first place goes
    to the best lost row; the rest by score. Ties by id."""
    order = [F.desc(score), F.col(id_col)]
    own = F.row_number().over(Window.partitionBy(*query, "lost").orderBy(*order))
    first = (~F.col("lost") & (own <= 2)) if not located else (F.col("lost") & (own <= 1)) if has_lost else F.lit(False)
    ranked = df.withColumn("reserved", first)
    return top_k(ranked, query, [F.desc("reserved"), *order], k)


def first_by_id(df: DataFrame, query: list[str], last: DataFrame, k: int, min_score: float, id_col: str = "ref") -> DataFrame:
    """The query's rows in `last`, which always count, and then rows of score min_score or more by ascending id, k in
    all."""
    always = last.select(*query, id_col).distinct()
    fixed = always.groupBy(*query).agg(F.count(F.lit(1)).alias("__n"))
    rest = df.where(F.col("score") >= min_score).join(always, [*query, id_col], "left_anti").select(*query, id_col).distinct()
    rest = top_k(rest, query, [F.col(id_col)], k, "__rank").join(fixed, query, "left").where(F.col("__rank") <= k - F.coalesce("__n", F.lit(0)))
    return always.withColumn("place", F.lit(0)).unionByName(rest.select(*query, id_col, F.col("__rank").alias("place")))


def votes_top_k(votes: DataFrame, query: list[str], last: Column, k: int, node: str = "node", n: str = "n") -> DataFrame:
    """k nodes of a query by votes; where `last` is true the node comes first whatever its votes."""
    return top_k(votes.withColumn("__last", last), query, [F.desc("__last"), F.desc(n), F.col(node)], k).drop("__last")


def reindexed(df: DataFrame, by: list[str], order: list[Column], into: str = "index") -> DataFrame:
    """Dense places from 0 of each group's rows."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def count_chunks(df: DataFrame, by: list[str], order: list[Column], size: int, into: str = "chunk") -> DataFrame:
    return reindexed(df, by, order, "__i").withColumn(into, F.floor(F.col("__i") / size)).drop("__i")


def gap_segments(df: DataFrame, by: list[str], stamp: str, factor: float = 2.0, into: str = "segment") -> DataFrame:
    """Numbers of stretches in order of the stamp; a new one starts where the step is at least factor times the median
    step of the group."""
    from tessara.operators import aggs

    along = Window.partitionBy(*by).orderBy(stamp)
    steps = df.withColumn("__step", F.col(stamp) - F.lag(stamp).over(along))
    usual = aggs.medians(steps, by, "__step", "__usual")
    cut = F.when(F.col("__step") >= factor * F.col("__usual"), 1).otherwise(0)
    joined = steps.join(usual, by, "left").withColumn("__cut", cut)
    return joined.withColumn(into, F.sum("__cut").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("__step", "__usual", "__cut")


def circular_smooth(df: DataFrame, by: list[str], bin_col: str, value: str, bins: int, rounds: int = 1) -> DataFrame:
    """Rounds of a mean over each bin and its two neighbours in a ring of `bins` bins, absent ones zero."""
    ring = df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(bin_col, value))).alias("__m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0)))

    def once(v: Column, _: Column) -> Column:
        return F.transform(v, lambda x, i: (F.get(v, (i + bins - 1) % bins) + x + F.get(v, (i + 1) % bins)) / 3)

    smooth = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, once) if rounds else values
    ring = ring.withColumn("__v", smooth)
    return ring.select(*by, F.posexplode("__v").alias(bin_col, value))


def histogram_peaks(df: DataFrame, by: list[str], bin_col: str, value: str, bins: int, share: float = 0.8) -> DataFrame:
    """Bins above both neighbours and `share` of the largest, with the offset of the parabola through the three."""
    ring = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(bin_col, value))), lambda s: s[value]).alias("__v"))
    top = F.array_max("__v")
    peaks = ring.select(*by, top.alias("__top"), "__v", F.posexplode("__v").alias(bin_col, value))
    before = F.get("__v", ((F.col(bin_col) + bins - 1) % bins).cast("int"))
    after = F.get("__v", ((F.col(bin_col) + 1) % bins).cast("int"))
    offset = (after - before) / (2 * (2 * F.col(value) - before - after))
    kept = peaks.where((F.col(value) > before) & (F.col(value) > after) & (F.col(value) > share * F.col("__top")))
    return kept.select(*by, bin_col, value, offset.alias("offset"))


def top_bins(df: DataFrame, by: list[str], bin_col: str, keep: int = 3, share: float = 0.1) -> DataFrame:
    """The `keep` fullest bins of each group with their count; all after the first only if they reach `share` of it. Ties
    to the smaller bin."""
    counted = df.groupBy(*by, bin_col).agg(F.count(F.lit(1)).alias("n"))
    ranked = top_k(counted, by, [F.desc("n"), F.col(bin_col)], keep)
    first = Window.partitionBy(*by)
    return ranked.withColumn("__top", F.max("n").over(first)).where(F.col("n") >= share * F.col("__top")).drop("__top")
