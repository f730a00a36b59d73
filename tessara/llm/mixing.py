"""Mixing sources to target weights, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessara.llm.common import md5_fraction, n_words, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources. sizes: source, source_key, source_size.

    Sources by code point, null last, get the weights in turn and share `share` times all sizes; none gets over `cap`
    times its own size, and what lies above goes to the others by weight until none is above. In order of
    cap * size / weight the capped ones come first, so one running sum finds the level that all others reach.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    own = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place))
    own = own.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    own = own.withColumn("reach", F.col("limit") / F.col("weight"))
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    own = own.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "all_weights": F.sum("weight").over(everything),
        "limits_before": F.coalesce(F.sum("limit").over(by_reach), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(by_reach), F.lit(0.0)),
    })
    own = own.withColumn("level", (F.col("budget") - F.col("limits_before")) / (F.col("all_weights") - F.col("weights_before")))
    own = own.withColumn("first", F.max(F.when(F.col("reach") > F.col("level"), F.struct(-F.col("reach"), F.col("level").alias("level")))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("limit")))
    return own.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """How often the mix takes each document.

    Every document of a source has the same expected copies, target / size. Within the source, documents stand in order
    of size class, salt, size and id; their expected copies are summed up along that order, one offset in [0, 1) that
    depends on seed and source is added, and a document is taken once for each integer that its stretch crosses. As the
    order follows size, the words taken come within about one of the largest documents of the target.

    The place of a document comes in two steps, so no task holds a source: the number of documents in the earlier
    (size class, salt) buckets of its source, from one small count per bucket, and its place in its own bucket.

    Returns a row per row of docs: doc_id, size, source_size, target, copies, taken; with keep, the columns of docs too,
    as struct `row`. Null text: size 0. Null sources are one source, the last. A null id is salted by its text. Repeated
    rows are documents of their own. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))
    salt = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), 1, 2)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("source_key"), salt.alias("salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.inline(F.array(F.struct(n_words(F.col(text_col)).alias("size")))))
    bits = F.length(F.bin("size"))
    rows = rows.withColumn("class", F.when(F.col("size") < 8, F.col("size")).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4)") % 8))
    sized = written(rows.drop("row"), "mix-sizes")
    buckets = sized.groupBy("source_key", "source", "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    buckets = written(buckets, "mix-buckets")
    targets = source_targets(buckets.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    along = Window.partitionBy("source_key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select("source_key", "class", "salt", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    start = before.join(targets, "source_key")
    own = Window.partitionBy("source_key", "class", "salt").orderBy("size", "doc_id")
    placed = (rows if keep else sized).withColumn("own", F.row_number().over(own)).join(start, ["source_key", "class", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = md5_fraction(F.concat(F.lit(f"{seed}:"), F.col("source_key")))
    placed = placed.withColumns({"place": F.col("before") + F.col("own"), "rate": rate, "offset": offset})
    copies = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as often as it does, with the columns of docs. Options as for mix()."""
    taken = mix(docs, keep=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS source_key,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 2) AS salt,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::INT) % 8 END AS class FROM d),
s AS (
  SELECT source_key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source_key),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         source_size * 2.0::DOUBLE AS lim FROM s),
r AS (
  SELECT *, lim / weight AS reach, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weights,
         coalesce(sum(lim) OVER p, 0) AS limits_before, coalesce(sum(weight) OVER p, 0) AS weights_before
  FROM w WINDOW p AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - limits_before) / (all_weights - weights_before) AS level FROM r),
f AS (SELECT arg_min(level, reach) AS level FROM l WHERE reach > level),
t AS (
  SELECT l.source_key, source_size, least(lim, coalesce((SELECT level FROM f) * weight, lim)) AS target,
         CAST(CAST('0x' || substr(md5('17:' || l.source_key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM l),
p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY c.source_key ORDER BY class, salt, size, doc_id) AS place
  FROM c JOIN t USING (source_key)),
k AS (SELECT *, CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM k
"""
