"""Named queries on the driver's tables, and the same in DuckDB's SQL.

How tables stand in: embeddings are unit descriptors, those with even vec_id one frame and those with odd the other;
documents are images as bags of words, benchmark items query images; events are stamped samples; lineitem rows are
points, pixels and voxel observations. Each query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessara.functions import camera as C
from tessara.functions import numbers as N
from tessara.functions import strings as T
from tessara.functions import vectors as V
from tessara.operators import aggs, estimate, features, fusion, graph, joins, registration, topk
from tessara.operators import solvers as S
from tessara.operators.sizes import small, stored
from tessara.sources import frames as sources
from tessara.streaming import chunker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# descriptors


def frames_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    left = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("l_id"), F.col("v").alias("l_vec"))
    right = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("r_id"), F.col("v").alias("r_vec"))
    return left, right


SCORES = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT l.vec_id AS l_id, r.vec_id AS r_id, list_dot_product(l.v, r.v) AS score FROM e l JOIN e r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
lr AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS k, lead(score) OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS second FROM d),
rl AS (SELECT *, row_number() OVER (PARTITION BY r_id ORDER BY score DESC, l_id) AS k, lead(score) OVER (PARTITION BY r_id ORDER BY score DESC, l_id) AS second FROM d)
"""


@query(SCORES + """
SELECT a.l_id, a.r_id, round(a.score, 6) AS score
FROM (SELECT * FROM lr WHERE k = 1 AND (second IS NULL OR acos(least(score, 1)) < 0.99 * acos(least(second, 1)))) a
JOIN (SELECT * FROM rl WHERE k = 1 AND (second IS NULL OR acos(least(score, 1)) < 0.99 * acos(least(second, 1)))) b USING (l_id, r_id)""")
def nn_ratio_mutual(spark, sf_dir):
    return rounded(joins.nearest(*frames_of(spark, sf_dir), ratio=0.99, max_angle=None))


@query(SCORES + "SELECT l_id, r_id, round(score, 6) AS score, round(second, 6) AS second FROM lr WHERE k = 1")
def nn_top2(spark, sf_dir):
    tops = joins.block_tops(*frames_of(spark, sf_dir)).where("side = 'l'").select("l_id", "r_id", "score")
    return rounded(topk.best_two(tops, ["l_id"], [F.desc("score"), F.col("r_id")], "score"))


@query(SCORES + "SELECT l_id, r_id, round(score, 6) AS score FROM lr WHERE k = 1 AND acos(least(score, 1)) < 1.25")
def nn_one_way_angle(spark, sf_dir):
    return rounded(joins.nearest(*frames_of(spark, sf_dir), ratio=1e9, max_angle=1.25, mutual=False))


@query("""
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_max(q) AS INT) AS top
FROM (SELECT vec_id, list_transform(a, lambda x: least(255, round(512 * sqrt(x / s)))) AS q
      FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS s FROM embeddings))""")
def l1root_descriptor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", features.l1_root(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("q"))
    return e.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("q").alias("top"))


@query("""
SELECT vec_id, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS norm, round(list_max(c), 6) AS top
FROM (SELECT vec_id, list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))) AS c
      FROM (SELECT vec_id, list_transform(v, lambda x: least(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 0.2)) AS b
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))""")
def clamped_descriptor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", features.clamped_unit(F.transform("embedding", lambda x: x.cast("double"))).alias("c"))
    return rounded(e.select("vec_id", V.dot(F.col("c"), F.col("c")).alias("norm"), F.array_max("c").alias("top")))


BINNED = "(SELECT l_returnflag, CAST(round((CASE WHEN l_quantity * 7.2 - 180 < 0 THEN l_quantity * 7.2 + 180 ELSE l_quantity * 7.2 - 180 END) / 30) AS INT) % 30 AS bin FROM lineitem)"


@query(f"""
WITH c AS (SELECT l_returnflag, bin, count(*) AS n FROM {BINNED} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, bin) AS rank, max(n) OVER (PARTITION BY l_returnflag) AS top FROM c)
SELECT l_returnflag, bin, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3 AND n >= 0.1 * top""")
def orientation_bins(spark, sf_dir):
    d = F.col("l_quantity") * 7.2 - 180
    turn = F.when(d < 0, d + 360).otherwise(d)
    binned = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.round(turn / 30) % 30).cast("int").alias("bin"))
    return topk.top_bins(binned, ["l_returnflag"], "bin")


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(round((CASE WHEN l_quantity * 7.2 - 180 < 0 THEN l_quantity * 7.2 + 180 ELSE l_quantity * 7.2 - 180 END) / 30) AS INT) % 30 AS bin FROM lineitem),
c AS (SELECT l_returnflag, bin, count(*) AS n FROM b GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, bin) AS rank, max(n) OVER (PARTITION BY l_returnflag) AS top FROM c)
SELECT b.l_returnflag, count(*) AS kept FROM b JOIN r USING (l_returnflag, bin) WHERE rank <= 3 AND n >= 0.1 * top GROUP BY 1""")
def orientation_consistent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    kept = joins.orientation_consistent(rows, ["l_returnflag"], F.col("l_quantity") * 7.2 - 180)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))


# bags of words


def postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return joins.postings_of(table(spark, sf_dir, "benchmark"), "item_id", "query"), joins.postings_of(table(spark, sf_dir, "documents"), "doc_id", "ref")


def scored_pairs(spark: SparkSession, sf_dir: str, factor: float | None = None) -> DataFrame:
    """Pairs with the scores that queries compare, those that share at least int(factor * the query's most) words."""
    found = joins.bag_matches(*postings(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return found if factor is None else topk.max_relative(found, ["query"], "n", factor)


BAGS = """
WITH q AS (SELECT item_id AS query, w AS word, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1, 2),
r AS (SELECT doc_id AS ref, w AS word, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2),
n AS (SELECT query, ref, count(*) AS n FROM q JOIN r USING (word) WHERE query <> ref GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY query) AS top FROM n) WHERE n >= floor({0} * top)),
nq AS (SELECT query, sqrt(sum(weight * weight)) AS nq FROM q GROUP BY 1), nr AS (SELECT ref, sqrt(sum(weight * weight)) AS nr FROM r GROUP BY 1),
s AS (SELECT query, ref, any_value(c.n) AS n, sum(q.weight * r.weight) / any_value(nq) / any_value(nr) AS score
      FROM c JOIN q USING (query) JOIN r USING (ref, word) JOIN nq USING (query) JOIN nr USING (ref) GROUP BY 1, 2)
"""


@query(BAGS.format(0) + "SELECT query, ref, n FROM n")
def bow_shared_words(spark, sf_dir):
    q, r = postings(spark, sf_dir)
    return joins.shared_words(q, r).where("query != ref")


@query(BAGS.format("0.6::DOUBLE") + "SELECT query, ref, n FROM c")
def bow_candidates_60(spark, sf_dir):
    q, r = postings(spark, sf_dir)
    return topk.max_relative(joins.shared_words(q, r).where("query != ref"), ["query"], "n", 0.6)


@query(BAGS.format("0.6::DOUBLE") + ", k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, ref) AS rank FROM s) SELECT query, ref, n, round(round(score, 9), 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def bow_topk(spark, sf_dir):
    return rounded(topk.top_k(scored_pairs(spark, sf_dir, 0.6), ["query"], [F.desc("score"), F.col("ref")], 10))


COVISIBLE = """, v AS (SELECT doc_id AS ref, unnest([lag(doc_id) OVER w, lead(doc_id) OVER w]) AS co FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
cv AS (SELECT ref, co FROM v WHERE co IS NOT NULL)"""


@query(BAGS.format("0.8::DOUBLE").replace("n >= floor", "n > floor") + COVISIBLE + """,
h AS (SELECT query, ref, score FROM s WHERE score >= 0.2),
g AS (SELECT h.query, h.ref, sum(s.score) AS more, max(s.score) AS top, arg_max(cv.co, (round(s.score, 12), -cv.co)) AS best
      FROM h JOIN cv USING (ref) JOIN s ON s.query = h.query AND s.ref = cv.co GROUP BY 1, 2),
f AS (SELECT h.query, h.ref, score + coalesce(more, 0) AS total, CASE WHEN top > score THEN best ELSE h.ref END AS view FROM h LEFT JOIN g USING (query, ref)),
b AS (SELECT query, greatest(max(total), 0.2) AS best FROM f GROUP BY 1),
k AS (SELECT DISTINCT f.query, view AS ref FROM f JOIN b USING (query) WHERE total > 0.75 * b.best)
SELECT k.query, k.ref, round(s.score, 6) AS score FROM k JOIN s USING (query, ref)""")
def overlap_covisible(spark, sf_dir):
    q, r = postings(spark, sf_dir)
    w = Window.partitionBy("source").orderBy("doc_id")
    near = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.array(F.lag("doc_id").over(w), F.lead("doc_id").over(w)).alias("cs"))
    near = near.select("ref", F.explode("cs").alias("co"))
    return rounded(joins.overlapping(q, r, near.where("co IS NOT NULL"), 0.2))


@query(BAGS.format(0) + """,
p AS (SELECT source, ref, query AS cur, n, score FROM s JOIN documents ON doc_id = ref),
m AS (SELECT *, max(n) OVER (PARTITION BY source) AS top FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, ref, cur) AS i FROM m WHERE n >= floor(0.6::DOUBLE * top))
SELECT source, ref, cur, n, round(score, 6) AS score FROM k WHERE i = 1""")
def best_pair(spark, sf_dir):
    by = scored_pairs(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "source"), "ref").withColumnRenamed("query", "cur")
    return rounded(joins.best_pair(by, ["source"]))


@query(BAGS.format("0.6::DOUBLE") + """, p AS (SELECT query, source AS node, ref, query AS cur, score FROM s JOIN documents ON doc_id = ref)
SELECT query, node, count(DISTINCT cur) AS n, round(max(round(score, 9)), 6) AS score, arg_max(ref, (round(score, 9), -cur, -ref)) AS ref, arg_max(cur, (round(score, 9), -cur, -ref)) AS cur FROM p GROUP BY 1, 2""")
def votes(spark, sf_dir):
    c = scored_pairs(spark, sf_dir, 0.6).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.col("source").alias("node")), "ref").withColumn("cur", F.col("query"))
    return rounded(aggs.votes(c, ["query"]))


@query(BAGS.format("0.6::DOUBLE") + """, p AS (SELECT query, ref, round(score, 9) AS score, ref % 3 = 0 AS lost FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query, lost ORDER BY score DESC, ref) AS own FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (lost AND own <= 1) DESC, score DESC, ref) AS rank FROM o)
SELECT query, ref, lost, round(score, 6) AS score, lost AND own <= 1 AS reserved, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""")
def reserved_top_k(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir, 0.6).select("query", "ref", "score", (F.col("ref") % 3 == 0).alias("lost"))
    return rounded(topk.reserved_top_k(scored, ["query"], 10, located=True, has_lost=True))


@query(BAGS.format(0) + """, a AS (SELECT w.query, w.word, t / total * ln((SELECT count(DISTINCT item_id) FROM benchmark) / df) AS weight
  FROM (SELECT query, word, weight AS t FROM q) w JOIN (SELECT query, sum(weight) AS total FROM q GROUP BY 1) USING (query) JOIN (SELECT word, count(*) AS df FROM q GROUP BY 1) USING (word)),
b AS (SELECT * FROM a WHERE weight > 0)
SELECT query, count(*) AS words, round(max(weight / total), 6) AS top FROM b JOIN (SELECT query, sum(weight) AS total FROM b GROUP BY 1) USING (query) GROUP BY 1""")
def bag_weights(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image"), F.explode(F.split("text", " ")).alias("word")).where("word != ''")
    b = features.bag_of_words(w).groupBy(F.col("image").alias("query")).agg(F.count(F.lit(1)).alias("words"), F.max("weight").alias("top"))
    return rounded(b)


# time


def stamps(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy(micros().alias(name)).agg(F.max_by("value", "event_id").alias(f"v_{name}"))


STAMPS = """
WITH a AS (SELECT epoch_us(ts) AS a, arg_max(value, event_id) AS va FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT epoch_us(ts) AS b, arg_max(value, event_id) AS vb FROM events WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT a, b, CAST(abs(a - b) AS DOUBLE) AS delta, abs(va - vb) AS error FROM a JOIN b ON a - b > -600000000::BIGINT AND a - b < 600000000::BIGINT)
"""


@query(STAMPS + "SELECT a, b, delta FROM c")
def time_candidates(spark, sf_dir):
    a, b = stamps(spark, sf_dir, "click", "a").select("a"), stamps(spark, sf_dir, "purchase", "b").select("b")
    return joins.time_candidates(a, b, 600e6).withColumn("delta", F.col("delta").cast("double"))


@query(STAMPS.replace("WITH a", "WITH RECURSIVE a") + """,
r(a, b, delta, taken) AS (
  SELECT a, b, delta, row_number() OVER (PARTITION BY a ORDER BY delta, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY delta, a) = 1 FROM c
  UNION ALL
  SELECT a, b, delta, row_number() OVER (PARTITION BY a ORDER BY delta, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY delta, a) = 1
  FROM (SELECT *, bool_or(taken) OVER (PARTITION BY a) AS has_a, bool_or(taken) OVER (PARTITION BY b) AS has_b FROM r) WHERE NOT has_a AND NOT has_b)
SELECT a, b, delta FROM r WHERE taken""")
def time_associate(spark, sf_dir):
    return joins.time_associate(stamps(spark, sf_dir, "click", "a"), stamps(spark, sf_dir, "purchase", "b"), 600e6)


@query(STAMPS + """SELECT count(*) AS pairs, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(stddev_pop(error), 6) AS std,
round(min(error), 6) AS min, arg_min(a, (error, a)) AS min_stamp, round(max(error), 6) AS max, arg_max(a, (error, -a)) AS max_stamp FROM c""")
def ate_metrics(spark, sf_dir):
    a, b = stamps(spark, sf_dir, "click", "a"), stamps(spark, sf_dir, "purchase", "b")
    pairs = joins.time_candidates(a, b, 600e6).withColumn("error", F.abs(F.col("v_a") - F.col("v_b")))
    return rounded(aggs.ate_metrics(pairs, [], stamp="a"))


@query()
def trajectory_ate(spark, sf_dir):
    def trajectory(kind: str) -> DataFrame:
        e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        return e.groupBy((micros() / 1e6).alias("stamp")).agg(F.max_by("value", "event_id").alias("tx"), F.max_by("user_id", "event_id").cast("double").alias("ty"), F.max_by(F.col("event_id") % 97, "event_id").cast("double").alias("tz"))

    return registration.evaluate_trajectory(trajectory("click"), trajectory("purchase"), 7200)[1]


@query("""
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS step FROM events),
m AS (SELECT user_id, median(step) AS usual FROM s GROUP BY 1)
SELECT user_id, count(*) AS rows, CAST(sum(CASE WHEN step >= 2 * usual THEN 1 ELSE 0 END) AS BIGINT) AS last_segment FROM s JOIN m USING (user_id) GROUP BY 1""")
def gap_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct(micros().alias("t"), "event_id").alias("k"), micros().alias("t"))
    cut = topk.gap_segments(e.select("user_id", "t"), ["user_id"], "t")
    return cut.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.max("segment").alias("last_segment"))


@query("SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 10) AS BIGINT) AS chunk FROM events")
def count_chunks(spark, sf_dir):
    return topk.count_chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 10)


@query()
def span_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sequence"), F.col("event_id").alias("frame_id"), (F.floor("value") % 40).cast("long").alias("n_keypoints"))
    return chunker.chunks(chunker.indexed(e).withColumn("links", F.col("n_keypoints")), 30, 600)


@query("SELECT CAST(user_id AS VARCHAR) AS sequence, frame_index FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 40 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index FROM events) WHERE k > 0")
def indexed_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sequence"), F.col("event_id").alias("frame_id"), (F.floor("value") % 40).cast("long").alias("n_keypoints"))
    return chunker.indexed(e).select("sequence", "frame_index")


@query("SELECT user_id, event_id AS i, j FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS j FROM events) WHERE j IS NOT NULL")
def pair_schedule(spark, sf_dir):
    return joins.schedule(table(spark, sf_dir, "events"), ["user_id"], "event_id")


@query("SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber")
def pair_schedule_full(spark, sf_dir):
    return joins.schedule(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", full=True)


# grids and aggregates


@query("""
SELECT c_custkey, s_suppkey FROM customer JOIN supplier
ON abs(c_nationkey - s_nationkey) < 1 AND abs(c_acctbal / 1000 - s_acctbal / 1000) < 1""")
def range_join_area(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("cx"), (F.col("c_acctbal") / 1000).alias("cy"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("sx"), (F.col("s_acctbal") / 1000).alias("sy"))
    return joins.range_join(left, right, ("cx", "sx"), ("cy", "sy"), 1.0).select("c_custkey", "s_suppkey")


POINTS = "(SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity, l_extendedprice, l_discount, floor(l_quantity / 5) AS gx, floor(l_extendedprice / 10000) AS gy FROM lineitem)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount")


@query(f"SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, arg_min(id, (l_discount, id)) AS id, arg_min(l_quantity, (l_discount, id)) AS l_quantity FROM {POINTS} GROUP BY 1, 2")
def grid_argmin(spark, sf_dir):
    return aggs.grid_argmin(points(spark, sf_dir), [], "l_quantity", "l_extendedprice", F.col("l_discount"), 5, 10000).select("gx", "gy", "id", "l_quantity")


@query(f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY gx, gy) AS cell, count(*) OVER () AS total, row_number() OVER (PARTITION BY gx, gy ORDER BY l_discount, id) AS k FROM {POINTS})
SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, id FROM r WHERE k <= floor(1000 * CAST(cell AS DOUBLE) / total)""")
def cell_proportional_topk(spark, sf_dir):
    return aggs.cell_proportional(points(spark, sf_dir), [], "l_quantity", "l_extendedprice", F.col("l_discount"), 5, 1000, 10000).select("gx", "gy", "id")


@query("""
SELECT user_id, day, CASE WHEN m BETWEEN 5 AND 80 THEN m ELSE 0 END AS median
FROM (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM events GROUP BY 1, 2)""")
def upper_median(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return aggs.upper_medians(e, ["user_id", "day"], "value", 5, 80)


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS std_dev,
       max(CASE WHEN i = round(0.05::DOUBLE * (n - 1)) THEN value END) AS p5, max(CASE WHEN i = round(0.95::DOUBLE * (n - 1)) THEN value END) AS p95 FROM s GROUP BY 1""")
def robust_stats(spark, sf_dir):
    return rounded(aggs.robust_stats(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("""
SELECT l_returnflag, count(*) AS n, round(covar_pop(l_quantity, l_extendedprice / 1000) * count(*), 3) AS w00, round(covar_pop(l_quantity, l_linenumber) * count(*), 3) AS w01,
       round(covar_pop(l_discount, l_extendedprice / 1000) * count(*), 3) AS w10, round(covar_pop(l_tax, l_tax) * count(*), 3) AS w22 FROM lineitem GROUP BY 1""")
def kabsch_moments(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumns({"dx": F.col("l_extendedprice") / 1000, "dy": F.col("l_linenumber").cast("double"), "dz": F.col("l_tax")})
    m = aggs.cross_moments(d, ["l_returnflag"], ("l_quantity", "l_discount", "l_tax"), ("dx", "dy", "dz"))
    return rounded(m.select("l_returnflag", "n", *[F.col("w")[k].alias(f"w{k // 3}{k % 3}") for k in (0, 1, 3, 8)]), 3)


@query()
def kabsch_alignment(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumns({"dx": F.col("l_tax"), "dy": F.col("l_quantity"), "dz": F.col("l_discount")})
    return estimate.align(d, ["l_returnflag"], ("l_quantity", "l_discount", "l_tax"), ("dx", "dy", "dz"))


@query("SELECT l_suppkey, round(avg(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)), 6) AS point_weight FROM lineitem GROUP BY 1")
def point_weight(spark, sf_dir):
    return rounded(aggs.point_weight(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ("l_quantity", "l_discount", "l_tax")))


@query("SELECT l_suppkey, round(sqrt(var_pop(l_quantity) + var_pop(l_linenumber)), 6) AS rms, sqrt(var_pop(l_quantity) + var_pop(l_linenumber)) < 14.5 AS rejected FROM lineitem GROUP BY 1")
def rms_spread(spark, sf_dir):
    return rounded(aggs.rms_spread(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_linenumber", 14.5))


@query("SELECT l_suppkey, count(*) FILTER (l_discount <= 0.05) AS inliers, round(count(*) FILTER (l_discount <= 0.05) / count(*), 6) AS ratio, round(sum(CASE WHEN l_discount <= 0.05 THEN l_discount ELSE 0 END), 6) AS residual_sum FROM lineitem GROUP BY 1")
def inlier_support(spark, sf_dir):
    return rounded(aggs.support(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", 0.05))


@query("""
SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS a00, round(sum(l_quantity * l_tax), 4) AS b0, round(sum(l_tax * l_tax), 4) AS residual, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1""")
def icp_sums(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_linenumber", "l_tax", "l_discount", "l_quantity")]).alias("row"), "l_tax")
    s = aggs.icp_sums(d, ["l_returnflag"], "row", "l_tax")
    return s.select("l_returnflag", F.round(F.col("sums")[0], 2).alias("a00"), F.round(F.col("sums")[6], 4).alias("b0"), F.round(F.col("sums")[27], 4).alias("residual"), F.col("sums")[28].alias("n"))


@query("SELECT user_id, round(min(value) * 0.5, 6) AS min_score FROM events GROUP BY 1")
def min_acceptable_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("frame"), F.col("value").alias("score"))
    previous = e.groupBy("frame").agg(F.max("score").alias("score"))
    return rounded(aggs.min_acceptable_score(e, previous).withColumnRenamed("frame", "user_id"))


@query("SELECT count(*) FILTER (l_tax < 0.04) AS succeeded, count(*) FILTER (NOT l_tax < 0.04) AS failed FROM lineitem")
def registration_counts(spark, sf_dir):
    return aggs.registration_counts(table(spark, sf_dir, "lineitem"), F.col("l_tax") < 0.04)


# voxels


OBSERVED = """(SELECT l_suppkey AS vx, CAST(floor(l_quantity / 5) AS BIGINT) AS vy, l_linenumber AS vz, l_orderkey * 8 + l_linenumber AS frame_index, l_tax AS sdf, l_quantity AS w, l_returnflag, l_discount FROM lineitem)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("vx"), F.floor(F.col("l_quantity") / 5).alias("vy"), F.col("l_linenumber").alias("vz"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_index"),
        F.col("l_tax").alias("sdf"), F.col("l_quantity").cast("double").alias("weight"), "l_returnflag", F.col("l_discount").alias("r"),
    )


@query(f"SELECT vx, vy, vz, round(sum(w * sdf) / sum(w), 12) AS sdf, least(sum(w), 500) AS weight FROM {OBSERVED} GROUP BY 1, 2, 3 HAVING sum(w) > 0.001")
def voxel_merge(spark, sf_dir):
    return rounded(fusion.merge(observed(spark, sf_dir), most=500), 12)


@query(f"""
WITH o AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -w ELSE w END AS s FROM {OBSERVED})
SELECT vx, vy, vz, CASE WHEN round(sum(s * sdf) / sum(s), 12) = 0 THEN 0 ELSE round(sum(s * sdf) / sum(s), 12) END AS sdf, least(sum(s), 99999999) AS weight FROM o GROUP BY 1, 2, 3 HAVING sum(s) > 0.001""")
def voxel_deintegrate(spark, sf_dir):
    o = observed(spark, sf_dir)
    return rounded(fusion.merge(o.withColumn("weight", F.when(F.col("l_returnflag") == "R", -F.col("weight")).otherwise(F.col("weight")))), 12)


@query(f"SELECT vx, vy, vz, round(list_reduce(list(CAST(l_discount AS DOUBLE) ORDER BY frame_index, l_discount), lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b), 6) AS r FROM {OBSERVED} GROUP BY 1, 2, 3")
def voxel_colour(spark, sf_dir):
    o = observed(spark, sf_dir).withColumn("frame_index", F.struct("frame_index", "r"))
    return rounded(fusion.colour_average(o, channels=("r",)))


@query(f"""
WITH v AS (SELECT vx, vy, vz, greatest(0, sum(w) - 60) AS weight FROM {OBSERVED} GROUP BY 1, 2, 3),
b AS (SELECT *, floor(vx / 8) AS bx, floor(vy / 8) AS by_, floor(vz / 8) AS bz FROM v)
SELECT vx, vy, vz, weight FROM (SELECT *, max(weight) OVER (PARTITION BY bx, by_, bz) AS top FROM b) WHERE top <> 0""")
def block_gc(spark, sf_dir):
    v = observed(spark, sf_dir).groupBy("vx", "vy", "vz").agg(F.greatest(F.lit(0.0), F.sum("weight") - 60).alias("weight"))
    return fusion.collect_garbage(fusion.with_block(v)).select("vx", "vy", "vz", "weight")


def suppliers(spark: SparkSession, sf_dir: str, rows: int = 1000) -> DataFrame:
    """Suppliers in partitions of about `rows`: each becomes hundreds or thousands of rows, and their file is one task's."""
    s = table(spark, sf_dir, "supplier")
    return s.repartition(max(spark.sparkContext.defaultParallelism, s.count() // rows), "s_suppkey")


def solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of voxels with a sphere for each supplier, side by side, larger for a larger balance."""
    s = suppliers(spark, sf_dir).select("s_suppkey", (2 + (F.col("s_acctbal").cast("double") + 1000) / 5000).alias("radius"))
    for c in ("i", "j", "k"):
        s = s.withColumn(c, F.explode(F.sequence(F.lit(-6), F.lit(6))))
    far = F.sqrt(F.col("i") ** 2 + F.col("j") ** 2 + F.col("k") ** 2) - F.col("radius")
    x, y = 14 * (F.col("s_suppkey") % 64), 14 * F.floor(F.col("s_suppkey") / 64)
    return s.select((x + F.col("i")).cast("long").alias("vx"), (y + F.col("j")).cast("long").alias("vy"), F.col("k").cast("long").alias("vz"), (far * 0.01).alias("sdf"), F.lit(1.0).alias("weight"))


@query()
def isosurface(spark, sf_dir):
    return fusion.isosurface(solid(spark, sf_dir))


@query()
def raycast(spark, sf_dir):
    """A ray for each supplier, past its sphere's middle."""
    s = suppliers(spark, sf_dir)
    x, y = 0.14 * (F.col("s_suppkey") % 64), 0.14 * F.floor(F.col("s_suppkey") / 64)
    rays = s.select(F.col("s_suppkey").alias("ray_id"), F.array(x + (F.col("s_nationkey") - 12) * 0.002, y + 0.003, F.lit(-0.3)).alias("origin"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("direction"))
    return fusion.raycast(solid(spark, sf_dir), rays)


# graphs


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.nearest(*frames_of(spark, sf_dir), ratio=1e9, max_angle=None, mutual=False)
    return found.select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"), (1 - F.col("score")).alias("cost"))


EDGES = SCORES + ", g AS (SELECT l_id AS src, r_id AS dst, 1 - score AS cost FROM lr WHERE k = 1), u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
REACH = EDGES.replace("WITH e", "WITH RECURSIVE e") + """, t(node, other) AS (SELECT src, src FROM u UNION SELECT t.node, u.dst FROM t JOIN u ON t.other = u.src),
cc AS (SELECT node, min(other) AS root FROM t GROUP BY 1)"""


@query(EDGES + " SELECT src, dst, round(cost, 6) AS cost FROM g UNION ALL SELECT dst, src, round(cost, 6) FROM g")
def edges_bidirectional(spark, sf_dir):
    return rounded(graph.both_ways(edges_of(spark, sf_dir)))


@query(REACH + " SELECT node, root FROM cc")
def components(spark, sf_dir):
    return graph.components(edges_of(spark, sf_dir))


@query(REACH + " SELECT node, root FROM cc WHERE root = (SELECT arg_max(root, (n, -root)) FROM (SELECT root, count(*) AS n FROM cc GROUP BY 1))")
def largest_component(spark, sf_dir):
    return graph.largest(graph.components(edges_of(spark, sf_dir)))


@query(REACH + " SELECT count(*) AS lost FROM cc WHERE root <> (SELECT arg_max(root, (n, -root)) FROM (SELECT root, count(*) AS n FROM cc GROUP BY 1))")
def lost_count(spark, sf_dir):
    return aggs.lost_count(graph.components(edges_of(spark, sf_dir)).withColumn("n_frames", F.lit(1)))


@query(REACH + """, walk(node, root, path_len) AS (SELECT root, root, 0 FROM (SELECT DISTINCT root FROM cc) UNION SELECT u.dst, w.root, w.path_len + 1 FROM walk w JOIN u ON w.node = u.src WHERE w.path_len < 60)
SELECT node, root, CAST(min(path_len) AS INT) AS path_len FROM walk GROUP BY 1, 2""")
def path_length(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return graph.path_lengths(e, graph.components(e))


@query(EDGES + """, d AS (SELECT src AS dst, count(*) AS degree FROM u GROUP BY 1),
k AS (SELECT u.src, u.dst, degree, row_number() OVER (PARTITION BY u.src ORDER BY degree DESC, u.dst) AS rank FROM u JOIN d USING (dst))
SELECT src, dst, degree, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""".replace(", d AS", ", dg AS").replace("JOIN d USING", "JOIN dg USING"))
def covisible_topk(spark, sf_dir):
    return graph.covisible_top(graph.both_ways(edges_of(spark, sf_dir)), 10)


@query()
def minimum_forest(spark, sf_dir):
    return rounded(graph.minimum_forest(edges_of(spark, sf_dir)))


@query()
def spanning_forest(spark, sf_dir):
    """Orders of a customer in time are nodes; each is linked with those of its last three before it."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    i = topk.reindexed(o, ["o_custkey"], [F.col("o_orderkey")], "node_index")
    e = i.select("o_custkey", F.col("node_index").cast("long").alias("src"), F.col("o_totalprice").alias("p"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).withColumn("dst", F.col("src") - F.col("k")).where("dst >= 0")
    e = e.join(i.select("o_custkey", F.col("node_index").cast("long").alias("dst"), F.col("o_totalprice").alias("q")), ["o_custkey", "dst"]).where(F.abs(F.col("p") - F.col("q")) < 150_000)
    return graph.spanning_forest(e.select("o_custkey", "src", "dst", F.abs(F.col("p") - F.col("q")).alias("cost")), ["o_custkey"], i.select("o_custkey", F.col("node_index").cast("long").alias("node_index")))


@query()
def pose_graph(spark, sf_dir):
    """A loop of poses for each supplier: steps around a hexagon with its balance as drift."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component"), (F.col("s_acctbal").cast("double") / 200_000).alias("drift"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("src"))
    e = c.select("component", "drift", "src").select("component", F.col("src").cast("long").alias("src"), ((F.col("src") + 1) % 6).cast("long").alias("dst"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.8660254037844386)).alias("q"), F.array(1 + F.col("drift"), F.col("src") / 200, F.lit(0.0)).alias("t"))
    return estimate.pose_graph(e, ["component"])


@query()
def ransac_line(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return estimate.ransac_line(d, ["l_suppkey"], "x", "y", S.RansacConfig(max_residual=5.0))


# dimension lookups, registry, settings


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def config_preset_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("r_regionkey", F.col("n_regionkey"))
    return joins.lookup(n, small(table(spark, sf_dir, "region"), 10_000), ["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def left_anti_register(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return joins.without_known(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), known, ["n_nationkey"])


@query("""
SELECT ser_num, width FROM (SELECT r_name AS ser_num, r_regionkey AS width FROM region UNION ALL
SELECT DISTINCT n_name, -1 FROM nation WHERE n_name NOT IN (SELECT r_name FROM region))""")
def camera_registry(spark, sf_dir):
    own = table(spark, sf_dir, "region").select(F.col("r_name").alias("ser_num"), F.col("r_regionkey").alias("width"))
    return sources.add_cameras(own, table(spark, sf_dir, "nation").select(F.col("n_name").alias("ser_num"), F.lit(-1).alias("width")))


@query("SELECT source AS camera, count(*) AS frames FROM documents GROUP BY 1")
def frame_counts(spark, sf_dir):
    return sources.frame_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("camera")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS kp_index FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.07")
def keypoint_validity(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("kp_index"), F.col("l_discount").alias("depth"))
    return features.valid_keypoints(k, F.lit(0.02), F.lit(0.07), ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("kp_index").cast("long").alias("kp_index"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, round((l_quantity - 1) * (64 / 49.0::DOUBLE)) AS gx, round(l_discount * (48 / 0.1::DOUBLE)) AS gy FROM lineitem)
SELECT CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, count(*) AS n FROM c WHERE gx >= 0 AND gx < 64 AND gy >= 0 AND gy < 48 GROUP BY 1, 2""")
def feature_grid(spark, sf_dir):
    bounds = F.struct(F.lit(1.0).alias("min_x"), F.lit(50.0).alias("max_x"), F.lit(0.0).alias("min_y"), F.lit(0.1).alias("max_y"))
    k = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return features.with_grid(k, bounds).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))


# scalar functions


@query("""
SELECT p_partkey, CASE WHEN p_size - 25 > 0 THEN 1 WHEN p_size - 25 < 0 THEN -1 ELSE 0 END AS sign, least(40, greatest(10, p_size)) AS clip, round(1 / (1 + exp(-(p_size - 25.0) * 0.1)), 6) AS sigmoid,
       round(CASE WHEN abs(p_size - 25) < 1.2 THEN 1.0 ELSE 1.2 / abs(p_size - 25) END, 6) AS huber_w, round(CASE WHEN abs(p_size - 25) < 1.2 THEN (p_size - 25) * (p_size - 25) / 2.0 ELSE 1.2 * (abs(p_size - 25) - 0.6) END, 6) AS huber_c,
       CAST(p_size * (p_size - 1) / 2 AS BIGINT) AS choose2, CAST(floor(p_size / 8) AS BIGINT) AS block, p_size % 8 AS local FROM part""")
def scalar_numbers(spark, sf_dir):
    s, d = F.col("p_size"), F.col("p_size") - F.lit(25.0)
    return rounded(table(spark, sf_dir, "part").select(
        "p_partkey", N.sign(d).alias("sign"), N.clip(s, 10, 40).cast("int").alias("clip"), N.sigmoid(d, 0.1).alias("sigmoid"), N.huber_weight(d).alias("huber_w"), N.huber_cost(d).alias("huber_c"),
        N.n_choose_k(s, 2).alias("choose2"), C.voxel_to_block(s).alias("block"), C.voxel_in_block(s).alias("local"),
    ))


@query("""
SELECT p_partkey, regexp_matches(p_name, '[^ ]') AS has_text, CAST(len(list_filter(regexp_split_to_array(p_type, '[ E]'), lambda x: x <> '')) AS INT) AS parts,
       array_to_string(list_filter(regexp_split_to_array(p_type, '[ E]'), lambda x: x <> ''), '-') AS joined FROM part""")
def scalar_strings(spark, sf_dir):
    parts = T.split(F.col("p_type"), "E")
    return table(spark, sf_dir, "part").select("p_partkey", T.has_text(F.col("p_name")).alias("has_text"), F.size(parts).alias("parts"), T.join(parts, "-").alias("joined"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25.5::DOUBLE) / 500 * z AS x, (l_discount * 100 - 5) / 400 * z AS y, z FROM (SELECT *, 1 + l_tax AS z FROM lineitem))
SELECT l_orderkey, l_linenumber, CASE WHEN round(x, 6) = 0 THEN 0 ELSE round(x, 6) END AS x, CASE WHEN round(y, 6) = 0 THEN 0 ELSE round(y, 6) END AS y, round(z, 6) AS z, round(500 * x / z + 25.5, 6) AS u, CASE WHEN round(400 * y / z + 5, 6) = 0 THEN 0 ELSE round(400 * y / z + 5, 6) END AS v FROM p""")
def camera_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    p = C.unproject(F.col("l_quantity"), F.col("l_discount") * 100, 1 + F.col("l_tax"), 500.0, 400.0, 25.5, 5.0)
    q = d.select("l_orderkey", "l_linenumber", p.alias("p")).withColumn("uv", C.project(F.col("p"), 500.0, 400.0, 25.5, 5.0))
    return rounded(q.select("l_orderkey", "l_linenumber", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")], F.col("uv")[0].alias("u"), F.col("uv")[1].alias("v")))


@query("""
SELECT l_orderkey, l_linenumber, round(0.6::DOUBLE * l_discount + 0.8::DOUBLE * l_quantity + 1, 6) AS x, round(0.6::DOUBLE * l_quantity - 0.8::DOUBLE * l_discount + 2, 6) AS y, round(l_tax + 3, 6) AS z FROM lineitem""")
def rigid_transform(spark, sf_dir):
    # A quarter-like turn about z with cosine 0.6 and sine 0.8, then a shift; (discount, quantity, tax) is the point.
    c, s = ((1 + 0.6) / 2) ** 0.5, ((1 - 0.6) / 2) ** 0.5
    pose = V.pose(F.array(F.lit(0.0), F.lit(0.0), F.lit(-s), F.lit(c)), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    p = F.array(F.col("l_discount"), F.col("l_quantity").cast("double"), F.col("l_tax"))
    moved = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.transform_point(pose, p).alias("p"))
    return rounded(moved.select("l_orderkey", "l_linenumber", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")]))
