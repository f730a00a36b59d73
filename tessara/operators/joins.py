"""Joins: nearest neighbours with ratio test, shared words, ranges on a grid, stamps within a tolerance, lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from tessara.functions import vectors as V
from tessara.operators import topk
from tessara.operators.sizes import small, stored


def nearest(left: DataFrame, right: DataFrame, by: list[str] | None = None, ratio: float = 0.8, max_angle: float | None = 0.7, mutual: bool = True, scale: float = 1.0, extra: Callable[[], Column] | None = None) -> DataFrame:
    """Matches of unit vectors: for each left row the right row of the highest dot product, if the angle is below
    max_angle and below ratio times the second best's; with mutual, only if the same holds the other way round.

    left: by..., l_id, l_vec; right: by..., r_id, r_vec; by: the frame pair. Every pair within a frame pair is scored,
    which is the operator's nature; a frame has at most a few thousand rows, so a frame pair is one matrix product in a
    task of its own, and only matches come out. Without `by`, all rows are one frame pair of any size: then it goes block
    by block, see block_tops(). With `extra`, pairs are rows, as its condition is a column's; use it within frames. Ties to the smaller id. `extra`: a further condition of a
    pair to count (guided matching), over l_ and r_ columns; others score as rejected.

    Returns by..., l_id, r_id, score."""
    by = by or []
    if by and extra is None:
        return _nearest_in_frames(left, right, by, ratio, max_angle, mutual, scale)
    if extra is None:
        tops = block_tops(left, right, scale=scale)
        one = ratio_test(tops.where("side = 'l'").select("l_id", "r_id", "score"), ["l_id"], "r_id", ratio, max_angle)
        if not mutual:
            return one
        other = ratio_test(tops.where("side = 'r'").select("l_id", "r_id", "score"), ["r_id"], "l_id", ratio, max_angle)
        return one.join(other.select("l_id", "r_id"), ["l_id", "r_id"])
    pairs = left.join(right, by) if by else left.crossJoin(right)
    pairs = pairs.withColumn("score", V.dot(F.col("l_vec"), F.col("r_vec")) * scale).where(extra())
    pairs = pairs.select(*by, "l_id", "r_id", "score")
    one = ratio_test(pairs, [*by, "l_id"], "r_id", ratio, max_angle)
    if not mutual:
        return one
    other = ratio_test(pairs, [*by, "r_id"], "l_id", ratio, max_angle)
    return one.join(other.select(*by, "l_id", "r_id"), [*by, "l_id", "r_id"])


def block_tops(left: DataFrame, right: DataFrame, scale: float = 1.0, block: int = 2048) -> DataFrame:
    """side, l_id, r_id, score: what may be among the two best of a left row (side l) or a right row (side r).

    Both sides are dealt into blocks of about `block` rows. Each pair of blocks is one group of a grid and one matrix
    product, and hands on the two best of each of its rows either way. So no pair of rows is ever a row, and work
    spreads over as many tasks as there are pairs of blocks."""
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (left, right))
    l = left.select("l_id", "l_vec", F.pmod(F.xxhash64("l_id"), F.lit(n_left)).cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("rb"))
    r = right.select("r_id", "r_vec", F.pmod(F.xxhash64("r_id"), F.lit(n_right)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("lb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a, b = a.sort_values("l_id"), b.sort_values("r_id")
            s = np.array(a.l_vec.tolist(), float) @ np.array(b.r_vec.tolist(), float).T * scale
            for side, m in (("l", s), ("r", s.T)):
                rest, every = m.copy(), np.arange(len(m))
                for _ in range(min(2, m.shape[1])):
                    at = rest.argmax(1)
                    i, j = (every, at) if side == "l" else (at, every)
                    out.append(pd.DataFrame({"side": side, "l_id": a.l_id.to_numpy()[i], "r_id": b.r_id.to_numpy()[j], "score": m[every, at]}))
                    rest[every, at] = -np.inf
        return pd.concat(out) if out else pd.DataFrame(columns=["side", "l_id", "r_id", "score"])

    ids = f"l_id {left.schema['l_id'].dataType.simpleString()}, r_id {right.schema['r_id'].dataType.simpleString()}"
    return l.groupBy("lb", "rb").cogroup(r.groupBy("lb", "rb")).applyInPandas(run, f"side string, {ids}, score double")


def _nearest_in_frames(left: DataFrame, right: DataFrame, by: list[str], ratio: float, max_angle: float | None, mutual: bool, scale: float) -> DataFrame:
    def best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the best of each row, the first of equals, and whether it passes."""
        at = s.argmax(1)
        top = s[np.arange(len(s)), at]
        rest = s.copy()
        rest[np.arange(len(s)), at] = -np.inf
        second = rest.max(1)
        angle = np.arccos(np.clip(top, -1, 1))
        ok = (second == -np.inf) | (angle < ratio * np.arccos(np.clip(second, -1, 1)))
        return at, ok if max_angle is None else ok & (angle < max_angle)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "l_id", "r_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        a, b = a.sort_values("l_id"), b.sort_values("r_id")
        s = np.array(a.l_vec.tolist(), float) @ np.array(b.r_vec.tolist(), float).T * scale
        at, ok = best(s)
        if mutual:
            back, back_ok = best(s.T)
            ok &= (back[at] == np.arange(len(a))) & back_ok[at]
        i = np.flatnonzero(ok)
        out = pd.DataFrame({"l_id": a.l_id.to_numpy()[i], "r_id": b.r_id.to_numpy()[at[i]], "score": s[i, at[i]]})
        for k, v in zip(by, key):
            out[k] = v
        return out[names]

    own = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in by)
    ids = f"l_id {left.schema['l_id'].dataType.simpleString()}, r_id {right.schema['r_id'].dataType.simpleString()}"
    l, r = left.select(*by, "l_id", "l_vec"), right.select(*by, "r_id", "r_vec")
    return l.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(run, f"{own}, {ids}, score double")


def ratio_test(pairs: DataFrame, by: list[str], other: str, ratio: float, max_angle: float | None) -> DataFrame:
    top = topk.best_two(pairs, by, [F.desc("score"), F.col(other)], "score")
    close = F.lit(True) if max_angle is None else V.angle(F.col("score")) < max_angle
    clear = F.col("second").isNull() | (V.angle(F.col("score")) < ratio * V.angle(F.col("second")))
    return top.where(close & clear).drop("second")


def homography_guide(h: list[float], most: float, lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    """Whether the left point, moved by the 3 x 3 homography, is nearer than `most` to the right one in x and y."""
    w = h[6] * lx + h[7] * ly + h[8]
    return (F.abs((h[0] * lx + h[1] * ly + h[2]) / w - rx) < most) & (F.abs((h[3] * lx + h[4] * ly + h[5]) / w - ry) < most)


def epipolar_guide(f: list[float], most: float, lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    """Whether the pair's epipolar error under the 3 x 3 fundamental matrix is below `most`."""
    a, b, c = (f[3 * i] * lx + f[3 * i + 1] * ly + f[3 * i + 2] for i in range(3))
    d, e = (f[i] * rx + f[3 + i] * ry + f[6 + i] for i in range(2))
    t = rx * a + ry * b + c
    return t * t / (a * a + b * b + d * d + e * e) < most


def orientation_consistent(matches: DataFrame, by: list[str], delta: Column, degrees: bool = False, bins: int = 30, keep: int = 3, share: float = 0.1) -> DataFrame:
    """Matches in the fullest bins of their orientation differences.

    The difference is wrapped by 360 and binned by its share of `bins`. As it is in radians unless degrees is set, then
    only bins 0 and 12 can fill: what goes is a sign that under a tenth of the matches have."""
    wide = F.degrees(delta) if degrees else delta
    turn = F.when(wide < 0, wide + 360).otherwise(wide)
    binned = matches.withColumn("bin", (F.round(turn / bins) % bins).cast("int"))
    return binned.join(topk.top_bins(binned, by, "bin", keep, share).select(*by, "bin"), [*by, "bin"], "left_semi")


def shared_words(queries: DataFrame, refs: DataFrame, query: str = "query", ref: str = "ref", word: str = "word") -> DataFrame:
    """query, ref, n: how many different words two rows share, over pairs that share any. Postings: id, word."""
    q, r = queries.select(query, word).distinct(), refs.select(ref, word).distinct()
    return small(q, 500_000).join(r, word).groupBy(query, ref).agg(F.count(F.lit(1)).alias("n"))


def bag_matches(queries: DataFrame, refs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """query, ref, n, score: shared words and the cosine of the word weights, over pairs of different ids that share any,
    from one join. Postings: id, word, weight, one row for each word of an id.

    Postings of queries of a checked size are broadcast; then, if refs come in parts by ref (see postings_of()), a part
    holds all of a reference and no posting and no pair moves. Larger ones are joined by word, whose hot words Spark's
    adaptive join splits. Whole weights give whole dot products, so with two divisions, the query's norm first, a score is
    the same number wherever it is worked out so. The result is a written table, since what follows reads it more than
    once."""
    wq, wr = queries.select(query, "word", F.col("weight").alias("wq")), refs.select(ref, "word", F.col("weight").alias("wr"))
    nq = queries.groupBy(query).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nq"))
    nr = refs.groupBy(ref).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nr"))
    dots = wr.join(small(wq, 500_000), "word").where(F.col(query) != F.col(ref)).groupBy(ref, query).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wq") * F.col("wr")).alias("dot"))
    scored = dots.join(nr.hint("shuffle_hash"), ref).join(small(nq, 500_000), query)
    return stored(scored.select(query, ref, "n", (F.col("dot") / F.col("nq") / F.col("nr")).alias("score")))


def postings_of(rows: DataFrame, key: str, into: str, text: str = "text") -> DataFrame:
    """Postings (into, word, weight: how often) of texts whose words are apart by blanks. Texts are dealt by key once;
    what is grouped by key after that stays where it is."""
    words = rows.select(F.col(key).alias(into), text).repartition(into).select(into, F.explode(F.split(text, " ")).alias("word"))
    return words.where("word != ''").groupBy(into, "word").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def cosine_scores(candidates: DataFrame, queries: DataFrame, refs: DataFrame, query: str = "query", ref: str = "ref") -> DataFrame:
    """candidates with `score`, the cosine of the rows' word weights. Postings: id, word, weight. The score of a bag of
    words is the engine's own choice."""
    wq, wr = queries.withColumnRenamed("weight", "wq"), refs.withColumnRenamed("weight", "wr")
    nq = queries.groupBy(query).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nq"))
    nr = refs.groupBy(ref).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nr"))
    dots = candidates.select(query, ref).join(wq, query).join(wr, [ref, "word"]).groupBy(query, ref).agg(F.sum(F.col("wq") * F.col("wr")).alias("dot"))
    return candidates.join(dots, [query, ref]).join(nq, query).join(nr, ref).withColumn("score", F.col("dot") / (F.col("nq") * F.col("nr"))).drop("dot", "nq", "nr")


def retrieve(queries: DataFrame, refs: DataFrame, k: int = 10, factor: float = 0.6) -> DataFrame:
    """The k best references of each query among those that share at least int(factor * most) words. Postings as for
    cosine_scores()."""
    near = topk.max_relative(bag_matches(queries, refs), ["query"], "n", factor)
    return topk.top_k(near, ["query"], [F.desc("score"), F.col("ref")], k)


def overlapping(queries: DataFrame, refs: DataFrame, covisible: DataFrame, min_score: float, factor: float = 0.8, keep: float = 0.75) -> DataFrame:
    """References that overlap a query, judged with those that see the same.

    Those that share over int(0.8 * most) words and score at least min_score gather the scores of their covisible
    ones (ref, co) that share as many; each is replaced by the best of these (to 12 digits; the smallest among equals) if
    that one is better than itself, and stays if its sum is over 0.75 of the best sum. Returns query, ref, score."""
    near = topk.max_relative(bag_matches(queries, refs), ["query"], "n", factor, strict=True)
    scored = near.select("query", "ref", "score")
    hits = scored.where(F.col("score") >= min_score)
    helpers = scored.select("query", F.col("ref").alias("co"), F.col("score").alias("co_score"))
    joined = hits.join(covisible, "ref").join(helpers, ["query", "co"])
    digits = F.floor(F.col("co_score") * 1e12 + 0.5)
    gathered = joined.groupBy("query", "ref").agg(F.sum("co_score").alias("more"), F.max("co_score").alias("top"), F.max_by("co", F.struct(digits, -F.col("co"))).alias("first"))
    full = hits.join(gathered, ["query", "ref"], "left")
    full = full.withColumn("total", F.col("score") + F.coalesce("more", F.lit(0.0)))
    full = full.withColumn("view", F.when(F.col("top") > F.col("score"), F.col("first")).otherwise(F.col("ref")))
    best = full.groupBy("query").agg(F.greatest(F.max("total"), F.lit(min_score)).alias("best"))
    kept = full.join(best, "query").where(F.col("total") > keep * F.col("best"))
    return kept.select("query", F.col("view").alias("ref")).distinct().join(scored, ["query", "ref"])


def best_pair(counts: DataFrame, by: list[str], factor: float = 0.6) -> DataFrame:
    """The pair (ref, cur) with the highest score of each pair of clusters, among those with n >= int(0.6 * most); the
    smallest pair among equals. counts: by..., ref, cur, n, score."""
    near = topk.max_relative(counts, by, "n", factor)
    top = F.max_by(F.struct("ref", "cur", "n", "score"), F.struct("score", -F.col("ref"), -F.col("cur")))
    return near.groupBy(*by).agg(top.alias("p")).select(*by, "p.*")


def range_join(left: DataFrame, right: DataFrame, x: tuple[str, str], y: tuple[str, str], radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs whose points lie in each other's open box: |dx| < radius and |dy| < radius.

    Cells are as wide as the radius, and the right side is copied to the nine cells around it, so the join is one on
    equal cells; the box test finishes it. x, y: names on the left and right side."""
    by = by or []
    cell = {side: [F.floor(F.col(c) / radius).cast("long") for c in names] for side, names in (("l", (x[0], y[0])), ("r", (x[1], y[1])))}
    l_side = left.withColumns({"__gx": cell["l"][0], "__gy": cell["l"][1]})
    nine = F.array(*[F.struct((cell["r"][0] + i).alias("x"), (cell["r"][1] + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r_side = right.withColumn("__c", F.explode(nine)).withColumns({"__gx": F.col("__c.x"), "__gy": F.col("__c.y")}).drop("__c")
    near = (F.abs(F.col(x[0]) - F.col(x[1])) < radius) & (F.abs(F.col(y[0]) - F.col(y[1])) < radius)
    return l_side.join(r_side, [*by, "__gx", "__gy"]).where(near).drop("__gx", "__gy")


def cell_probe(points: DataFrame, refs: DataFrame, size: float, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """points joined with refs in the 3 x 3 x 3 cells around them. refs has cell columns cx, cy, cz."""
    own = [F.floor(F.col(c) / size).cast("long") for c in xyz]
    around = F.array(*[F.struct((own[0] + i).alias("cx"), (own[1] + j).alias("cy"), (own[2] + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return points.withColumn("__c", F.explode(around)).select("*", "__c.*").drop("__c").join(refs, ["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def projection_match(left: DataFrame, right: DataFrame, bounds: tuple[float, float, float, float], radius: float = 15.0, ratio: float = 0.8, max_angle: float | None = 0.7, by: list[str] | None = None) -> DataFrame:
    """For each right row, projected to (r_x, r_y): the left row within the box of the best dot product, if it passes the
    ratio test. One way only. left: by..., l_id, l_x, l_y, l_vec; right likewise; bounds: min_x, max_x, min_y, max_y,
    outside of which right rows are dropped."""
    by = by or []
    inside = right.where(F.col("r_x").between(bounds[0], bounds[1]) & F.col("r_y").between(bounds[2], bounds[3]))
    pairs = range_join(left, inside, ("l_x", "r_x"), ("l_y", "r_y"), radius, by).withColumn("score", V.dot(F.col("l_vec"), F.col("r_vec")))
    return ratio_test(pairs.select(*by, "l_id", "r_id", "score"), [*by, "r_id"], "l_id", ratio, max_angle)


def time_candidates(a: DataFrame, b: DataFrame, tolerance: float, offset: float = 0.0, a_col: str = "a", b_col: str = "b") -> DataFrame:
    """All (a, b, delta) with |a - (b + offset)| < tolerance, by buckets of the tolerance's width and their neighbours."""
    left = a.withColumn("__k", F.floor(F.col(a_col) / tolerance).cast("long"))
    at = F.floor((F.col(b_col) + offset) / tolerance).cast("long")
    right = b.withColumn("__k", F.explode(F.array(at - 1, at, at + 1)))
    delta = F.abs(F.col(a_col) - (F.col(b_col) + offset))
    return left.join(right, "__k").withColumn("delta", delta).where(F.col("delta") < tolerance).drop("__k")


def time_associate(a: DataFrame, b: DataFrame, tolerance: float = 0.02, offset: float = 0.0, a_col: str = "a", b_col: str = "b", chunk: int = 200_000) -> DataFrame:
    """One-to-one pairs as greedily taken by (delta, a, b), of all with |a - (b + offset)| < tolerance. Null and NaN stamps
    pair with nothing.

    The nearest two stamps of different kinds are always neighbours in time among those left, so no candidates are made:
    stamps are dealt in stretches of about `chunk` and each is walked once, see Stretch. What a stretch can't settle
    without its neighbours, near its ends, is dealt again with other cuts, until nothing is left. A round is a written
    table of the pairs and the stamps left; a stretch that nothing reaches from outside is settled in the first."""
    own = {"a": a.schema[a_col].dataType, "b": b.schema[b_col].dataType}
    kind = "long" if not offset and all(isinstance(t, IntegralType) for t in own.values()) else "double"
    at_b = F.col(b_col) + offset if offset else F.col(b_col)
    points = a.select(F.col(a_col).cast(kind).alias("at"), F.lit(True).alias("is_a"), F.col(a_col).alias("a"), F.lit(None).cast(own["b"]).alias("b"))
    points = points.unionByName(b.select(at_b.cast(kind).alias("at"), F.lit(False).alias("is_a"), F.lit(None).cast(own["a"]).alias("a"), F.col(b_col).alias("b")))
    rest = points.where("at IS NOT NULL AND NOT isnan(CAST(at AS DOUBLE))").distinct()
    schema = f"at {kind}, is_a boolean, a {own['a'].simpleString()}, b {own['b'].simpleString()}, delta double, settled boolean"
    types = [pa.int64() if kind == "long" else pa.float64(), pa.bool_(), to_arrow_type(own["a"]), to_arrow_type(own["b"]), pa.float64(), pa.bool_()]

    def walked(open_ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [batch for batch in batches if batch.num_rows]
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            t = t.take(pc.sort_indices(t, sort_keys=[("at", "ascending"), ("is_a", "descending"), ("b", "ascending")]))
            at, is_a = t["at"].to_pylist(), t["is_a"].to_pylist()
            pairs, left = Stretch(at, is_a, t["a"].to_pylist(), t["b"].to_pylist(), tolerance, open_ends).walk()
            lead, then = np.array([p[0] for p in pairs] + left, int), np.array([p[1] for p in pairs] + left, int)
            deltas = [float(abs(at[x] - at[y])) for x, y in pairs] + [None] * len(left)
            rows, settled = t.take(lead), np.arange(len(lead)) < len(pairs)
            columns = [rows["at"], rows["is_a"], rows["a"], t["b"].take(then), pa.array(deltas, pa.float64()), pa.array(settled)]
            yield from pa.Table.from_arrays([c.cast(k) for c, k in zip(columns, types)], names=["at", "is_a", "a", "b", "delta", "settled"]).to_batches()

        return run

    taken: list[DataFrame] = []
    n, turn, before = rest.count(), 0, None
    while n:
        parts = -(-n // chunk)
        if parts == 1:
            dealt, open_ends = rest.coalesce(1), False
        else:
            # Two rounds have different cuts, as the second has one stretch more; one that settles nothing widens them.
            dealt, open_ends = rest.repartitionByRange(parts + turn % 2, "at"), True
        done = stored(dealt.mapInArrow(walked(open_ends), schema))
        taken.append(done.where("settled").select(F.col("a").alias(a_col), F.col("b").alias(b_col), "delta"))
        rest = done.where("NOT settled").select("at", "is_a", "a", "b")
        n, before, turn = rest.count(), n, turn + 1
        if n == before:
            chunk *= 2
    out = taken[0] if taken else points.where("false").select(F.col("a").alias(a_col), F.col("b").alias(b_col), F.lit(None).cast("double").alias("delta"))
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


class Stretch:
    """Stamps of two kinds in order of time, paired greedily by (delta, a, b).

    With open ends, stamps outside lie before the first or after the last and aren't known. Then a stamp next to an end is
    lost, for this stretch, at the moment when the walk comes to its distance from what may take it: the end itself, or the
    nearest stamp of the other kind that was lost before it. Pairs that come earlier hold whatever lies outside."""

    def __init__(self, at: list, is_a: list[bool], a: list, b: list, tolerance: float, open_ends: bool):
        n = len(at)
        self.at, self.is_a, self.a, self.b, self.tolerance = at, is_a, a, b, tolerance
        self.after, self.before = [*range(1, n), -1], [-1, *range(n - 1)]
        self.gone = [False] * n
        self.heap: list[tuple] = []
        self.ends = {1: [0, {False: at[0], True: at[0]}], -1: [n - 1, {False: at[-1], True: at[-1]}]} if open_ends and n else {}

    def _meet(self, i: int, j: int) -> None:
        if i >= 0 and j >= 0 and self.is_a[i] != self.is_a[j]:
            delta = abs(self.at[i] - self.at[j])
            if delta < self.tolerance:
                x, y = (i, j) if self.is_a[i] else (j, i)
                heappush(self.heap, (delta, 1, self.a[x], self.b[y], x, y))

    def _threaten(self, side: int) -> None:
        """The moment at which the first stamp from an end is lost."""
        first, near = self.ends[side]
        if first >= 0:
            delta = abs(self.at[first] - near[not self.is_a[first]])
            if delta < self.tolerance:
                heappush(self.heap, (delta, 0, side, first))

    def _drop(self, i: int) -> None:
        self.gone[i] = True
        p, q = self.before[i], self.after[i]
        if p >= 0:
            self.after[p] = q
        if q >= 0:
            self.before[q] = p
        for side, end in self.ends.items():
            if end[0] == i:
                end[0] = q if side == 1 else p
                self._threaten(side)

    def walk(self) -> tuple[list[tuple[int, int]], list[int]]:
        """Places of the pairs (a, b), and of the stamps that were lost."""
        pairs, lost = [], []
        for i in range(len(self.at) - 1):
            self._meet(i, i + 1)
        for side in self.ends:
            self._threaten(side)
        while self.heap:
            event = heappop(self.heap)
            if event[1]:
                x, y = event[4:]
                if self.gone[x] or self.gone[y]:
                    continue
                pairs.append((x, y))
                low, high = min(x, y), max(x, y)
                p, q = self.before[low], self.after[high]
                self._drop(x)
                self._drop(y)
                self._meet(p, q)
            else:
                side, i = event[2:]
                if self.gone[i] or self.ends[side][0] != i:
                    continue
                lost.append(i)
                self.ends[side][1][self.is_a[i]] = self.at[i]
                self._drop(i)
        return pairs, lost


def schedule(df: DataFrame, by: list[str], id_col: str, full: bool = False) -> DataFrame:
    """Pairs (i, j) of a group to match: each with the next one, or, full, each with all before it."""
    from pyspark.sql import Window

    if not full:
        after = F.lead(id_col).over(Window.partitionBy(*by).orderBy(id_col))
        return df.select(*by, F.col(id_col).alias("i"), after.alias("j")).where(F.col("j").isNotNull())
    a, b = df.select(*by, F.col(id_col).alias("i")), df.select(*by, F.col(id_col).alias("j"))
    return a.join(b, by).where(F.col("j") < F.col("i"))


def correspondences(matches: DataFrame, points: DataFrame, most: float = 0.01) -> DataFrame:
    """Matches whose points in the world are nearer than `most`, both ways round. matches: frame_x, px, frame_y, py;
    points: frame, index, p (array of 3)."""
    x = points.select(F.col("frame").alias("frame_x"), F.col("index").alias("px"), F.col("p").alias("p_x"))
    y = points.select(F.col("frame").alias("frame_y"), F.col("index").alias("py"), F.col("p").alias("p_y"))
    near = matches.join(x, ["frame_x", "px"]).join(y, ["frame_y", "py"]).where(V.length(V.minus(F.col("p_x"), F.col("p_y"))) < most)
    one = near.select("frame_x", "px", "frame_y", "py")
    return one.unionByName(one.select(F.col("frame_y").alias("frame_x"), F.col("py").alias("px"), F.col("frame_x").alias("frame_y"), F.col("px").alias("py"))).distinct()


def lookup(df: DataFrame, dimension: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """df with the dimension's columns; a row without a match fails the query (strict) or is dropped."""
    if not strict:
        return df.join(dimension, on)
    found = df.join(dimension.withColumn("__hit", F.lit(1)), on, "left")
    checked = F.when(F.assert_true(F.col("__hit").isNotNull(), F.lit("a row has no match in the dimension")).isNull(), 1)
    return found.withColumn("__ok", checked).where("__ok = 1").drop("__ok", "__hit")


def voxel_lookup(points: DataFrame, voxels: DataFrame, keys: tuple[str, str, str] = ("vx", "vy", "vz"), values: tuple[str, ...] = ("sdf", "weight")) -> DataFrame:
    """points with the values of their voxel; one that isn't there is all zero."""
    return points.join(voxels.select(*keys, *values), list(keys), "left").na.fill(0.0, list(values))


def gather(df: DataFrame, indexes: DataFrame, on: str = "index", order: str = "position") -> DataFrame:
    """Rows of df in the order of a list of their places; a place may come twice."""
    return indexes.join(df, on).orderBy(order)


def without_known(candidates: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that aren't connected yet."""
    return candidates.join(known, on, "left_anti")


def projective_association(current: DataFrame, previous: DataFrame, pose: Column, intrinsics: tuple[float, float, float, float], most: float, sine: float) -> DataFrame:
    """Points of the current map with the point of the previous map at the pixel they project to, if nearer than `most`
    and with normals that differ by a sine below `sine`. Maps: x, y, p, n."""
    fx, fy, cx, cy = intrinsics
    moved = current.withColumns({"q": V.transform_point(pose, F.col("p")), "m": V.rotate(pose["q"], F.col("n"))})
    at = moved.where(F.col("q")[2] > 0).withColumns({"px": F.round(fx * F.col("q")[0] / F.col("q")[2] + cx).cast("int"), "py": F.round(fy * F.col("q")[1] / F.col("q")[2] + cy).cast("int")})
    old = previous.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("p").alias("p_prev"), F.col("n").alias("n_prev"))
    near = (V.length(V.minus(F.col("q"), F.col("p_prev"))) < most) & (V.length(V.cross(F.col("m"), F.col("n_prev"))) < sine)
    return at.join(old, ["px", "py"]).where(near)
