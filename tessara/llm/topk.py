"""Exact top-k search by inner product: term-at-a-time accumulation over every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(rows: np.ndarray, lengths: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of any lengths, missing terms zero. Whole numbers, exact as floats below 2^53."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(rows.astype(np.float64) * scale)
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products (queries x candidates) of whole numbers, exact.

    One term after the other: the postings of a term, candidates with a weight other than zero, are scattered into the
    dense score row of each query that has the term, times the query's weight.
    """
    terms = min(queries.shape[1], candidates.shape[1])
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, terms)
    kind = np.int64 if top < 2**62 else object
    q, c = (x.astype(kind) if kind is np.int64 else np.vectorize(int, otypes=[object])(x) for x in (queries[:, :terms], candidates[:, :terms]))
    out = np.zeros((len(q), len(c)), kind)
    for t in range(terms):
        having, postings = np.flatnonzero(q[:, t]), np.flatnonzero(c[:, t])
        if len(having) == len(q) and len(postings) == len(c):
            out += q[:, t, None] * c[:, t]
        elif len(having) and len(postings):
            out[np.ix_(having, postings)] += q[having, t, None] * c[postings, t]
    return out


def best(row: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without the query's own id."""
    others = np.flatnonzero(ids != own)
    s = row[others]
    if len(others) > k:
        if s.dtype == object:
            least = sorted(s)[-k]
        else:
            least = np.partition(s, len(s) - k)[len(s) - k]
        others = others[s >= least]
        s = row[others]
    return others[np.lexsort((ids[others], -s))[:k]]


def blocks(rows: int, queries: int, candidate_block: int, query_block: int) -> tuple[int, int]:
    """Blocks of candidates and of queries. Small tables have 64 blocks of candidates, of 1,024 rows or more, for the
    cores' sake."""
    return max(-(-rows // candidate_block), min(64, -(-rows // 1024)), 1), max(1, -(-queries // query_block))


def top_k(rows: DataFrame, k: int = 10, scale: float = 1024.0, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 16_384, candidate_block: int = 65_536, tile: int = 1 << 21) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id is divisible by query_every.

    Queries are dealt in blocks of about query_block and candidates in blocks of about candidate_block, and every pair of
    blocks is one group, so a candidate moves once per query_block queries. A group holds its queries, and reads its
    candidates batch by batch as they come: each batch is scored against slices of queries, `tile` scores at a time in a
    dense array, and the k best of each query so far are merged with those of the batch. A group hands on k rows per
    query, which a window merges. Blocks are bounded whatever the input, and nothing is collected or broadcast.

    Rows are dealt by hash of id and vector, and a query is told by its id and that hash, so a task that runs again finds the
    same rows and queries in whatever order they arrive. Repeats of a row are counted before rows move. Rows with a null id or vector, or a null or non-finite
    component, take no part. A query's own row is any row with its id; rows that share a query id are queries of their
    own. Missing terms of shorter vectors count as zero. Scores beyond a long are held to its range. An empty table gives
    an empty result.
    """
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad)
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    n, q = valid.agg(F.count(F.lit(1)), F.count_if(F.col("id") % query_every == 0)).first()
    n_blocks, q_blocks = blocks(n, q, candidate_block, query_block)
    # Repeats of a row differ in nothing, and no answer has more than k of them.
    counted = valid.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    key = F.xxhash64("id", "vector")
    asked = counted.where(F.col("id") % query_every == 0)
    cb, qb = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks)).cast("int"), F.pmod(key, F.lit(q_blocks)).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c) for m, c in ((n_blocks, "cb"), (q_blocks, "qb"))]
    many = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k + 1)))).alias("copy")
    candidates = counted.select("id", "vector", cb.alias("cb"), many).select(F.col("cb"), every[1], F.lit(None).cast("long").alias("hash"), "id", "vector")
    queries = asked.select(every[0], qb.alias("qb"), key.alias("hash"), "id", "vector")
    parts = min(n_blocks * q_blocks, 1 << 16)
    together = queries.unionByName(candidates).repartition(parts, "cb", "qb").sortWithinPartitions("cb", "qb", F.desc_nulls_last("hash"), "id")

    def matrix(column: pa.ListArray) -> np.ndarray:
        return _matrix(column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths()), scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, Group(k, tile)
        for whole in batches:
            cb, qb = (np.asarray(whole.column(j)) for j in (0, 1))
            cuts = np.flatnonzero((np.diff(cb) != 0) | (np.diff(qb) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows]):
                if hi == lo:
                    continue
                if (now := (cb[lo], qb[lo])) != key:
                    if key is not None:
                        yield from state.found()
                    key, state = now, Group(k, tile)
                batch = whole.slice(lo, hi - lo)
                n_queries = batch.num_rows - batch.column(2).null_count  # they come first
                ids, vectors = batch.column(3).to_numpy(), batch.column(4)
                if n_queries:
                    state.ask(batch.column(2).slice(0, n_queries).to_numpy(), ids[:n_queries], matrix(vectors.slice(0, n_queries)))
                if n_queries < batch.num_rows:
                    state.meet(ids[n_queries:], matrix(vectors.slice(n_queries)))
        if key is not None:
            yield from state.found()

    found = together.mapInArrow(run, "hash long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Queries that are repeats of one row have the same answer; each gets it.
    repeated = asked.where("copies > 1").select(F.col("id").alias("query_id"), key.alias("hash"), "copies")
    each = ranked.join(repeated, ["query_id", "hash"], "left").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return each.select("query_id", "rank", "vec_id", "score")


class Group:
    """The queries of one block and the k best candidates that each has met so far."""

    def __init__(self, k: int, tile: int):
        self.k, self.tile = k, tile
        self.hashes, self.ids, self.vectors = [], [], []
        self.kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def ask(self, hashes: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.ids.append(ids)
        self.vectors.append(vectors)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates of one batch: scored in slices of queries, then merged with what was kept. kept: which query, the
        candidate's id, the score."""
        if not self.ids:
            return
        if len(self.vectors) > 1:
            width = max(v.shape[1] for v in self.vectors)
            self.vectors = [np.vstack([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in self.vectors])]
            self.ids, self.hashes = [np.concatenate(self.ids)], [np.concatenate(self.hashes)]
        own, asked = self.ids[0], self.vectors[0]
        got = [self.kept] if self.kept else []
        step = max(1, self.tile // max(1, len(ids)))
        for lo in range(0, len(own), step):
            s = scores(asked[lo : lo + step], vectors)
            found = [best(s[j], ids, x, self.k) for j, x in enumerate(own[lo : lo + step])]
            which, at = np.repeat(np.arange(len(found)), list(map(len, found))), np.concatenate(found)
            value = s[which, at]
            if value.dtype == object:
                value = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in value], np.int64)
            got.append((which + lo, ids[at], value.astype(np.int64)))
        which, at, value = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((at, -np.maximum(value, -(2**63) + 1), which))
        which, at, value = which[order], at[order], value[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        self.kept = tuple(x[place < self.k] for x in (which, at, value))

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.kept and len(self.kept[0]):
            which, at, value = self.kept
            yield pa.RecordBatch.from_arrays([pa.array(self.hashes[0][which]), pa.array(self.ids[0][which]), pa.array(at), pa.array(value)], ["hash", "query_id", "vec_id", "score"])


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
