"""SimHash fingerprints, their close pairs by pigeonhole blocks, and the groups that these link."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.llm.common import written

BYTES = np.uint64(0x0101010101010101)
#: Rows whose byte-wide counters can be added up without a carry.
LANE = 255


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words, repeats included; fewer words: of the whole sequence."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(w) - width + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it; none: zero. Unsigned.

    Eight bits, one of each byte, are counted in one addition of 64 bits: rows are masked to the low bit of each byte
    and added in runs of 255, which no byte overflows.
    """
    n = len(hashes)
    if not n:
        return 0
    starts, out = np.arange(0, n, LANE), 0
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & BYTES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + b)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_mark(text_col: str) -> Column:
    """A hash of the text; null and empty differ."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (long, the fingerprint as signed) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(shingle_hashes(t.as_py(), width, seed))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "mark", "fp"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_mark(text_col).alias("mark"))
    return few.mapInArrow(run, "doc_id long, mark long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks, signed, of each choice of blocks - distance blocks: two fingerprints at that distance or less agree under one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    ones = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [_signed(sum(ones[i] for i in c)) for c in combinations(range(blocks), blocks - distance)]


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that join what lies within the distance of each other, directly or through others, one less than members
    for each such set. A member is compared only with those that none has reached yet."""
    left, a, b = fps.astype(np.int64), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= distance
            if near.any():
                got = left[near]
                a += [int(one)] * len(got)
                b += got.tolist()
                front += list(got)
                left = left[~near]
    return a, b


def links(fps: DataFrame, distance: int = 3, blocks: int = 5, chunk: int = 1024) -> DataFrame:
    """Links a, b (a < b) between distinct fingerprints; they connect the same ones that all close pairs would connect.

    fps: distinct values of fp. With B blocks, each choice of B - distance of them is a key; a close pair shares one. A
    bucket with over `chunk` members is dealt out in chunks, and each pair of chunks is compared in a task of its own,
    so a bucket of any size is handled whole and no task holds one. Buckets give spanning forests, not all pairs.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(distance, blocks))]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.*")
    shared = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of = F.ceil(F.col("n") / chunk).cast("int")
    members = keyed.join(shared, ["choice", "bits"]).withColumn("own", F.pmod(F.xxhash64("fp"), of).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    groups = members.groupBy("choice", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x in batch.column(0):
                u, v = forest(x.values.to_numpy(), distance)
                a += u
                b += v
            yield pa.RecordBatch.from_arrays([pa.array(map(min, a, b), pa.int64()), pa.array(map(max, a, b), pa.int64())], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node of edges (a, b).

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Edges turn into stars in a number of rounds that grows with the logarithm of the
    size. Each round is a written table; smallest neighbours are aggregated before rows move, and no list of
    neighbours is ever gathered.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where("u != v").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_groups(docs: DataFrame, width: int = 3, distance: int = 3, blocks: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, mark (a hash of the text), label (the smallest fp of the component) and component_id (the smallest
    doc_id reachable over links, itself included) of each row of docs.

    Copies with the same fingerprint become one node before anything is linked. Null and empty texts have fingerprint
    zero and are linked like any other. A null doc_id is placed with its fingerprint and never gives the component's id
    unless all ids there are null (then null). Repeated rows stay. An empty table gives an empty result.
    """
    own = written(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    label = components(links(nodes.select("fp"), distance, blocks))
    named = written(nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return own.join(named.join(smallest, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "fp", "mark", "label", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near_groups(): that of the smallest doc_id, null last, and among several rows
    with that id the one whose text's hash is smallest; of rows that agree in both, one. Options as for near_groups()."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows = near_groups(docs, **options).groupBy("label", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "n")).alias("k"))
    first = written(first.select(F.col("k.doc_id").alias("__id"), F.col("k.mark").alias("__mark"), F.col("k.n").alias("__n")), "first")
    same = F.col("__id").eqNullSafe(F.col(id_col).cast("long")) & (F.col("__mark") == text_mark(text_col))
    kept = docs.join(first.where("__n = 1"), same, "left_semi")
    if first.where("__n > 1").isEmpty():
        return kept
    repeated = docs.join(first.where("__n > 1"), same, "left_semi").withColumn("__mark", text_mark(text_col))
    return kept.unionByName(repeated.dropDuplicates([id_col, "__mark"]).drop("__mark"))


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
