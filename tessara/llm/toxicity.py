"""Toxicity by class-conditional Kneser-Ney models of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.llm.common import written

ORDER = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, A-Z lower-cased, each after a space, as one run of bytes behind ORDER - 1 spaces; and where
    each text starts in it, with the end."""
    parts = [b"".join(b" " + w for w in t.encode("utf-8", "replace").lower().split()) if t else b"" for t in texts]
    ends = np.cumsum([ORDER - 1, *map(len, parts)])
    return np.frombuffer(b" " * (ORDER - 1) + b"".join(parts), np.uint8), ends


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the `order` bytes that end at each place from ORDER - 1 on."""
    n = len(data) - (ORDER - 1)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER - order, ORDER):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


class Table:
    """A few numbers by code (distinct, under 2^40), in at least two slots for each code. A slot has the whole code, and
    codes whose slot is taken go to the next free one, so none is lost and no other code is mistaken for one."""

    def __init__(self, codes: np.ndarray, *values: np.ndarray, absent: tuple[float, ...]):
        self.size, self.absent = 2 * len(codes) + 1, np.array(absent, np.float32)
        self.rows = np.zeros((self.size, 2 + len(values)), np.uint32)
        kept = np.column_stack([*self._halves(codes), *(v.astype(np.float32).view(np.uint32) for v in values)])
        slots, left = self._first(codes), np.arange(len(codes))
        while len(left):
            free = self.rows[slots, 1] == 0
            self.rows[slots[free]] = kept[left[free]]  # of codes that want a free slot the last has it
            out = (self.rows[slots, :2] != kept[left, :2]).any(1)
            slots, left = (slots[out] + 1) % self.size, left[out]

    def _first(self, codes: np.ndarray) -> np.ndarray:
        """The slot where the search for each code begins."""
        h = codes * MULTIPLIER
        h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
        return ((h >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def _halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code in two numbers; the second is 0 only in a free slot."""
        return codes.astype(np.uint32), (codes >> np.uint64(32)).astype(np.uint32) + np.uint32(1)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """A row of numbers for each code."""
        slots, (low, high) = self._first(codes), self._halves(codes)
        rows = self.rows[slots]
        left = np.flatnonzero((rows[:, 1] != 0) & ((rows[:, 0] != low) | (rows[:, 1] != high)))
        slots = slots[left]
        while len(left):
            slots = (slots + 1) % self.size
            rows[left] = seen = self.rows[slots]
            on = (seen[:, 1] != 0) & ((seen[:, 0] != low[left]) | (seen[:, 1] != high[left]))
            slots, left = slots[on], left[on]
        out = rows[:, 2:].view(np.float32)
        out[rows[:, 1] == 0] = self.absent
        return out


@dataclass
class Model:
    """five: of a 5-gram, its discounted share in ordinary and toxic texts. four: of a 4-gram, the weight of what it
    leaves, as a context, to the shared model in ordinary and toxic texts, and its own share in the shared model. three:
    likewise what it leaves, and its share. pairs: the shared probability of a byte after one byte; left: what pairs
    leave as a context."""

    five: Table
    four: Table
    three: Table
    left: np.ndarray
    pairs: np.ndarray
    cut: float = 1.0

    def probabilities(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(byte | ordinary) and P(byte | toxic) at each place from ORDER on; data has a byte more before."""
        two = grams(data, 2).astype(np.int64)
        three, four = self.three(grams(data, 3)), self.four(grams(data, 4))
        p = self.pairs[two[1:]]
        p = three[1:, 1] + self.left[two[:-1]] * p
        p = four[1:, 2] + three[:-1, 0] * p
        five = self.five(grams(data)[1:])
        return five[:, 0] + four[:-1, 0] * p, five[:, 1] + four[:-1, 1] * p

    def ratios(self, data: np.ndarray) -> np.ndarray:
        """log P(byte | toxic) - log P(byte | ordinary) at each place from ORDER - 1 on."""
        plain, toxic = self.probabilities(np.concatenate([np.full(1, 32, np.uint8), data]))
        return np.log(toxic / plain)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, by length: the mean over its words of the square of what a word's log-likelihood ratio has above
        MARGIN. 0 for a text without words.

        A text's plain mean ratio tells above all which language it is in, as classes differ in their mix of languages,
        and each of its words adds a little; the margin leaves that out, and the square lets few plain words outweigh
        many doubtful ones."""
        data, ends = stream(texts)
        out = np.zeros(len(texts))
        if len(data) < ORDER:
            return out
        begins = np.flatnonzero(data[ORDER - 1 :] == 32)
        words = np.maximum(np.add.reduceat(self.ratios(data), begins) - MARGIN, 0) ** 2
        sums = np.concatenate([[0.0], np.cumsum(words)])
        first = np.searchsorted(begins, ends - (ORDER - 1))
        n = np.diff(first)
        some = n > 0
        out[some] = (sums[first[1:]] - sums[first[:-1]])[some] / n[some]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The evidence as a number in [0, 1]: 0.5 where it is at the cut."""
        x = np.maximum(self.evidence(texts), 0)
        return np.ones(len(x)) if self.cut <= 0 else x / (x + self.cut)


MARGIN = 2.0


def count_grams(labelled: DataFrame) -> DataFrame:
    """code, and in how many texts of either label each 5-gram stands: plain, toxic, and of these in texts of part 0,
    plain0, toxic0. labelled: text, toxic, part.

    Texts, not places, are counted, so that a text that repeats itself has no more say than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for kind in range(4):
                own = [np.unique(grams(stream([t])[0])) for t, x in zip(texts, kinds) if x == kind and t]
                if own:
                    codes, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(np.full(len(codes), kind, np.int32)), pa.array(n.astype(np.int64))], ["code", "kind", "n"])

    kind = (F.col("toxic") + F.when(F.col("part") == 0, 2).otherwise(0)).cast("int")
    counted = labelled.select("text", kind.alias("kind")).mapInArrow(run, "code long, kind int, n long")
    names = {"plain": "kind % 2 = 0", "toxic": "kind % 2 = 1", "plain0": "kind = 2", "toxic0": "kind = 3"}
    return counted.groupBy("code").agg(*[F.coalesce(F.sum(F.when(F.expr(which), F.col("n"))), F.lit(0)).cast("int").alias(c) for c, which in names.items()])


def _shares(codes: np.ndarray, n: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct codes with counts: discounted share of each in its context; the contexts; what each leaves."""
    contexts, of = np.unique(codes >> np.uint64(8), return_inverse=True)
    sums, kinds = np.bincount(of, n), np.bincount(of)
    return np.maximum(n - discount, 0) / sums[of], contexts, discount * kinds / sums


def fit_counts(codes: np.ndarray, plain: np.ndarray, toxic: np.ndarray, discount: float = 0.75) -> Model:
    """The models of counts of distinct 5-grams.

    Each class has its own 5-gram counts. Below, both share one model, whose counts are Kneser-Ney's: of a shorter
    gram, how many different bytes stand before it, in texts of either class. So an expression that one class has
    hardly seen isn't evidence as long as its parts are common."""
    own, contexts, rest = [], [], []
    for n in (plain, toxic):
        have = n > 0
        share = np.zeros(len(codes))
        share[have], c, r = _shares(codes[have], n[have], discount)
        own.append(share)
        contexts.append(c)
        rest.append(r)
    five = Table(codes, *own, absent=(0, 0))

    shared = {}
    shorter, n = codes, None
    for order in (4, 3, 2):
        shorter, n = np.unique(shorter & np.uint64((1 << 8 * order) - 1), return_counts=True)
        shared[order] = (shorter, *_shares(shorter, n, discount))

    def joined(known: list[tuple[np.ndarray, np.ndarray]], absent: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        every = np.unique(np.concatenate([k for k, _ in known]))
        out = []
        for (k, v), x in zip(known, absent):
            column = np.full(len(every), float(x))
            column[np.searchsorted(every, k)] = v
            out.append(column)
        return every, out

    every, columns = joined([(contexts[0], rest[0]), (contexts[1], rest[1]), shared[4][:2]], (1, 1, 0))
    four = Table(every, *columns, absent=(1, 1, 0))
    every, columns = joined([shared[4][2:], shared[3][:2]], (1, 0))
    three = Table(every, *columns, absent=(1, 0))
    left = np.ones(65536)
    left[shared[3][2].astype(np.int64)] = shared[3][3]
    ones, kinds = np.unique(shared[2][0] & np.uint64(255), return_counts=True)
    single = np.full(256, 1 / 256 / (kinds.sum() + 1))
    single[ones.astype(np.int64)] += kinds / (kinds.sum() + 1)
    rests = np.ones(256)
    rests[shared[2][2].astype(np.int64)] = shared[2][3]
    pairs = (rests[:, None] * single[None, :]).reshape(-1)
    pairs[shared[2][0].astype(np.int64)] += shared[2][1]
    return Model(five, four, three, left.astype(np.float32), pairs.astype(np.float32))


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The evidence from which fewest rows are on the wrong side if called toxic; of a stretch of equally good cuts that
    holds the fewest wrong, the middle of the widest. Above zero, since no evidence is never toxic."""
    values, at = np.unique(np.maximum(x, 0), return_inverse=True)
    wrong = np.bincount(at, np.where(y == 1, 1, -1), len(values))
    # errors[i]: toxic rows below values[i] and ordinary rows from it on; one more for a cut above all.
    errors = np.concatenate([[0], np.cumsum(wrong)]) + (y == 0).sum()
    low, high = np.concatenate([[0.0], values]), np.concatenate([values, [4 * values[-1] + 1]])
    ok = high > 0
    good = np.flatnonzero(ok & (errors == errors[ok].min()))
    widest = good[np.argmax(high[good] - low[good])]
    return float((low[widest] + high[widest]) / 2)


def training_keys(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """key, toxic, part of the documents to learn from: labelled 0 or 1, not held out, one of each text, about `most` of
    either label and never over twice as many in all. part, 0 to 4, follows from the text.

    Labels are sampled by hash of the key before documents are met, and documents are met by a broadcast of that bounded
    sample, so no text moves."""
    known = labels.where("toxic IN (0, 1)").select(F.col(id_col).alias("key"), "toxic").where(F.col("key").isNotNull() & ~held_out("key")).distinct()
    share = F.lit(0.0)
    for r in known.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == r.toxic, F.lit(min(1.0, most / r["count"]))).otherwise(share)
    sampled = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).limit(4 * most)
    texts = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("text_hash")).join(F.broadcast(sampled), "key")
    one = texts.groupBy("text_hash", "toxic").agg(F.min("key").alias("key"))
    return written(one.select("key", "toxic", F.pmod("text_hash", F.lit(5)).alias("part")), "toxicity-keys")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 25_000) -> Model:
    """Models of the labelled documents that aren't held out, about `most` of either label (a documented bound of what a
    classifier learns from). Models of four fifths of their texts set the cut on the last fifth, then models of all of
    them score.

    Every 5-gram of those texts is kept, so the model's size follows from them. Without both labels every score is 0, or 1
    if there are only toxic ones."""
    keys = training_keys(docs, labels, id_col, text_col, most)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(keys), "key")
    counts = count_grams(rows).toArrow()
    codes, plain, toxic, plain0, toxic0 = (c.to_numpy() for c in counts.columns)
    codes, cut = codes.astype(np.uint64), None
    of = {(r.toxic, r.last): r.n for r in keys.groupBy("toxic", (F.col("part") == 0).alias("last")).agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {label for label, _ in of}
    if len(known) < 2:
        cut = 0.0 if 1 in known else float("inf")
    elif all(of.get((label, last)) for label in (0, 1) for last in (True, False)):
        part = plain + toxic > plain0 + toxic0
        cut = _cut_on(rows.where("part = 0"), fit_counts(codes[part], (plain - plain0)[part].astype(float), (toxic - toxic0)[part].astype(float)))
    model = fit_counts(codes, plain.astype(float), toxic.astype(float))
    model.cut = _cut_on(rows, model) if cut is None else cut
    return model


def _cut_on(rows: DataFrame, model: Model) -> float:
    found = score_rows(rows, model, ["toxic"], evidence=True).toPandas()
    return best_cut(found.x.to_numpy(float), found.toxic.to_numpy(int))


def score_rows(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", evidence: bool = False, rows: int = 64) -> DataFrame:
    """`columns` of docs with `score`, or with the evidence `x`. The model, whose size follows from what it learned from, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    few = docs.select(*columns, F.col(text_col).alias("_text"))
    into = "x" if evidence else "score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                texts = batch.column(len(columns)).to_pylist()
                out = pa.array(m.evidence(texts) if evidence else m.score(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], out], [*columns, into])

    return few.mapInArrow(run, few.drop("_text").withColumn(into, F.lit(None).cast("double")).schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Only the text enters the score.

    A text without words, null too, has no evidence and scores 0. Repeated rows score alike. Without labels of both kinds every score is 0 (1 if there
    are toxic ones only). An empty table gives an empty result."""
    model = model or fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score_rows(rows.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is below the threshold."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                yield batch.filter(pa.array(m.score(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, schema)

