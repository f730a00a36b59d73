"""Chunks of frames: a chunk ends when its span of indices is long enough, and enough keypoints are linked or it is twice as
long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

OUT = "sequence string, frame_index long, chunk long, closed boolean"


def indexed(frames: DataFrame, sequence: str = "sequence", order: str = "frame_id") -> DataFrame:
    """frames with frame_index in their order; frames without keypoints go, but keep the index that they had."""
    at = F.row_number().over(Window.partitionBy(sequence).orderBy(order)) - 1
    return frames.withColumn("frame_index", at.cast("long")).where("n_keypoints > 0")


class Fold:
    """State of one sequence: the chunk's number, its first index and the keypoints linked in it."""

    def __init__(self, size: int, linked: int, chunk: int = 0, first: int = -1, total: int = 0):
        self.size, self.linked, self.chunk, self.first, self.total = size, linked, chunk, first, total

    def step(self, index: int, links: int) -> tuple[int, bool]:
        """The frame's chunk, and whether the frame ends it."""
        if self.first < 0:
            self.first = index
        self.total += links
        span, now = index - self.first + 1, self.chunk
        ends = (span >= self.size and self.total > self.linked) or span >= 2 * self.size
        if ends:
            self.chunk, self.first, self.total = now + 1, -1, 0
        return now, ends


def chunks(frames: DataFrame, size: int = 30, linked: int = 1000) -> DataFrame:
    """sequence, frame_index, chunk, closed (whether the frame ends its chunk; the last frame of a sequence ends it too).
    frames: sequence, frame_index, links. A fold in order of the index; sequences are parallel."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, out = Fold(size, linked), []
        for r in pdf.sort_values("frame_index").itertuples():
            out.append((key[0], r.frame_index, *fold.step(int(r.frame_index), int(r.links))))
        if out:
            out[-1] = (*out[-1][:3], True)
        return pd.DataFrame(out, columns=["sequence", "frame_index", "chunk", "closed"])

    return frames.select("sequence", "frame_index", "links").groupBy("sequence").applyInPandas(run, OUT)


class Chunker(StatefulProcessor):
    """The fold as a stream: state is one row per sequence; rows of a batch are put in order of the index."""

    def __init__(self, size: int = 30, linked: int = 1000):
        self.size, self.linked = size, linked

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField(n, LongType()) for n in ("chunk", "first", "total")])
        self.state = handle.getValueState("fold", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (0, -1, 0)
        fold, out = Fold(self.size, self.linked, *map(int, old)), []
        for r in pd.concat(list(rows)).sort_values("frame_index").itertuples():
            out.append((key[0], r.frame_index, *fold.step(int(r.frame_index), int(r.links))))
        self.state.update((fold.chunk, fold.first, fold.total))
        yield pd.DataFrame(out, columns=["sequence", "frame_index", "chunk", "closed"])

    def close(self) -> None:
        pass


def chunk_stream(frames: DataFrame, size: int = 30, linked: int = 1000) -> DataFrame:
    """chunks() of a stream. Frames of a sequence must arrive in order from batch to batch; the last chunk
    stays open, as a stream doesn't know its end; flushed() closes it once the stream is over. Needs the RocksDB state store."""
    return frames.select("sequence", "frame_index", "links").groupBy("sequence").transformWithStateInPandas(Chunker(size, linked), OUT, "Append", "None")


def flushed(chunked: DataFrame) -> DataFrame:
    """What a finished chunk_stream() wrote, with the last frame of each sequence ending its chunk: the rows of chunks()."""
    last = chunked.groupBy(F.col("sequence").alias("__of")).agg(F.max("frame_index").alias("__last"))
    joined = chunked.join(last, F.col("sequence").eqNullSafe(F.col("__of")) & (F.col("frame_index") == F.col("__last")), "left")
    return joined.select("sequence", "frame_index", "chunk", (F.col("closed") | F.col("__last").isNotNull()).alias("closed"))


def relocate(index: DataFrame, poses: DataFrame, size: float = 2.0) -> DataFrame:
    """The state table of the visual index after images that were lost got a position."""
    from tessara.operators import graph

    return graph.index_locate(index, poses, size)
