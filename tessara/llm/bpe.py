"""Byte-level BPE by a table of last tokens, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
SHORT = (3, 2, 1)
#: Beginnings of pieces whose tables are kept.
HEADS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, and which two tokens may stand side by side.

    The encoding of a text is the only sequence of tokens in which each token encodes to itself and each pair of
    neighbours encodes to just that pair; so the last token of every prefix of a text is unique, and follows from the
    last token of a shorter prefix.
    """

    def __init__(self, ranks: dict[bytes, int], pairs_kept: int = 1_000_000):
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.longest, self.pairs_kept = max(map(len, ranks), default=1), pairs_kept
        self.valid: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.heads: dict[bytes, list[int]] = {}
        #: Sizes of the tokens that end in four bytes, the largest first, with those of all short ones.
        by: dict[bytes, set[int]] = {}
        for raw in ranks:
            if len(raw) > 3:
                by.setdefault(raw[-4:], set()).add(len(raw))
        self.sizes = {end: (*sorted(n, reverse=True), *SHORT) for end, n in by.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by its definition: the lowest-ranked neighbours merge, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None of a byte, and of a token that no merge makes."""
        raw = self.bytes[token]
        now = [raw[i : i + 1] for i in range(len(raw))]
        while len(now) > 2:
            ranks = [self.ranks.get(now[i] + now[i + 1], token) for i in range(len(now) - 1)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] >= token:
                return None
            now[i : i + 2] = [now[i] + now[i + 1]]
        return (self.ranks[now[0]], self.ranks[now[1]]) if len(now) == 2 else None

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to just the token."""
        if (found := self.whole.get(token)) is None:
            found = self.whole[token] = len(self.bytes[token]) == 1 or self.parts(token) is not None
        return found

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (1) end while it is made, the last first, each with the rank at
        which it is merged into the next larger."""
        if (found := self.edges[side].get(token)) is None:
            found, now, until = [], token, float("inf")
            while True:
                found.append((self.bytes[now], until))
                parts = self.parts(now)
                if parts is None:
                    break
                until, now = now, parts[side]
            self.edges[side][token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b encode to just a and b.

        They do unless something at the right end of a and something at the left end of b merge before either is merged
        into what is larger in its own token. Of equal ranks the one further left merges first."""
        if (found := self.valid.get((a, b))) is None:
            if len(self.valid) >= self.pairs_kept:
                self.valid.clear()
            ranks, left = self.ranks, self._edge(b, 0)
            found = True
            for x, x_until in self._edge(a, 1):
                for y, y_until in left:
                    rank = ranks.get(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        found = False
                        break
                if not found:
                    break
            self.valid[a, b] = found
        return found


    def last_token(self, text: bytes, last: list[int], i: int) -> int:
        """The last token of text[:i], from those of shorter prefixes."""
        rank, valid = self.ranks.get, self.valid.get
        for n in self.sizes.get(text[i - 4 : i], SHORT) if i > 3 else SHORT[3 - i :]:
            start = i - n
            if start < 0:
                continue
            token = rank(text[start:i])
            if token is None:
                continue
            if start:
                before = last[start - 1]
                ok = valid((before, token))
                if ok is None:
                    ok = self.stands(token) and self.fits(before, token)
                if ok:
                    return token
            elif self.stands(token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """last, the last tokens of the first prefixes, for all prefixes of text."""
        find = self.last_token
        for i in range(len(last) + 1, len(text) + 1):
            last.append(find(text, last, i))
        return last

    def back(self, last: list[int]) -> list[int]:
        """The tokens of the text whose prefixes have these last tokens."""
        out, i, raw = [], len(last), self.bytes
        while i:
            token = last[i - 1]
            out.append(token)
            i -= len(raw[token])
        out.reverse()
        return out

    def encode(self, text: bytes) -> list[int]:
        """The tokens of a piece. Pieces that begin alike share the table of their beginning: those of 5 and 9 bytes are
        kept, up to a number."""
        last: list[int] = []
        heads, n = self.heads, len(text)
        for size in (9, 5):
            if n > size and (head := heads.get(text[:size])) is not None:
                last = head.copy()
                break
        known = len(last)
        self.extend(text, last)
        for size in (5, 9):
            if known < size < n:
                if len(heads) >= HEADS:
                    heads.clear()
                heads[text[:size]] = last[:size]
        return self.back(last)


class Prefixes:
    """The last token of each byte prefix of one piece. Appending extends it exactly; an edit recomputes from the edit
    to where the old table holds again."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.text += more
        self.vocabulary.extend(self.text, self.last)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Puts `by` for text[start:end]; returns how many prefixes were looked at again.

        Past the new bytes, a prefix's last token depends on the `longest` ones before alone; once that many in a row
        are as they were, so are all that follow."""
        text = self.text[:start] + by + self.text[end:]
        shift, old, last, same, seen = len(text) - len(self.text), self.last, self.last[:start], 0, 0
        for i in range(start + 1, len(text) + 1):
            last.append(self.vocabulary.last_token(text, last, i))
            seen += 1
            was = i - shift
            same = same + 1 if i > start + len(by) and was > end and old[was - 1] == last[-1] else 0
            if same >= self.vocabulary.longest:
                last += old[was:]
                break
        self.text, self.last = text, last
        return seen

    def tokens(self) -> list[int]:
        return self.vocabulary.back(self.last)


class Pieces(dict):
    """Tokens of pieces; a piece that is a token is that token.

    Two generations are kept: when the young one is full it becomes the old one, whose pieces come back when they are met
    again. So frequent pieces stay, rare ones go, and no more than twice `kept` are held."""

    def __init__(self, vocabulary: Vocabulary, kept: int):
        self.vocabulary, self.kept, self.old = vocabulary, kept, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode("utf-8")
            token = self.vocabulary.ranks.get(raw)
            out = (token,) if token is not None else tuple(self.vocabulary.encode(raw))
            if len(raw) > 64:
                return out
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(load_ranks(path))
    return _loaded[path]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", into: str = "token_ids", decoded: str | None = None, kept: int = 250_000, rows: int = 256) -> DataFrame:
    """docs with array<int> column `into` (replaced if there): the ids of each whole text, without special tokens.

    Null and empty texts have no ids. With `decoded`, a binary column of that name has the bytes that the ids decode to. The
    rank file is read on each executor by its path, which must be the same there.
    Up to twice `kept` pieces are remembered by each worker; rare and long ones are encoded anew, with the same result.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    columns = [c for c in docs.columns if c not in (into, decoded)]
    few = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text_col)
    names = [*columns, into, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, find = vocabulary(path), regex.compile(pattern).findall
        one = Pieces(v, kept).__getitem__
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                ids = [np.fromiter(chain.from_iterable(map(one, find(t.as_py() or ""))), np.int32) for t in batch.column(at)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    more.append(pa.array([v.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    schema = few.select("*", F.array().cast("array<int>").alias(into), *([F.lit(None).cast("binary").alias(decoded)] if decoded else [])).schema
    return few.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str | None = None, ids_col: str = "token_ids", into: str = "decoded", rows: int = 256) -> DataFrame:
    """df with binary column `into` (replaced if there): the bytes of the ids. Null: null. An unknown id fails."""
    path = ranks_path or public_tokenizers.path(RANKS)
    columns = [c for c in df.columns if c != into]
    few = df.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                out = [None if x.values is None else v.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*columns, into])

    return few.mapInArrow(run, few.select("*", F.lit(None).cast("binary").alias(into)).schema)


def digest(coded: DataFrame) -> DataFrame:
    ids = F.array_join("token_ids", " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
