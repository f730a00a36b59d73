"""License scans: fixed phrases, and templates compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates: words that must stand as they are, [[ ]] around what may be left out, {n} for up to n words of any kind.
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the {1} to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        [[the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {5} be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
        with the software or the use or other dealings in the software]]""",
    "mit-notice": "released under the [[terms of the]] mit license",
    "apache-2.0": """licensed under the apache license version 2 0 [[the license you may not use this {2} except in compliance with the
        license you may obtain a copy of the license at {10} unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
        express or implied]]""",
    "gpl-3.0": "this {2} is licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3 [[or [[at your option]] any later version]]",
    "gpl-header": """this {2} is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version {1} of the license or at your option any later version""",
    "cc-by-4.0": "licensed under [[a]] [[creative commons]] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[creative commons]] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[creative commons]] cc by sa 4 0",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[[[3]] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission]]""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
}

#: A-Z to lower case; every other ASCII character but letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
ANY = b"*any*"


@dataclass(frozen=True)
class Automaton:
    """States 0 .. n - 1, the last accepting. steps: next states by word, ANY for whatever word; free: without one."""

    anchor: bytes
    steps: tuple[dict[bytes, int], ...]
    free: tuple[tuple[int, ...], ...]

    def _close(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest match from start, exclusive."""
        states, end, last = self._close({0}), None, len(self.steps) - 1
        for i in range(start, len(words) + 1):
            if last in states:
                end = i
            if i == len(words):
                break
            states = self._close({t for s in states for t in (self.steps[s].get(words[i]), self.steps[s].get(ANY)) if t is not None})
            if not states:
                break
        return end


def compile_template(template: str) -> Automaton:
    """The automaton of a template. It must begin with a mandatory word; its first run of mandatory words is the anchor
    at which matching is tried."""
    steps: list[dict[bytes, int]] = [{}]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    anchor: list[bytes] = []
    running = True

    def state() -> int:
        steps.append({})
        free.append([])
        return len(steps) - 1

    for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
        now = len(steps) - 1
        if token == "[[":
            opened.append(now)
            free[now].append(state())
            running = False
        elif token == "]]":
            end = state()
            free[now].append(end)
            free[opened.pop()].append(end)
        elif token[0] == "{":
            first, n = now, int(token[1:-1])
            nodes = [first]
            for _ in range(n):
                nodes.append(state())
                steps[nodes[-2]][ANY] = nodes[-1]
            end = state()
            for s in nodes:
                free[s].append(end)
            running = False
        else:
            nxt = state()
            steps[now][token.encode()] = nxt
            if running:
                anchor.append(token.encode())
    if opened or not anchor:
        raise ValueError("a template needs a mandatory word first and brackets that close")
    return Automaton(b" ".join(anchor), tuple(steps), tuple(map(tuple, free)))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def places(line: bytes, phrase: bytes) -> list[int]:
    """The words at which the phrase stands. line: words with a space before, between and after."""
    out, wanted = [], b" " + phrase + b" "
    at, counted, word = line.find(wanted), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        out.append(word)
        at = line.find(wanted, at + 1)
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.encode(), label) for p, label in phrases.items()]
        self.automata = [(label, compile_template(t)) for label, t in templates.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """Number of words; matches (label, whether a fixed phrase, first word, end) by place."""
        words = split_words(text)
        line, found = b" " + b" ".join(words) + b" ", []
        for phrase, label in self.phrases:
            n = phrase.count(b" ") + 1
            found += [(label, True, i, i + n) for i in places(line, phrase)]
        for label, automaton in self.automata:
            for i in places(line, automaton.anchor):
                end = automaton.match(words, i)
                if end is not None:
                    found.append((label, False, i, end))
        return len(words), sorted(found, key=lambda m: (m[2], m[3], m[0]))


def covered(matches: list[tuple[str, bool, int, int]]) -> int:
    """Words that lie in a match. matches: by place."""
    total = reach = 0
    for _, _, s, e in matches:
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, columns: list[str] | None = None, text_col: str = "text", rows: int = 512) -> DataFrame:
    """`columns` of docs (doc_id if not given) with n_words, matches (array of struct label, phrase, s, e: words, the
    end exclusive) and score, the share of the text's words that lie in a match.

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased; texts of any length are scanned
    whole. A template is accepted where all its mandatory words stand in order with nothing but what its optional and
    replaceable regions allow between. Null and empty texts have no words, no match and score 0."""
    names = columns or ["doc_id"]
    few = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("_text"))
    known = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("s", pa.int64()), ("e", pa.int64())]))
    keys = ("label", "phrase", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*known)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                got = [scanner.scan(t.as_py()) for t in batch.column(len(names))]
                matches = pa.array([[dict(zip(keys, m)) for m in ms] for _, ms in got], kind)
                share = [covered(ms) / n if n else 0.0 for n, ms in got]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([n for n, _ in got], pa.int64()), matches, pa.array(share, pa.float64())], [*names, "n_words", "matches", "score"])

    more = "array<struct<label:string,phrase:boolean,s:bigint,e:bigint>>"
    return few.mapInArrow(run, few.drop("_text").select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(more).alias("matches"), F.lit(0.0).alias("score")).schema)


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("matches", lambda m: m.phrase)
    starts = F.transform(base, lambda m: m.s)

    def listed(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")

    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("matches")).alias("labels"), "score")
