"""Small tests of mixing, sharding, byte BPE, SimHash and top-k search."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tessara.llm import bpe, mixing, sharding, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, size string, rate string, row string"


def docs(spark, rows):
    """rows: (doc_id, text, source); the extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, None, s, None, "a", "b", "c", "d") for i, t, s in rows], DOCS)


ODD = [(1, "", "a"), (2, None, "a"), (3, "one two three four", None), (4, "one two three four", "b"), (4, "one two three four", "b"), (None, "x " * 30_000, "b"), (None, None, None), (7, " \t\n", "c")]


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), "abcd"[min(3, int(rng.expovariate(0.8)))]) for i in range(2000)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 2000
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    share, open_, target = 1.5 * sum(size.values()), {"a": 5, "b": 2, "c": 1, "d": 5}, {}
    while True:
        level = (share - sum(target.values())) / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    by = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[by[r.doc_id]]) and r.source_size == size[by[r.doc_id]]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[by[r.doc_id]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 130
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect()))


def test_mix_odd(spark):
    got = mixing.mix(docs(spark, ODD), keep=True)
    assert got.count() == len(ODD)
    assert mixing.mixed(docs(spark, ODD)).columns == docs(spark, []).columns
    assert mixing.mix(docs(spark, [])).count() == 0


def test_shards(spark):
    names = sharding.shard_names(10)
    slots = sharding.lookup_table(names, 1009)
    assert set(Counter(slots).values()) <= {100, 101}
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(slots, fewer) if a != 9)
    assert moved < 0.15 * 1009
    heavy = Counter(sharding.lookup_table(names, 1009, {names[0]: 2}))
    assert heavy[0] > 1.8 * heavy[1]
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    placed = sharding.place(docs(spark, ODD), names, 1009)
    assert placed.count() == len(ODD) and placed.where("shard is null").isEmpty()
    assert placed.where("doc_id = 4").select("shard").distinct().count() == 1
    assert sharding.place(docs(spark, []), names, 1009).count() == 0


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello  world's\n\n <|endoftext|> 12345 ñandú x", "a" * 5000, " " * 3000, "!?" * 700, "日本語テキスト😀" * 50, "\x00\x01\xffz", "loweiß über_die-Straße"]


def test_bpe(spark, reference):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab e'st\né1.😀") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, None, None)])
    got = bpe.decode(bpe.encode(rows, kept=50))
    for r in got.collect():
        t = r.text or ""
        assert r.token_ids == reference.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    first = bpe.digest(got).where("doc_id = 2").first()
    assert first.ids_sha256 == hashlib.sha256(" ".join(map(str, reference.encode_ordinary(TEXTS[2]))).encode()).hexdigest()
    assert bpe.digest(bpe.decode(bpe.encode(docs(spark, [])))).count() == 0


def test_prefixes_append_and_replace(reference):
    v, rng = bpe.vocabulary(public_tokenizers.path(bpe.RANKS)), random.Random(3)
    v.longest = min(v.longest, 128)
    for _ in range(20):
        text = "".join(rng.choice("abcdest") for _ in range(300)).encode()
        p = bpe.Prefixes(v, text[:100])
        p.append(text[100:])
        assert p.last == bpe.Prefixes(v, text).last and p.tokens() == v.merge(text)
        s = rng.randint(0, 50)
        seen = p.replace(s, s + 3, b"xyzab")
        assert p.text == text[:s] + b"xyzab" + text[s + 3 :] and p.last == bpe.Prefixes(v, p.text).last
        assert seen < 300


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        base = [rng.choice("the of and to in a is that it was for on are as with".split()) + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 2, 5, 300]))]
        rows.append((3 * i + 1, " ".join(base), None))
        if i % 3 == 0 and base:
            for k in range(1, 3):
                base[rng.randrange(len(base))] = "zz"
                rows.append((3 * i + 1 - k, " ".join(base).upper(), None))
    rows += [(None, "same text here now", "a"), (1000, "same text here now", "a"), (1000, "same text here now", "a"), (2000, None, None)]
    got = simhash.digest(simhash.near_groups(docs(spark, rows))).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for g, (i, _, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{f:016x}", least.get(g)) for (i, _, _), f, g in zip(rows, fps, group))
    assert Counter(map(tuple, got)) == want
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.count() == len(set(group)) and kept.columns == docs(spark, []).columns
    assert simhash.near_groups(docs(spark, [])).count() == 0 == simhash.one_of_each(docs(spark, [])).count()


def test_links_of_hot_buckets(spark):
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(400):
        x = 0
        for b in rng.choice(64, 2, replace=False):
            x |= 1 << int(b)
        fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.components(simhash.links(frame, chunk=16)).collect()
    assert {r.node for r in got} == set(signed) and {r.label for r in got} == {min(signed)}


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(600)]
    rows += [(700, None), (701, [1.0, None]), (800, [float("nan")]), (801, [float("inf")]), (900, [1.0, 2.0]), (900, [1.0, 2.0]), (901, []), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rank string, id int")
    got = [tuple(r) for r in topk.top_k(frame, query_block=3, candidate_block=64).collect()]
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:10]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert Counter(got) == Counter(want)
    assert topk.top_k(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [3e38]), (1, [3e38]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_top_k_in_blocks(spark):
    """Copies that move: of a million rows each goes once as a candidate, and queries, a hundredth, to 64 blocks. Blocks,
    tiles and repeats of a row by the thousand change no result."""
    assert topk.blocks(1_000_000, 10_000, 65_536, 16_384) == (64, 1)
    assert topk.blocks(0, 0, 65_536, 16_384) == (1, 1) and topk.blocks(10**8, 10**6, 65_536, 16_384) == (1526, 62)
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(500)] + [(200, [3.0, 1.0, 0.0, 0.0, 0.0])] * 3 + [(7, [3.0] * 5)] * 2000
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter(map(tuple, topk.top_k(frame).collect()))
    got = Counter(map(tuple, topk.top_k(frame.orderBy("vec_id"), query_block=2, candidate_block=50, tile=300).collect()))
    assert got == want and sum(want.values()) == 80
    assert [r[2] for r in sorted(want) if r[0] == 0].count(7) <= 10
