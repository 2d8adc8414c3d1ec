"""Near duplicates and repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cargolens.llm import components as module
from cargolens.llm import minhash, phrases
from cargolens.llm.components import components
from cargolens.llm.words import FOLDED, Words, groups


def sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def linked(rows):
    s = sets([r for r in rows if r[0] is not None])
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in s:
        for j in s:
            common = len(s[i] & s[j])
            if i < j and s[i] and s[j] and 100 * common >= 75 * (len(s[i]) + len(s[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in s}, s


def test_near_duplicates_equal_brute_force(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    root, s = linked(rows)
    found = minhash.near_duplicates(awkward).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] and r["n_shingles"] == 2
        else:
            assert (r["component_id"], r["n_shingles"]) == (root[r["doc_id"]], len(s[r["doc_id"]]))
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_representatives_keep_columns_and_one_of_each_group(awkward, nothing):
    kept = minhash.keep_representatives(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and 6 not in ids and 7 not in ids and ids[None] == 1 and ids[0] == ids[1] == ids[2] == 1
    assert minhash.keep_representatives(nothing).count() == 0


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i % 5] + [f"own{i}"])) for i in range(24)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root, _ = linked(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == root


def test_sketch_fills_every_coordinate_and_estimates_likeness():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    a, b = np.unique(x[:600]), np.unique(x[100:700])
    s = minhash.sketches(np.concatenate([a, b, x[:1]]), np.array([len(a), len(b), 1]))
    assert (s != minhash.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 500 / 700) < 0.15
    single = minhash.sketches(x[:1], np.array([1]))
    assert (single[0] == s[2]).all()  # no matter what else is in the batch


def test_confirmed_links_of_two_sides():
    e = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(8, dtype=np.uint64)]
    n = np.array([10, 9, 8])
    assert minhash.confirmed_links(np.concatenate(e), n) == [(0, 1), (0, 2)]
    assert minhash.confirmed_links(np.concatenate(e), n, np.array([1, 1, 2])) == [(0, 2), (1, 2)]


def test_components_take_the_smallest_node(spark, monkeypatch):
    monkeypatch.setattr(module, "HASHED_FROM", 1)  # a natural round, then hashed ones
    edges = [(i, i + 1) for i in range(8)] + [(50, 40), (40, 60), (70, 70)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(9)} | {40: 40, 50: 40, 60: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k: k + 35]) for _, w in words for k in range(len(w) - 34))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k: k + 35])] > 1:
                gone[k: k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_passages_equal_brute_force(awkward, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    want = removed(rows)
    assert any(k[2] for k in want)
    for size in (8 << 20, 50_000):  # one block, several blocks
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        assert Counter(tuple(r) for r in phrases.remove_repeats(awkward).collect()) == want
    assert phrases.remove_repeats(nothing).count() == 0


def test_repeats_within_one_document(spark):
    w = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join(w + ["x"] + w)), (2, " ".join(["y"] * 36)), (3, " ".join(["z"] * 35))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in phrases.remove_repeats(df).collect()) == removed(rows)


def test_automata_are_cut_into_shards():
    numbers = np.array([1, 2, 3, 4, 9, 1, 2, 3, 5, 0, 4, 4], np.uint64)
    whole = phrases.locate(numbers, [(0, 3), (10, 12)])
    assert whole.tolist() == phrases.locate(numbers, [(0, 3), (10, 12)], shard_words=1).tolist()
    assert whole.tolist() == [True] * 3 + [False] * 2 + [True] * 3 + [False] * 2 + [True] * 2


def test_word_hashes_follow_the_words():
    texts = ["a b  A", "", "b c a", "\x0b a\x1c"]
    for *_, data, offsets in groups(pa.array(texts)):
        plain, folded = Words(data, offsets), Words(data, offsets, FOLDED)
        words = [w for t in texts for w in t.encode().split()]
        assert plain.n.tolist() == [len(t.encode().split()) for t in texts]
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                assert (plain.h[i] == plain.h[j]) == (a == b)
                assert (folded.h[i] == folded.h[j]) == (a.lower() == b.lower())
