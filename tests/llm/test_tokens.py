"""Byte-level BPE, its pre-tokens and the alignment of two tokenizers: against libraries and brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from cargolens.llm import byte_bpe, pretokens, words
from cargolens.llm import tokenizer_alignment as alignment
from cargolens.llm.packing import pack, pack_sorted, unpack, unpack_sorted

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["", "'s", "a's", "x'll's", "'re'", "''s", " 's", "I'm  ok\n\n y", "a\n", "  ", "\t x", "'ve", "٣é你😀!?.", "a b", "Ᲊx  ", "\x1c\x1d a"]


def split(texts):
    data, offsets = words.buffer(pa.array(texts, pa.string()))
    tokens, first = pretokens.split(data, offsets)
    return [np.diff(np.append(tokens[first[i]: first[i + 1]], offsets[i + 1])).tolist() for i in range(len(texts))]


def test_pretokens_are_the_library_s():
    rng = random.Random(1)
    letters = "absStTmMdrevl'' '  \n\t1٣é你😀!?.   Ᲊ　"
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    assert split(texts) == [[len(p) for p, _ in library(t)] for t in texts]


def test_characters_are_classed_as_by_the_library():
    library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = pretokens.class_table()
    points = np.array([i for i in range(0x110000) if table[i] != pretokens.UNSURE and not 0xD800 <= i < 0xE000])
    for mark, kind in (("a", pretokens.LETTER), ("1", pretokens.NUMBER), ("!", pretokens.OTHER)):
        for some in np.array_split(points, 40):
            text = "\n" + "\n".join(mark + chr(i) for i in some) + "\n"
            head = np.zeros(len(text) + 1, bool)
            head[[a for _, (a, _) in library(text)]] = True
            assert (~head[3 * np.arange(len(some)) + 2] == (table[some] == kind)).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    both = pretokens.hashes
    monkeypatch.setattr(pretokens, "hashes", lambda d, a, b, which=0: both(d, a, b, which) if which else both(d, a, b) % words.U(3))
    data = np.frombuffer(b"abcdeabc", np.uint8)
    start = np.arange(8)
    first, code = pretokens.distinct(data, start, start + 1)
    assert bytes(data[first][code]) == bytes(data) and len(first) == 5


def test_packed_numbers_come_back():
    x = np.array([5, 0, 70_000, 3_000_000_000])
    assert unpack(pack(x)).tolist() == x.tolist() and unpack(pack(np.zeros(0, np.int64))).tolist() == []
    assert unpack_sorted(pack_sorted(np.sort(x), 8), 8).tolist() == sorted(x.tolist())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))})


@pytest.mark.parametrize("block, buckets", [(byte_bpe.BLOCK, None), (40, 7)])
def test_byte_bpe_ids_and_bytes(spark, awkward, library, block, buckets):
    rows = byte_bpe.encode_documents(awkward, MULTI, block_bytes=block, buckets=buckets)
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.select("doc_id", "text").collect()}
    back = byte_bpe.decode_documents(rows, MULTI).collect()
    assert len(back) == awkward.count()
    for r in back:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids"], bytes(r["decoded"])) == (len(ids), ids, texts[r["doc_id"]].encode())


def test_byte_bpe_awkward_texts(spark, nothing, library):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(AWKWARD)], "key string, text string").repartition(3)
    found = {r["key"]: r["ids"] for r in byte_bpe.encode_documents(docs, MULTI, "key").collect()}
    assert found == {f"d{i}": library.encode_ordinary(t) for i, t in enumerate(AWKWARD)}
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(nothing, MULTI), MULTI).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode_documents(odd, MULTI).collect()] == [b"", b""]


def by_hand(docs):
    """The whole definition, one token and one link at a time."""
    alphabet = alignment.byte_alphabet()
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found, held = [], Counter()
    for key, text in docs:
        sides = []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            sides.append([(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)])
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not text or any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
            found.append((key, 0, 0, [], ""))
            continue
        spans = []
        for s in sides:
            at, out = 0, []
            for i, t in s:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for i, x, y in spans[0]:
            while spans[1][j][2] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < y:
                links.append((i, spans[1][k][0]))
                k += 1
        groups, low = [], 0
        for end in sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, x, y in s if low <= x < end) for s in spans))
            low = end
        held.update(set(links))
        found.append((key, len(spans[0]), len(spans[1]), links, ";".join(groups)))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    return [(key, n_a, n_b, g.count("|"), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for key, n_a, n_b, links, g in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "partition_pairs": 10, "fan": 2}])
def test_alignment_by_hand(spark, awkward, nothing, sizes):
    docs = awkward.where("length(text) < 20000 OR text IS NULL")
    rows = docs.select("doc_id", "text").collect()
    # Digits written with "|" in a text don't occur, so counting "|" counts groups.
    assert ordered(alignment.align_documents(docs, BPE, PIECES, with_groups=True, **sizes).collect()) == ordered(by_hand(rows))
    assert alignment.align_documents(nothing, BPE, PIECES, **sizes).count() == 0


def test_alignment_of_a_very_long_text(spark, awkward):
    found = alignment.align_documents(awkward, BPE, PIECES).where("n_a > 20000").collect()
    assert len(found) == 1 and found[0]["n_links"] >= found[0]["n_a"]


def test_alignment_refuses_other_tokenizers(awkward):
    with pytest.raises(ValueError, match="byte-level"):
        alignment.align_documents(awkward, public_tokenizers.path("word_bpe_49k.json"), PIECES)


def test_merging_runs_keeps_every_pair_once():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 500, 60)) for _ in range(9)]
    frames = sorted((int(r[k]), n, k) for n, r in enumerate(runs) for k in range(0, len(r), 7))
    rows = iter([(0, 0, first, pack_sorted(runs[n][k: k + 7], 8), pack(np.ones(len(runs[n][k: k + 7]), np.int64), 8)) for first, n, k in frames])
    chunks = list(alignment._chunks(rows))
    pairs = np.concatenate([c[0] for c in chunks])
    want = Counter(x for r in runs for x in r.tolist())
    assert (np.diff(pairs) > 0).all()
    assert dict(zip(pairs.tolist(), np.concatenate([c[1] for c in chunks]).tolist(), strict=True)) == want
