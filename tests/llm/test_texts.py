"""Token counts, SentencePiece, personal data, fingerprints: against libraries and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargolens.llm import pii, simhash, token_counts
from cargolens.llm.sentencepiece_codec import Codec, decode_documents, encode_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(awkward, nothing):
    library = Tokenizer.from_file(BPE)
    texts = {(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()}
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts}
    found = token_counts.count_tokens(awkward, BPE).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(nothing, BPE).count() == 0


def test_sure_characters_are_classed_alike_by_both_libraries():
    import regex

    split = Tokenizer.from_file(BPE).pre_tokenizer.pre_tokenize_str
    find = regex.compile(token_counts.PATTERN).findall
    for a, b in token_counts.SURE:
        for c in map(chr, range(a, b + 1)):
            for x in "a1!":
                assert len(find(x + c)) == len(split(x + c)), hex(ord(c))


def test_other_tokenizers_are_refused(awkward):
    with pytest.raises(ValueError, match="pre-tokens"):
        token_counts.count_tokens(awkward, public_tokenizers.path("word_bpe_49k.json"))


def test_cache_generations_change_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 3)
    texts = ["the quick brown fox", "jumps over the lazy dog", "the dog"] * 3
    library = Tokenizer.from_file(BPE)
    assert token_counts.TokenCounter(BPE, {"the": 1}).counts(texts) == [len(library.encode(t).ids) for t in texts]


@pytest.fixture(scope="module")
def codec():
    return Codec(PIECES)


def test_sentencepiece_ids_equal_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkETAOIN0123456789.,-'éüß \n"
    texts = ["", " ", "  a", "x" + " " * 40 + "y", "end   ", "a" * 100, "ab" * 300, "<s> 你好 😀 ﬁ", "=========== ......"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    assert [list(i) for i in codec.encode(texts)] == library.encode(texts)
    assert [codec.decode(i) for i in codec.encode(texts)] == texts


def test_sentencepiece_round_trip(awkward, nothing):
    rows = encode_documents(awkward)
    for r in rows.join(awkward.select("doc_id", "text"), "doc_id").collect():
        assert r["round_trip"] == ("▁" not in (r["text"] or "")) and r["n_tokens"] == len(r["ids"])
    back = {r["doc_id"]: r["text"] for r in decode_documents(rows).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in awkward.select("doc_id", "text").collect()}
    assert encode_documents(nothing).count() == 0


def test_feistel_is_a_permutation_that_can_be_undone():
    p = pii.Permutation(b"k")
    for size in (2, 7, 100, 1000):
        images = [p.forward(x, size, b"t") for x in range(size)]
        assert sorted(images) == list(range(size))
        assert [p.backward(y, size, b"t") for y in images] == list(range(size))
    assert [p.forward(x, 1000, b"t") for x in range(20)] != [pii.Permutation(b"l").forward(x, 1000, b"t") for x in range(20)]


def test_pseudonyms_keep_formats_and_link_equal_values():
    p = pii.Permutation(b"k")
    text = ("card 4111 1111 1111 1111, account 9807915762804490!! mail that.71@mail4.example.com, ip 233.254.104.120, "
            "call +1 (017) 555-7713, born 1984-02-29 or 29.02.1984, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32; "
            "again 4111 1111 1111 1111; not 999.999.1.1, 2023-02-30 or version 1.2")
    new, found = pii.rewrite(text, p)
    assert found == {"card": 2, "account": 1, "email": 1, "ip": 1, "phone": 1, "date": 2, "ssn": 1, "iban": 1}
    for gone in ("4111", "9807915762804490", "that.71", "233.254.104.120", "555-7713", "1984", "123-45-6789", "WEST"):
        assert gone not in new
    assert "999.999.1.1, 2023-02-30 or version 1.2" in new and "@mail4.example.com" in new and "+1 (" in new
    assert [len(w) for w in new.split()][:5] == [len(w) for w in text.split()][:5]
    card = new[5:24]
    assert new.count(card) == 2
    digits = card.replace(" ", "")
    assert pii.luhn_digit(digits[:-1]) == digits[-1]
    iban = new[new.index("iban ") + 5:].split(";")[0].replace(" ", "")
    assert pii._iban_check(iban[:2], iban[4:]) == 98 - int(iban[2:4])
    again, more = pii.rewrite(new, p)
    assert more == found and again != new


def test_values_end_at_group_borders():
    p = pii.Permutation(b"k")

    def of(text):
        return pii.rewrite(text, p)

    for iban, tail in [("ES91 2100 0418 4502 0005 1332", " EUR"), ("BE68 5390 0754 7034", " BIC"), ("BE68 5390 0754 7034", " TOTAL"),
                       ("BE68 5390 0754 7034", " 12 EUR")]:
        new, found = of(iban + tail)
        assert found == {"iban": 1} and new == of(iban)[0] + tail != iban + tail
    for tail in (" 05/27", " 123", "-05", ""):
        new, found = of("4111 1111 1111 1111" + tail)
        assert found == {"card": 1} and new == of("4111 1111 1111 1111")[0] + tail and "4111 1111" not in new
    assert of("XX12 4111 1111 1111 1111")[0] == "XX12 " + of("4111 1111 1111 1111")[0]  # no IBAN, but a card
    for phone in ("06 12 34 56 78", "+33 1 23 45 67 89", "06.12.34.56.78"):
        new, found = of(phone)
        assert found == {"phone": 1} and new != phone and len(new) == len(phone)
    new, found = of("at 2023-02-28T10:15:00Z")
    assert found == {"date": 1} and new.endswith("T10:15:00Z") and "2023-02-28" not in new
    for plain in ("0000 0000 0000 0000", "2023-02-28Today", "999.999.1.1"):
        assert of(plain) == (plain, {})


def test_personal_data_rows(awkward, nothing):
    rows = {r["doc_id"]: r for r in pii.find_personal(awkward).collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[14]["kinds"] == "email:1,phone:1"
    texts = {r["doc_id"]: r["text"] for r in awkward.select("doc_id", "text").collect()}
    assert all(r["text"] == texts[i] for i, r in rows.items() if not r["n_found"])
    same = pii.pseudonymise(awkward)
    assert same.schema == awkward.schema and same.count() == awkward.count() and pii.find_personal(nothing).count() == 0


def brute_print(spark, text):
    words = (text or "").encode().split()
    pairs = [(a.decode(), b.decode() if b else None) for a, b in zip(words, [*words[1:], None], strict=False)]
    if not pairs:
        return "0" * 32
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64(F.lit(1), "a", "b"), F.xxhash64(F.lit(2), "a", "b")).collect()
    out = 0
    for word in (0, 1):
        for bit in reversed(range(64)):
            ones = sum((x[word] >> bit) & 1 for x in rows)
            out = out << 1 | (2 * ones > len(rows))
    return f"{out:032x}"


def test_fingerprints_equal_brute_force(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
    by_id = dict(rows)
    ids = sorted(i for i in by_id if i is not None)
    found = simhash.edit_likeness(awkward).collect()
    assert len(found) == len(rows)
    prints = {}
    for r in found:
        i, text = r["doc_id"], by_id[r["doc_id"]]
        n, half = len(text), len(text) // 2
        nxt = by_id[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        edited = text[: n - half] + nxt[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        if len(text) < 5000:
            assert r["fingerprint"] == brute_print(spark, text)
        prints[i] = int(r["fingerprint"], 16)
        assert r["near_edited"] == 1 - (prints[i] ^ int(r["edited_fingerprint"], 16)).bit_count() / 128
        assert (r["near_next"] is None) == (i is None)
    assert prints[5] == prints[6]
    assert simhash.edit_likeness(nothing).count() == 0


def test_block_tables_find_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(6)]
    rows, prints = [], {}
    for i in range(60):
        x = base[i % 6]
        for b in rng.choice(128, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        prints[i] = x
        hi, lo = ((v - (1 << 64) if v >> 63 else v) for v in (x >> 64, x & ((1 << 64) - 1)))
        rows.append((i, hi, lo))
    members, pairs = simhash.near_pairs(spark.createDataFrame(rows, "id long, hi long, lo long"), radius=3)
    cls = {r["id"]: r["class_id"] for r in members.collect()}
    got = sorted((r["a"], r["b"], r["bits"]) for r in pairs.collect())
    reps = sorted(set(cls.values()))
    want = sorted((a, b, (prints[a] ^ prints[b]).bit_count()) for a in reps for b in reps if a < b and (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == want and want and all(prints[i] == prints[c] for i, c in cls.items())
