"""Token counts of a byte-level BPE tokenizer by a two-tier lookup of pre-tokens (operator 2).

A text's count is the sum of its pre-tokens' counts, so nothing but pre-token lengths is needed.
Texts are split many at a time by array operations (``pretokens``), and each pre-token is a 64-bit hash.
Tier one is a hash table of frequent pre-tokens and their lengths, counted over a bounded sample of
documents and broadcast (at most ``TABLE_ROWS`` entries).  Tier two is a table of ``CACHE_ROWS`` slots in each Python
worker, filled by the tokenizer itself with each batch's misses, the latest one keeping its slot.  No
pre-token of the corpus is shuffled.  Which pre-tokens are in which tier changes the time and never a count.

Texts that hold the string of a special token are encoded whole by the tokenizer; texts with a character
that Unicode's tables in Python leave unassigned are split by the tokenizer's own splitter.

Defined cases: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
texts are neither truncated nor padded, whatever their length; repeated rows are counted each;
other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import pretokens, words
from cargolens.llm.common import bounded_sample, importable_on_workers, kept, text_of, tidy
from cargolens.llm.pretokens import PATTERN

LIMIT = 1024
SAMPLE_DOCS = 2000
TOP = 2048
TABLE_ROWS = 1 << 15
CACHE_ROWS = 1 << 20

#: Characters that every Unicode version and both libraries class alike (a test goes through all of them).
SURE = ((0x0000, 0x0557), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096),
        (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


class _Lengths:
    """Lengths by hash in a table with one slot for each remainder; a later entry takes the slot."""

    def __init__(self, slots: int):
        self.slots = words.U(slots)
        self.key = np.zeros(slots, words.U)
        self.size = np.zeros(slots, np.int32)

    def put(self, h: np.ndarray, size: np.ndarray) -> None:
        at = h % self.slots
        self.key[at] = h
        # Of several entries for one slot the one whose hash stands there gives the length.
        own = self.key[at] == h
        self.size[at[own]] = size[own]

    def get(self, h: np.ndarray) -> np.ndarray:
        """The length of each hash, 0 where it isn't known."""
        at = h % self.slots
        return np.where(self.key[at] == h, self.size[at], 0)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class TokenCounter:
    """Counts tokens with one tokenizer file; kept by the worker between batches."""

    def __init__(self, path: str, known: dict[str, int]):
        self.tokenizer = _tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        data, offsets = words.buffer(pa.array(list(known), pa.string()))
        self.known = _Lengths(1 << 18)
        if known:
            # Frequent ones come first: entered last, they keep their slots.
            self.known.put(pretokens.hashes(data, offsets[:-1], offsets[1:])[::-1], np.array(list(known.values()), np.int32)[::-1])
        self.cache = _Lengths(CACHE_ROWS)

    def lengths(self, pieces: list[str]) -> list[int]:
        # The library's results are heavy objects: some pieces at a time.
        return [len(e.ids) for k in range(0, len(pieces), 1000) for e in self.tokenizer.encode_batch(pieces[k: k + 1000], add_special_tokens=False)]

    def _whole(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """The texts that hold a special token's string."""
        out = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[d + 1]:
                    out.add(d)
                at = raw.find(token, at + 1)
        return sorted(out)

    def counts(self, texts: list[str] | pa.Array) -> list[int]:
        out: list[int] = []
        for _, _, data, offsets in words.groups(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            raw = data.tobytes()
            start, first = pretokens.split(data, offsets)
            end = np.append(start[1:], len(data)) if len(start) else start
            h = pretokens.hashes(data, start, end)
            size = self.known.get(h)
            missing = np.flatnonzero(size == 0)
            if len(missing):
                size[missing] = self.cache.get(h[missing])
                missing = missing[size[missing] == 0]
            if len(missing):
                new, one, code = np.unique(h[missing], return_index=True, return_inverse=True)
                some = missing[one]
                found = np.array(self.lengths([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]),
                                 np.int32)
                size[missing] = found[code]
                self.cache.put(new, found)
            n = np.diff(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[first]).tolist()
            for d in self._whole(raw, offsets):
                n[d] = len(self.tokenizer.encode(raw[offsets[d]: offsets[d + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids)
            out += n
        return out


def supported(path: str) -> bool:
    """Whether a file's pre-tokens are those of ``PATTERN`` and nothing is normalised before."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and (spec.get("model") or {}).get("type") == "BPE")


def _sample_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, seen = regex.compile(PATTERN).findall, Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(find(text.as_py()))
    top = seen.most_common(TOP)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top]), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])


def frequent(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> dict[str, int]:
    """The lengths of the pre-tokens that are most frequent in a bounded sample, most frequent first."""
    sample = bounded_sample(docs.select(id_col, text_of(text_col).alias("text")), id_col, SAMPLE_DOCS, 2)
    seen = sample.select("text").mapInArrow(_sample_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r["piece"] for r in seen.orderBy(F.desc("n"), "piece").limit(TABLE_ROWS).collect()]
    return dict(zip(pieces, TokenCounter(path, {}).lengths(pieces), strict=True)) if pieces else {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``path`` is the tokenizer's file, in the same place on every machine.
    """
    if not supported(path):
        raise ValueError(f"{path}: only byte-level BPE without normaliser has independent pre-tokens of this pattern")
    spark = docs.sparkSession
    importable_on_workers(spark)
    run = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(frequent(docs, path, text_col, id_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept((__name__, path, run), lambda: TokenCounter(path, table.value))
        for batch in batches:
            n = counter.counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: tidy(count(b)), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
