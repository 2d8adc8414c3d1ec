"""Removal of repeated passages by phrase automata (operator 5).

A window is ``WINDOW`` consecutive words of one document; words covered by a window whose sequence also
starts anywhere else are removed.

1. *Confirm recurring passages.*  The anchor of a window is its smallest hash of ``GRAM``
   neighbouring words, so equal windows have equal anchors.  A segment is a run of windows with one
   anchor (some 60 words); each document is read as a list of segments, one row for about 14 windows.
   Anchors are counted: one that occurs once has no repeated window.  An anchor with only one segment
   text, seen more than once, is settled: all its windows recur.  Where segments differ under one
   anchor, or an anchor occurs twice within a segment, the windows themselves are counted.
2. *Compile automata.*  Documents are dealt to blocks of about ``BLOCK_BYTES``.  In each block the
   confirmed passages (longest runs of recurring windows, each text once) become Aho-Corasick
   automata over word numbers, in shards of about ``SHARD_WORDS``, so their memory is bounded.
3. *Stream all documents* of the block through the shards; every hit covers its words.

Counts are taken in Spark with partial sums where the texts are read, so a passage that a third of all
documents share moves as one row a task.  Equality is that of two independent 64-bit hashes.

Defined cases: null text has no words; documents shorter than a window keep everything; a repeated row
is another place where its windows start; rows without an id are handled alike and keep their null id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import cut, importable_on_workers, total_bytes
from cargolens.llm.words import PLACES, U, Words, groups, mix, range_sums

WINDOW = 35
GRAM = 8
SPAN = WINDOW - GRAM + 1
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 600_000
#: Blocks whose numbers are gathered in one row while windows are counted.
BLOCKS_IN_ROW = 4096


class Segments:
    """The segments of a batch: word ranges [start, end), anchor, hash of the words, document, and
    whether the anchor's phrase occurs in it more than once."""

    __slots__ = ("anchor", "document", "end", "hash", "repeats", "start")

    def __init__(self, words: Words):
        h = words.h
        n = len(h)
        doc = words.document()
        last = words.first[1:][doc] - WINDOW
        at = np.flatnonzero(np.arange(n) <= last)
        if not len(at):
            self.start = self.end = self.document = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, U)
            self.repeats = np.zeros(0, bool)
            return
        g = np.zeros(n, U)
        for i in range(GRAM):
            g[: n - GRAM + 1] += h[i: n - GRAM + 1 + i] * PLACES[i]
        g = mix(g)
        low, have = g.copy(), 1
        while have < SPAN:  # least of ``have`` neighbours, doubled
            step = min(have, SPAN - have)
            low[: n - step] = np.minimum(low[: n - step], low[step:])
            have += step
        m = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        self.start = at[head]
        self.end = at[np.append(head[1:], len(at)) - 1] + WINDOW
        self.anchor = m[head]
        self.document = doc[self.start]
        self.hash = mix(range_sums(h, self.start, self.end) + (self.end - self.start).astype(U))
        grams = self.end - self.start - GRAM + 1
        first = np.cumsum(grams) - grams
        place = np.arange(int(grams.sum())) - np.repeat(first, grams) + np.repeat(self.start, grams)
        self.repeats = np.add.reduceat((g[place] == np.repeat(self.anchor, grams)).astype(np.int64), first) > 1

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of the chosen segments, and the segment's anchor for each."""
        k = (self.end - self.start - WINDOW + 1)[chosen]
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.start[chosen], k)
        return at, np.repeat(self.anchor[chosen], k)


def window_hashes(words: Words, at: np.ndarray) -> np.ndarray:
    return mix(range_sums(words.h, at, at + WINDOW))


def _unique(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct key and how often it occurs."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order)))


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for a, b, data, offsets in groups(batch.column(1)):
            s = Segments(Words(data, offsets))
            block = blocks[a:b][s.document]
            one, n = _unique(s.anchor, s.hash, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchor[one].view(np.int64)), pa.array(s.hash[one].view(np.int64)), pa.array(block[one].astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(s.repeats[one])], names=["anchor", "seg", "block", "n", "again"])


def _mixed_windows(left: pa.Table, right: pa.Table) -> pa.Table:
    """Windows of the block's segments whose anchors are in ``right``, each once with its number."""
    wanted = np.unique(right.column("anchor").to_numpy())
    found = []
    if len(wanted):
        for _, _, data, offsets in groups(left.column("text")):
            words = Words(data, offsets)
            s = Segments(words)
            at, anchor = s.windows(np.isin(s.anchor.view(np.int64), wanted))
            found.append((anchor, window_hashes(words, at)))
    anchor = np.concatenate([x for x, _ in found]) if found else np.zeros(0, U)
    w = np.concatenate([x for _, x in found]) if found else np.zeros(0, U)
    one, n = _unique(anchor, w)
    block = left.column("block")[0].as_py() if len(left) else 0
    return pa.table({"anchor": pa.array(anchor[one].view(np.int64)), "win": pa.array(w[one].view(np.int64)),
                     "block": pa.array(np.full(len(one), block, np.int32)), "n": pa.array(n.astype(np.int64))})


#: Characters that can stand for words, and words of a phrase that is compiled in one piece (a shard has at most twice as many).
CHARACTERS, LONGEST = 0x110000 - 0x800 - 1, 500_000


def locate(numbers: np.ndarray, phrases: list[tuple[int, int]], shard_words: int = SHARD_WORDS) -> np.ndarray:
    """Which of the ``numbers`` (one for each word, documents apart by a number of their own) are
    covered by an occurrence of a phrase.  Phrases are ranges of ``numbers``; they are compiled
    into automata shard by shard and all numbers are streamed through each."""
    edge = np.zeros(len(numbers) + 1, np.int64)
    pieces = []
    for a, b in phrases:  # the parts of a very long one share a window less one word
        while b - a > LONGEST:
            pieces.append((a, a + LONGEST))
            a += LONGEST - (WINDOW - 1)
        pieces.append((a, b))
    text, whole = _coded(numbers, pieces)
    i = 0
    while i < len(pieces):
        automaton, size, first = ahocorasick.Automaton(), 0, i
        while i < len(pieces) and size < min(shard_words, LONGEST):
            size += pieces[i][1] - pieces[i][0]
            i += 1
        if not whole:  # more different words than there are characters: numbered anew for each shard
            text, _ = _coded(numbers, pieces[first:i])
        for a, b in pieces[first:i]:
            automaton.add_word(text[a:b], b - a)
        automaton.make_automaton()
        for end, length in automaton.iter(text):
            edge[end - length + 1] += 1
            edge[end + 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def _coded(numbers: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[str, bool]:
    """The words as characters, and whether there are enough of those for the words of the ranges.

    Words outside all ranges share character 0: they end every match.
    """
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, np.array([a for a, _ in ranges], np.int64), 1)
    np.add.at(inside, np.array([b for _, b in ranges], np.int64), -1)
    known = np.unique(numbers[np.cumsum(inside)[:-1] > 0])
    if len(known) > CHARACTERS:
        return "", False
    if not len(known):
        return "\0" * len(numbers), True
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    code = np.where(known[at] == numbers, at + 1, 0).astype(np.uint32)
    code[code >= 0xD800] += 0x800  # these code points have no characters
    return code.tobytes().decode("utf-32-le"), True


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    """Removes from the block's documents what the confirmed phrases of ``right`` cover."""
    anchor, win = right.column("anchor").to_numpy(), right.column("win").fill_null(0).to_numpy()
    single = right.column("win").is_null().to_numpy()
    settled = np.unique(anchor[single])
    order = np.argsort(win[~single], kind="stable")
    wins, owners = win[~single][order], anchor[~single][order]
    parts, phrases, numbers, shift = [], [], [], 0
    names, ranges = [], []
    for a, b, data, offsets in groups(left.column("text")):
        words = Words(data, offsets)
        parts.append((a, b, data, offsets, words.first, shift))
        # A number between the documents that no word has keeps matches inside one document.
        numbers.append(np.insert(words.h, words.first[1:], U(0)))
        if len(right):
            s = Segments(words)
            recurs = np.zeros(len(words.h) + 1, bool)
            recurs[s.windows(np.isin(s.anchor.view(np.int64), settled))[0]] = True
            if len(wins):
                at, own = s.windows(np.isin(s.anchor.view(np.int64), owners))
                w = window_hashes(words, at).view(np.int64)
                k = np.minimum(np.searchsorted(wins, w), len(wins) - 1)
                recurs[at[(wins[k] == w) & (owners[k] == own.view(np.int64))]] = True
            # A passage is a run of windows that recur, as far as it goes in its document.
            i = np.flatnonzero(recurs)
            d = words.document()[i]
            cut_here = np.flatnonzero((i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])) + 1
            start = i[np.append(0, cut_here)] if len(i) else i
            end = i[np.append(cut_here, len(i)) - 1] + WINDOW if len(i) else i
            doc = words.document()[start]
            names.append(mix(range_sums(words.h, start, end) + (end - start).astype(U)))
            ranges.append(np.stack([start + doc, end + doc], 1) + shift)
        shift += len(words.h) + (b - a)
    flat = np.concatenate(numbers) if numbers else np.zeros(0, U)
    if sum(map(len, names)):
        r = np.concatenate(ranges)
        one, _ = _unique(np.concatenate(names))
        phrases = [tuple(x) for x in r[np.sort(one)].tolist()]
    covered = locate(flat, phrases) if phrases else np.zeros(len(flat), bool)
    n_words, n_removed, sha = [], [], []
    for a, b, data, offsets, first, at in parts:
        raw = data.tobytes()
        for d in range(b - a):
            i, j = int(first[d]) + d + at, int(first[d + 1]) + d + at
            gone = covered[i:j]
            removed = int(gone.sum())
            kept = raw[offsets[d]: offsets[d + 1]].split() if removed < j - i else []
            if removed and kept:
                kept = compress(kept, (~gone).tolist())
            n_words.append(j - i)
            n_removed.append(removed)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                     "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space)."""
    importable_on_workers(docs.sparkSession)
    _, size = total_bytes(docs, text_col)
    blocks = max(1, -(-size // BLOCK_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    segments = texts.select("block", "text").mapInArrow(
        _segment_batches, "anchor long, seg long, block int, n int, again boolean")
    counts = segments.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.max("again").alias("again"))
    recurring = counts.where("n > 1 or again").select("anchor", (F.col("again") | (F.col("lo") != F.col("hi"))).alias("mixed"))
    hits = cut(segments.select("anchor", "block").join(recurring, "anchor").distinct())
    by_block = texts.groupBy("block")
    windows = by_block.cogroup(hits.where("mixed").select("block", "anchor").groupBy("block")).applyInArrow(
        _mixed_windows, "anchor long, win long, block int, n long")
    # One shuffle by window; its rows are one a block, so a passage of many documents brings few.
    dealt = windows.repartition("win").groupBy("win", "anchor", F.floor(F.col("block") / BLOCKS_IN_ROW).alias("part")).agg(
        F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    total = F.sum("n").over(Window.partitionBy("win", "anchor"))
    confirmed = dealt.withColumn("total", total).where("total > 1").select("anchor", "win", F.explode("blocks").alias("block"))
    phrases = hits.where("not mixed").select("block", "anchor", F.lit(None).cast("long").alias("win")).unionByName(
        confirmed.select("block", "anchor", "win"))
    out = by_block.cogroup(phrases.groupBy("block")).applyInArrow(_remove, RESULT)
    return out.withColumnRenamed("doc_id", id_col)
