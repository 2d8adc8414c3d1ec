"""Alignment of two tokenizers by external spill counting (operator 11).

*Align.*  Each task encodes blocks of texts with both tokenizers (each distinct pre-token of a block once, each distinct
word between spaces once), finds from the byte offsets which tokens overlap (links) and where both sides end
(groups), all by array operations, and keeps each document's distinct id pairs with their numbers of links.

*Spill and count.*  A block's distinct pairs, with the number of its documents that hold each, are sorted by A id, then B id
(side-major), radix-partitioned by a hash of the A id and written as zstd frames: the runs.  Frames of one
partition arrive in order of their first pair, and a heap of the open ones, by last pair, merges them k ways: only frames that
overlap are open at a time.  At most about ``FAN`` runs are merged into one; more runs are merged level by
level, so neither a frequent id nor the number of blocks makes a task larger: a merged run holds each pair once.

*Stream back.*  The last merge sees an A id's pairs one after another, so its highest count is known when the next A id comes.
Counts and marks of the highest go back down the levels, a partition's result beside the runs it was merged from, until each
block has them for its own pairs and adds them up by document.

Defined cases: null and empty texts, and texts that one side does not give back (U+2581, which B reads as a space), have
no tokens: zeros and an empty digest; strings of special tokens are ordinary text; texts may have any length
(one text is one block at least); repeated rows are documents of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import pretokens, words
from cargolens.llm.byte_bpe import arrow_type, text_blocks
from cargolens.llm.common import cut, importable_on_workers, kept, tidy, trim
from cargolens.llm.packing import pack, pack_bytes, pack_sorted, spans, unpack, unpack_bytes, unpack_sorted

#: Bytes of text in a block.
BLOCK = 2 << 20
#: Runs that are merged at a time, pairs that a partition is meant to hold, and pairs of a frame.
FAN, PARTITION_PAIRS, FRAME = 256, 500_000, 1 << 14

_FRAMES = "radix long, run long, first long, pairs binary, counts binary"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level entries: printable bytes are themselves, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    for k, b in enumerate(sorted(set(range(256)) - set(own))):
        out[chr(0x100 + k)] = b
    return out


class Sides:
    """Both tokenizers with the bytes of their tokens; kept by the worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.ranks = Tokenizer.from_file(a_path), None
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_size = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * self.a_size
        for text, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in text)
        self.b_size = self.b.get_piece_size()
        self.space = self.b.encode("x ")[len(self.b.encode("x")):]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b_size)]
        if merges_by_id(a_path):  # then the ids are ranks, and a lighter encoder gives the same ids
            import tiktoken

            self.a, self.ranks = None, tiktoken.Encoding("ranks", pat_str=pretokens.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t}, special_tokens={})
        self.length = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.a_bytes, self.b_bytes = (pa.array(t, pa.large_binary()) for t in (self.a_bytes, self.b_bytes))
        # What an id adds to a document's groups, by the mark after it: A's ids with "," and "|", then B's with ",", ";" and none.
        self.written = pa.array([f"{i}{m}".encode() for m, n in ((",", self.a_size), ("|", self.a_size), (",", self.b_size), (";", self.b_size), ("", self.b_size))
                                 for i in range(n)], pa.large_binary())

    def encode_a(self, found: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in found]
        if self.ranks is not None:
            return [*map(self.ranks.encode_ordinary, texts)]
        # The library's results are heavy objects: some words at a time.
        return [e.ids for k in range(0, len(texts), 1000) for e in self.a.encode_batch(texts[k: k + 1000], add_special_tokens=False)]

    def encode_b(self, found: list[bytes]) -> list[list[int]]:
        # The library adds the first space itself, but not to nothing.
        ids = self.b.encode([w[1:].decode("utf-8", "replace") for w in found], num_threads=1)
        return [self.space if w == b" " else i for w, i in zip(found, ids, strict=True)]


def merges_by_id(path: str) -> bool:
    """Whether each merge makes the id that follows the one before, after one id for each byte."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"])
    return set(map(model["vocab"].get, byte_alphabet())) == set(range(256)) and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged))


def supported(a_path: str, b_path: str) -> bool:
    """Whether A is a byte-level BPE of ``pretokens.PATTERN`` and B takes the words between spaces one by one."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    a = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    # No piece goes on after a space but for runs of spaces, spaces are kept and one is added in front.
    return bool(a) and not any("▁" in n.lstrip("▁") for n in names) and "".join(b.encode("  x  ", out_type=str)) == "▁▁▁x▁▁"


def sides(a_path: str, b_path: str) -> Sides:
    return kept((__name__, a_path, b_path), lambda: Sides(a_path, b_path))


class _Side:
    """One side's tokens of a block: ids, where each ends, and which texts it does not give back."""

    def __init__(self, data: np.ndarray, start: np.ndarray, offsets: np.ndarray, encode, token_bytes: pa.Array, length: np.ndarray):
        end = np.append(start[1:], len(data)) if len(start) else start
        one, code = pretokens.distinct(data, start, end)
        flat, at = pretokens.pick_bytes(data, start[one], end[one])
        raw = flat.tobytes()
        ids = encode([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]) if len(one) else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        every = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        del ids
        wrong = _differs(flat, at, every, np.cumsum(size), token_bytes, length)
        self.bad = np.unique(np.searchsorted(offsets, start[wrong[code]], side="right") - 1) if wrong.any() else np.zeros(0, np.int64)
        self.ids = every[spans((np.cumsum(size) - size)[code], size[code])]
        self.end = np.cumsum(length[self.ids])
        self.start = self.end - length[self.ids]


def _differs(flat: np.ndarray, at: np.ndarray, ids: np.ndarray, ends: np.ndarray, token_bytes: pa.Array, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of a word's tokens are other than the word's own, for each word."""
    given = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], ends])]
    wrong = np.diff(given) != np.diff(at)
    if not len(ids):
        return wrong
    _, _, data = token_bytes.take(pa.array(ids)).buffers()
    back = np.frombuffer(data, np.uint8)
    k = np.flatnonzero(~wrong)
    size = np.diff(at)[k]
    unequal = np.concatenate([[0], np.cumsum(flat[spans(at[k], size)] != back[spans(given[k], size)])])
    end = np.cumsum(size)
    wrong[k] = unequal[end] != unequal[end - size]
    return wrong


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words with the spaces before them start; each text starts with a space."""
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    heads = offsets[:-1]
    start[heads[heads < len(data)]] = True
    return np.flatnonzero(start)


def _both_sides(s: Sides, texts: pa.Array) -> tuple[_Side, _Side, np.ndarray]:
    """Both sides of " " + text for the texts that have tokens, and the offsets of all texts."""
    texts = pc.fill_null(texts, "")
    while True:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        spaced = pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), texts)
        data, offsets = words.buffer(spaced)
        a = _Side(data, pretokens.split(data, offsets)[0], offsets, s.encode_a, s.a_bytes, s.length[0])
        b = _Side(data, _units(data, offsets), offsets, s.encode_b, s.b_bytes, s.length[1])
        bad = np.union1d(a.bad, b.bad)
        if not len(bad):
            return a, b, offsets
        empty = np.zeros(len(texts), bool)
        empty[bad] = True
        texts = pc.if_else(pa.array(empty), pa.scalar("", texts.type), texts)


def _written(s: Sides, a: _Side, b: _Side, joint_a: np.ndarray, joint_b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts as bytes ``a1,a2|b1;a3|b2,b3``, and where each text's start."""
    group_a, group_b = np.cumsum(joint_a) - joint_a, np.cumsum(joint_b) - joint_b
    until_a = np.append(np.flatnonzero(joint_a) + 1, 0)  # A tokens up to and with each group
    until_b = np.concatenate([[0], np.flatnonzero(joint_b) + 1])
    place_a = np.arange(len(a.ids)) + until_b[group_a]
    place_b = np.arange(len(b.ids)) + until_a[group_b]
    last = np.zeros(len(b.ids), bool)
    ends = np.searchsorted(b.end, offsets, side="right")  # tokens of all texts before
    last[ends[1:][np.diff(ends) > 0] - 1] = True
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    code[place_a] = a.ids + np.where(joint_a, s.a_size, 0)
    code[place_b] = 2 * s.a_size + b.ids + np.where(last, 2 * s.b_size, np.where(joint_b, s.b_size, 0))
    out = s.written.take(pa.array(code))
    if not len(out):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    _, at, data = out.buffers()
    edge = np.frombuffer(at, np.int64)[out.offset: out.offset + len(out) + 1]
    return np.frombuffer(data, np.uint8), edge[ends + np.searchsorted(a.end, offsets, side="right")]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums between successive edges."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])


def _align(batches: Iterator[pa.RecordBatch], kind: pa.DataType, paths: tuple[str, str], limit: int, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents' figures, their pairs, the block's distinct pairs."""
    part, seq, s = TaskContext.get().partitionId(), 0, sides(*paths)
    every = s.a_size * s.b_size
    for ids, texts in text_blocks(batches, limit):
        a, b, offsets = _both_sides(s, texts)
        edge_a, edge_b = (np.searchsorted(x.end, offsets, side="right") for x in (a, b))
        at = np.searchsorted(b.end, a.end)
        joint_a = b.end[at] == a.end if len(a.end) else np.zeros(0, bool)
        joint_b = np.zeros(len(b.end), bool)
        joint_b[at[joint_a]] = True
        low, high = np.searchsorted(b.end, a.start, side="right"), np.searchsorted(b.start, a.end, side="left")
        count = high - low
        pair = np.repeat(a.ids, count) * s.b_size + b.ids[spans(low, count)]
        document = np.repeat(np.repeat(np.arange(len(ids)), np.diff(edge_a)), count)
        record, times = np.unique(document * every + pair, return_counts=True)
        pairs, code, held = np.unique(record % every, return_inverse=True, return_counts=True)
        data, edge = _written(s, a, b, joint_a, joint_b, offsets)
        text = data.tobytes()
        groups = [text[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        figures = np.stack([np.diff(edge_a), np.diff(edge_b), _sums(joint_a, edge_a), _sums(count, edge_a),
                            np.bincount(record // every, minlength=len(ids))])
        digest = "".join(hashlib.sha256(g).hexdigest() if g else " " * 64 for g in groups)
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) | seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind)),
            pa.array([pack(figures.ravel())]), pa.array([pack_bytes(digest.encode())]), pa.array([pack_bytes(text) if with_groups else None], pa.binary()),
            pa.array([pack(np.diff(edge)) if with_groups else None], pa.binary()),
            pa.array([pack(np.diff(code.reshape(-1), prepend=0) % (1 << 32))]), pa.array([pack(times)]),
            pa.array([len(pairs)], pa.int64()), pa.array([pack_sorted(pairs, 8)]), pa.array([pack(held)]),
        ], names=["block", "ids", "figures", "digest", "groups", "group_sizes", "codes", "times", "n_pairs", "pairs", "held"])
        seq += 1
        trim()


def _frame(radix: int, run: int, pairs: np.ndarray, counts: np.ndarray) -> tuple:
    return radix, run, int(pairs[0]), pack_sorted(pairs, 8), pack(counts, 8)


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of whole numbers and bytes."""
    columns = [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names.split())


def _spill(batches: Iterator[pa.RecordBatch], radixes: int, b_size: int) -> Iterator[pa.RecordBatch]:
    """The runs of each block: a frame, or more, for each radix."""
    for batch in batches:
        for block, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, held = unpack_sorted(pairs, 8), unpack(held)
            if not len(pairs):
                continue
            radix = (words.mix((pairs // b_size).astype(words.U)) % words.U(radixes)).astype(np.int64)
            order = np.argsort(radix, kind="stable")
            edge = np.flatnonzero(np.diff(radix[order], prepend=-1, append=-1))
            rows = []
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for k in range(x, y, FRAME):
                    w = order[k: min(k + FRAME, y)]
                    rows.append(_frame(int(radix[w[0]]), block, pairs[w], held[w]))
            yield _rows(rows, "radix run first pairs counts")


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs as one, with the sum of their counts."""
    pair, count = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(count, first)


class _Merge:
    """A k-way merge of frames that come in order of their first pair, by a heap of the open ones."""

    def __init__(self):
        self.heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.seen = 0

    def push(self, first: int, pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Open a frame; yields what is complete before it."""
        while self.heap and self.heap[0][0] < first:
            yield self._pop()
        self.seen += 1
        heapq.heappush(self.heap, (int(pairs[-1]), self.seen, pairs, counts))

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.heap:
            yield self._pop()

    def _pop(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs up to the last one of the frame that ends first."""
        bound, taken, kept = self.heap[0][0], [], []
        for last, seen, pairs, counts in self.heap:
            k = int(np.searchsorted(pairs, bound, side="right"))
            if k:
                taken.append((pairs[:k], counts[:k]))
            if k < len(pairs):
                kept.append((last, seen, pairs[k:], counts[k:]))
        heapq.heapify(kept)
        self.heap = kept
        return _added([p for p, _ in taken], [c for _, c in taken])


def _partitions(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Sorted rows, partition by partition, as (the first ``keys`` columns, its rows)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    merge = _Merge()
    for _, _, first, pairs, counts in rows:
        yield from merge.push(first, unpack_sorted(pairs, 8), unpack(counts, 8))
    yield from merge.finish()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition and group, sorted by first pair, to one run."""
    for (radix, group), rows in _partitions(batches, 2):
        held, size = [], 0
        for chunk in _chunks(rows):
            held.append(chunk)
            size += len(chunk[0])
            if size >= FRAME:
                yield _rows([_frame(radix, group, *map(np.concatenate, zip(*held, strict=True)))], "radix run first pairs counts")
                held, size = [], 0
        if held:
            yield _rows([_frame(radix, group, *map(np.concatenate, zip(*held, strict=True)))], "radix run first pairs counts")


_RESULT = "radix long, run long, first long, pairs binary, counts binary, best binary"


def _count(batches: Iterator[pa.RecordBatch], b_size: int) -> Iterator[pa.RecordBatch]:
    """The last merge: counts, and which pairs have their A id's highest."""
    def result(radix: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(pairs // b_size, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(pairs))))
        return _rows([(*_frame(radix, 0, pairs, counts), pack((counts == highest).astype(np.int64), 1))], "radix run first pairs counts best")

    for (radix, _), rows in _partitions(batches, 2):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for chunk in _chunks(rows):
            pairs, counts = np.append(pairs, chunk[0]), np.append(counts, chunk[1])
            if len(pairs) < FRAME:
                continue
            k = int(np.searchsorted(pairs, pairs[-1] // b_size * b_size))  # the last A id may go on
            if k:
                yield result(radix, pairs[:k], counts[:k])
                pairs, counts = pairs[k:], counts[k:]
        if len(pairs):
            yield result(radix, pairs, counts)


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a partition and group before the frames they were merged from: a result for each frame."""
    out: list[tuple] = []
    for (radix, _), rows in _partitions(batches, 2):
        held, known = [], None
        for _, _, _, run, first, pairs, counts, best in rows:
            if best is not None:
                held.append((unpack_sorted(pairs, 8), unpack(counts, 8), unpack(best, 1)))
                continue
            if known is None:
                known = tuple(map(np.concatenate, zip(*held, strict=True)))
                order = np.argsort(known[0], kind="stable")
                known, held = tuple(x[order] for x in known), []
            at = np.searchsorted(known[0], unpack_sorted(pairs, 8))
            out.append((radix, run, first, pairs, pack(known[1][at], 8), pack(known[2][at], 1)))
            if len(out) >= 64:
                yield _rows(out, "radix run first pairs counts best")
                out = []
    if out:
        yield _rows(out, "radix run first pairs counts best")


def _add_up(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, results before the block itself, to a row for each document."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(len(batch)):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            if row["best"].is_valid:
                held.append((unpack_sorted(row["pairs"].as_py(), 8), unpack(row["counts"].as_py(), 8), unpack(row["best"].as_py(), 1)))
                continue
            pairs = unpack_sorted(row["pairs"].as_py(), 8)
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            for p, c, b in held:
                at = np.searchsorted(pairs, p)
                count[at], best[at] = c, b
            held = []
            ids = row["ids"].values
            figures = unpack(row["figures"].as_py()).reshape(5, len(ids))
            code, times = np.cumsum(unpack(row["codes"].as_py())) % (1 << 32), unpack(row["times"].as_py())
            edges = np.concatenate([[0], np.cumsum(figures[4])])
            digest = unpack_bytes(row["digest"].as_py()).decode()
            digests = [digest[k: k + 64].strip() for k in range(0, len(digest), 64)]
            groups = pa.nulls(len(ids), pa.string())
            if row["groups"].is_valid:
                raw, ends = unpack_bytes(row["groups"].as_py()).decode(), np.concatenate([[0], np.cumsum(unpack(row["group_sizes"].as_py()))]).tolist()
                groups = pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([ids.cast(kind), *(pa.array(f) for f in figures[:4]), pa.array(_sums(times * best[code], edges)),
                                              pa.array(_sums(times * count[code], edges)), pa.array(digests, pa.string()), groups],
                                             names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
                    block_bytes: int = BLOCK, partition_pairs: int = PARTITION_PAIRS, fan: int = FAN) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row; with ``with_groups`` also ``groups``,
    each document's groups as ``a1,a2|b1;a3|b2,b3``.

    The files are in the same place on every machine.
    """
    if not supported(a_path, b_path):
        raise ValueError("A must be byte-level BPE without normaliser, B must keep spaces and have no piece over a space between words")
    importable_on_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, arrow, paths, b_size = rows.schema["id"].dataType.simpleString(), arrow_type(rows), (a_path, b_path), sides(a_path, b_path).b_size
    blocks = cut(rows.mapInArrow(
        lambda x: tidy(_align(x, arrow, paths, block_bytes, with_groups)),
        f"block long, ids array<{kind}>, figures binary, digest binary, groups binary, group_sizes binary, codes binary, times binary, "
        "n_pairs long, pairs binary, held binary"))
    seen = blocks.agg(F.sum("n_pairs").alias("pairs"), F.count(F.lit(1)).alias("blocks")).first()
    radixes = max(1, -(-(seen["pairs"] or 0) // partition_pairs))
    # Levels of runs: the blocks' own, then merged ones; ``group`` is the run they are merged into.
    runs = blocks.select("block", "pairs", "held").mapInArrow(lambda x: _spill(x, radixes, b_size), _FRAMES)
    levels, n = [], -(-seen["blocks"] // fan)
    runs = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(max(n, 1))))
    while n > 1:
        levels.append(runs)
        runs = cut(_sorted(runs).mapInArrow(_merge_runs, _FRAMES))
        n = -(-n // fan)
        runs = runs.withColumn("group", F.floor(F.col("run") / fan) if n > 1 else F.lit(0).cast("long"))
    levels.append(runs)
    result = _sorted(runs).mapInArrow(lambda x: _count(x, b_size), _RESULT)
    while levels:
        runs = levels.pop()
        below = runs.select("radix", "group", F.lit(1).alias("kind"), "run", "first", "pairs", "counts")
        above = result.select("radix", F.col("run").alias("group"), F.lit(0).alias("kind"), "run", "first", "pairs", "counts", "best")
        both = above.unionByName(below, allowMissingColumns=True).select("radix", "group", "kind", "run", "first", "pairs", "counts", "best")
        result = both.repartition("radix", "group").sortWithinPartitions("radix", "group", "kind").mapInArrow(_hand_down, _RESULT)
    found = result.select(F.col("run").alias("block"), F.lit(0).alias("kind"), "pairs", "counts", "best")
    own = blocks.select("block", F.lit(1).alias("kind"), "ids", "figures", "digest", "groups", "group_sizes", "codes", "times", "pairs")
    out = found.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        lambda x: _add_up(x, arrow), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return out.select(F.col("id").alias(id_col), *names)


def _sorted(runs: DataFrame) -> DataFrame:
    """Frames by partition and group, in order of their first pair."""
    return runs.select("radix", "group", "first", "pairs", "counts").repartition("radix", "group").sortWithinPartitions("radix", "group", "first")
