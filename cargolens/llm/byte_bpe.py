"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 12).

1. *Explode with positions.*  Each task splits blocks of texts into pre-tokens (array operations, see
   ``pretokens``) and keeps, for each position, the number of the word that stands there, the most
   frequent word first.  Blocks are shuffled once, to where they will be put together again; both later steps read that
   shuffle.
2. *Distinct words.*  A word is dealt to a bucket by its hash; a block sends a bucket one row with its words
   of that bucket.  A bucket's task encodes each distinct word once, and joins the ids back: one row
   of ids for each row of words.
3. *Reassemble.*  The rows of ids are grouped with their block, and the texts' ids are read off by position.

A word that stands in every text is one word of each block, so what a hot word shuffles is at most
one entry a block.  A bucket's task keeps at most ``KNOWN`` words and starts anew beyond that.
Blocks are bounded by their bytes; only a longer single text makes a larger block.

Decoding joins ids with the table of token bytes by their number (a table of the vocabulary's size,
broadcast) and puts the bytes together.

Defined cases: null text is the empty text and has no ids; null ids decode to no bytes; ids outside the
vocabulary raise an error; texts may have any length; repeated rows are encoded each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import pretokens, words
from cargolens.llm.common import importable_on_workers, kept, trim
from cargolens.llm.packing import pack, pack_bytes, pack_sorted, spans, unpack, unpack_bytes, unpack_sorted

#: Bytes of text in a block, and of texts that are split together.
BLOCK, SPLIT = 4 << 20, 1 << 20
#: Buckets for each shuffle partition, and words that a bucket's task remembers.
BUCKETS, KNOWN = 1, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoder(path: str):
    """The merges of one file of ranks, without special tokens; kept by the worker."""
    import tiktoken

    return kept((__name__, path), lambda: tiktoken.Encoding("ranks", pat_str=pretokens.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}))


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in blocks of about ``limit`` bytes, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        return (table.column(i).combine_chunks() if table.num_rows else table.column(i) for i in (0, 1))

    for batch in batches:
        o = words.buffer(batch.column(1))[1]
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(o, o[a] + limit - size, side="right")) - 1)
            held.append(batch.slice(a, b - a))
            size += int(o[b] - o[a])
            a = b
            if size >= limit or a < len(batch):
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``pretokens.split`` of all texts, some at a time."""
    starts, firsts, byte, n = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0, 0
    for _, _, data, offsets in words.groups(texts, SPLIT):
        start, first = pretokens.split(data, offsets)
        starts.append(start + byte)
        firsts.append(first[1:] + n)
        byte, n = byte + len(data), n + len(start)
    return np.concatenate(starts), np.concatenate(firsts)


def _explode(batches: Iterator[pa.RecordBatch], kind: pa.DataType, limit: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids, pre-tokens of each text, word of each position, the words."""
    part, seq = TaskContext.get().partitionId(), 0
    for ids, texts in text_blocks(batches, limit):
        data, offsets = words.buffer(texts)
        start, first = _split(texts)
        end = np.append(start[1:], len(data)) if len(start) else start
        one, code = pretokens.distinct(data, start, end)
        order = np.argsort(-np.bincount(code, minlength=len(one)), kind="stable")
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        one = one[order]
        flat, at = pretokens.pick_bytes(data, start[one], end[one])
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) | seq], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind)),
            pa.array([pack(np.diff(first))], pa.binary()), pa.array([pack(place[code])], pa.binary()),
            pa.array([pack(np.diff(at))], pa.binary()),
            pa.array([pack_bytes(flat.tobytes())], pa.binary()),
        ], names=["block", "ids", "n_words", "words_at", "sizes", "words"])
        seq += 1
        trim()


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each block and bucket: which of the block's words, their sizes, their bytes."""
    for batch in batches:
        for i in range(len(batch)):
            block, sizes, flat = (batch.column(k)[i].as_py() for k in (0, 4, 5))
            sizes = unpack(sizes)
            if not len(sizes):
                continue
            data = np.frombuffer(unpack_bytes(flat), np.uint8)
            at = np.concatenate([[0], np.cumsum(sizes)])
            bucket = (pretokens.hashes(data, at[:-1], at[1:]) % words.U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                w = order[a:b]
                rows.append((int(bucket[w[0]]), block, pack_sorted(w), pack(sizes[w]), pack_bytes(data[spans(at[w], sizes[w])].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "block", "which", "sizes", "words"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of words, sorted by bucket, to rows of ids; each distinct word of a bucket is encoded once."""
    encode, now, known = encoder(path).encode_ordinary, None, {}
    for batch in batches:
        out = []
        for bucket, block, which, sizes, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now or len(known) > KNOWN:
                now, known = bucket, {}
            data, at = unpack_bytes(flat), 0
            ids = []
            for size in unpack(sizes).tolist():
                word = data[at: at + size]
                at += size
                found = known.get(word)
                if found is None:
                    found = known[word] = tuple(encode(word.decode("utf-8", "replace")))
                ids.append(found)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((block, which, pack(counts), pack(np.fromiter((x for i in ids for x in i), np.int64, int(counts.sum())))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "which", "counts", "tokens"])


def _reassemble(found: pa.Table, block: pa.Table, kind: pa.DataType) -> pa.Table:
    """The rows of ids of a block and the block itself to a row for each text."""
    which, counts, flat = (np.concatenate([np.zeros(0, np.int64), *(f(x) for x in found.column(n).to_pylist())])
                           for n, f in (("which", unpack_sorted), ("counts", unpack), ("tokens", unpack)))
    size, begin = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    size[which], begin[which] = counts, np.cumsum(counts) - counts
    n_words, at = (unpack(block.column(n)[0].as_py()) for n in ("n_words", "words_at"))
    edges = np.concatenate([[0], np.cumsum(size[at])])[np.concatenate([[0], np.cumsum(n_words)])]
    tokens = pa.array(flat[spans(begin[at], size[at])].astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), tokens)
    return pa.table([block.column("ids").combine_chunks().flatten().cast(kind), pa.array(np.diff(edges)), lists], names=["id", "n_tokens", "ids"])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """id, n_tokens, ids for every row; ``path`` is a file of ranks, in the same place on every machine."""
    spark = docs.sparkSession
    importable_on_workers(spark)
    buckets = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, arrow = rows.schema["id"].dataType.simpleString(), arrow_type(rows)
    # Both uses take all columns: so they are one exchange, and the texts are split once.
    blocks = rows.mapInArrow(lambda b: _explode(b, arrow, block_bytes), f"block long, ids array<{kind}>, n_words binary, "
                             "words_at binary, sizes binary, words binary").repartition("block")
    dealt = blocks.mapInArrow(lambda b: _deal(b, buckets), "bucket long, block long, which binary, sizes binary, words binary")
    encoded = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda b: _encode(b, path), "block long, which binary, counts binary, tokens binary")
    out = encoded.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        lambda found, block: _reassemble(found, block, arrow), f"id {kind}, n_tokens long, ids array<int>")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids")


def arrow_type(rows: DataFrame) -> pa.DataType:
    """The Arrow type of the column ``id``."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def token_bytes(path: str) -> pa.Array:
    """The bytes of each token by its id (null where there is none)."""
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, n_tokens, ids, decoded (the bytes) for every row."""
    importable_on_workers(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept((__name__, "bytes", path), lambda: token_bytes(path))
        for batch in batches:
            ids = pc.fill_null(batch.column(1), []) if batch.column(1).null_count else batch.column(1)
            found = table.take(ids.flatten())
            if found.null_count:
                raise ValueError("an id has no token in the vocabulary")
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            _, at, data = found.buffers()
            edge = np.frombuffer(at, np.int64)[found.offset:][ends] if len(found) else np.zeros(len(ends), np.int64)
            whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edge.tobytes()), data or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, whole.cast(pa.binary())], names=["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, ids array<int>, decoded binary").select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
