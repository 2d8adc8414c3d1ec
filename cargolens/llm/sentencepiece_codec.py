"""SentencePiece encoding and decoding by a batched numpy Viterbi (operator 6).

A block of texts is one byte buffer; its different words are found by array operations, so nothing is done
for each occurrence but to copy ids.  The words that are not known yet are sorted by length, and all words of one length
advance together: the hashes of all substrings of one size probe the sorted piece keys, at each end position
every piece that was found continues the best path to its start, and a vectorised maximum keeps value
and backpointer.

The path's value is the sum of the pieces' scores.  A BPE model is
not meant to be searched for the best sum: it merges the best pair first.  Its result is the one
path in which no two neighbours could have been merged differently, and that holds pair by pair;
so here a step to a piece has value -inf if the pair of the last piece and this one would have merged
across their border (``_Bpe.stand``), and the maximum is over what is left.  The ids are then the library's.
Models of another type, or that add no space in front, drop spaces or change characters, are refused.

Runs of spaces are cut off beforehand (their pieces all score lowest and merge from the left), characters without a
piece become the pieces of their UTF-8 bytes.

Decoding takes the bytes of all ids of a batch from one table.

Defined cases: null text is the empty text and has no ids; decoding gives the text back, with spaces for U+2581 (as
the library); ids outside the vocabulary raise an error; words and texts may have any length; repeated rows are encoded
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import pretokens, words
from cargolens.llm.common import importable_on_workers, kept, tidy
from cargolens.llm.packing import spans
from cargolens.llm.words import BASE, INVERSE, U, mix

SPACE = "▁"
#: Longer words are searched one by one: there are too few of a length to advance together.
TOGETHER = 40
#: Words of several occurrences that a worker remembers, twice.
CACHE = 100_000
FILTER_BITS = 20
PAIR_BITS = 20
_UP = np.cumprod(np.concatenate([[U(1)], np.full(TOGETHER + 1, U(BASE))]), dtype=U)
_DOWN = np.cumprod(np.concatenate([[U(1)], np.full(TOGETHER + 1, U(INVERSE))]), dtype=U)


def _code(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U) + U(1))


def _slot(sums: np.ndarray) -> np.ndarray:
    return (sums * U(0xA3B195354A39B70D)) >> U(64 - FILTER_BITS)


class _Bpe:
    """Which neighbours stand in a BPE encoding; ranks order the merges, 0 first."""

    def __init__(self, pieces: dict[str, int], rank: np.ndarray):
        n = len(rank)
        self.rank = rank
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)
        merges = []
        for text, i in pieces.items():
            if len(text) == 1:
                self.whole[i] = True
                continue
            for k in range(1, len(text)):
                a, b = pieces.get(text[:k]), pieces.get(text[k:])
                if a is not None and b is not None:
                    merges.append((a * n + b, i))
            halves = self._merge(text, pieces)
            if halves:
                self.whole[i], (self.left[i], self.right[i]) = True, halves
        merges.sort()
        self.n = n
        self.pair = np.array([m for m, _ in merges], np.int64)
        self.into = np.array([i for _, i in merges], np.int64)
        self.asked = np.full(1 << PAIR_BITS, -1, np.int64)
        self.answer = np.zeros(1 << PAIR_BITS, bool)

    def _merge(self, text: str, pieces: dict[str, int]) -> tuple[int, int] | None:
        """The two parts of the last merge if best-first merging makes ``text`` one piece."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best[0]):
                    best = (self.rank[i], k)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return pieces[parts[0]], pieces[parts[1]]
            parts[k: k + 2] = [parts[k] + parts[k + 1]]
        return None

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stand`` with the latest answer for each slot of a table kept."""
        pair = a * self.n + b
        slot = (mix(pair.astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.asked[slot] != pair)
        out = self.answer[slot]
        if len(new):
            out[new] = self._stand(a[new], b[new])
            self.asked[slot[new]], self.answer[slot[new]] = pair[new], out[new]
        return out

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b next to each other are not merged across their border.

        Their merges are undone from the last backwards; whenever the two parts that then meet have
        a merge that comes before the one just undone, it would have happened first.  Of equal
        ranks the left one comes first.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        strict = np.ones(len(a), bool)
        while len(live):
            k = np.minimum(np.searchsorted(self.pair, x * self.n + y), max(len(self.pair) - 1, 0))
            r = np.where(self.pair[k] == x * self.n + y, self.rank[self.into[k]], np.iinfo(np.int64).max) if len(self.pair) else limit
            crossed = np.where(strict, r < limit, r <= limit)
            ok[live[crossed]] = False
            # The later of the two pieces was merged last: it is taken apart next.
            rx = np.where(self.left[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            go = ~crossed & (np.maximum(rx, ry) >= 0)
            take_x = rx > ry
            limit = np.where(take_x, rx, ry)
            # A merge across of the same rank lies left of y's own merge and right of x's.
            strict = take_x
            x = np.where(take_x, self.right[x], x)
            y = np.where(take_x, y, self.left[y])
            live, x, y, limit, strict = live[go], x[go], y[go], limit[go], strict[go]
        return ok


class Codec:
    """Encodes and decodes with the pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.runs = {len(self.names[i]): i for i in normal if not self.names[i].strip(SPACE)}
        self.pieces = {self.names[i]: i for i in normal if self.names[i].strip(SPACE) or len(self.names[i]) == 1}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n, np.int64)
        rank[np.argsort(-self.score, kind="stable")] = np.arange(n)
        self.bpe = _Bpe(self.pieces, rank)
        self.longest = max(map(len, self.pieces), default=1)
        texts = [t for t, i in self.pieces.items() if self.bpe.whole[i]]
        sums = np.array([self._key(t) for t in texts], U)
        keys = mix(sums)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.pieces[t] for t in texts], np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        # Few substrings are pieces: a table of some bits of their sums sorts most others out before the search.
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[_slot(sums)] = True
        self.raw = pa.array([bytes([int(self.names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
                             else " ⁇ ".encode() if sp.is_unknown(i) else self.names[i].replace(SPACE, " ").encode() for i in range(n)], pa.large_binary())
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self._check(sp)

    def _check(self, sp) -> None:
        """Refuse models that this search doesn't hold for."""
        kept = "".join(sp.encode("  x  ﬁ", out_type=str)) == f"{SPACE * 3}x{SPACE * 2}ﬁ" or not self.bytes
        alone = not any(SPACE in t.lstrip(SPACE) for t in self.pieces)
        # A unigram model's scores are log probabilities; those of BPE pieces are their ranks, whole numbers.
        ranks = all(float(self.score[i]).is_integer() for i in self.pieces.values())
        if not (kept and alone and ranks and 1 in self.runs):
            raise ValueError("only BPE models that keep spaces and characters and add a space in front are supported")

    @staticmethod
    def _key(text: str) -> int:
        c = _code(np.array([ord(x) for x in text]))
        return int((c * _UP[: len(c)]).sum(dtype=U) + U(len(c)))

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _found(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces within words of one length: (end, word, start, number among the pieces), by end."""
        count, length = points.shape
        sums = np.zeros((count, length + 1), U)
        np.cumsum(_code(points) * _UP[:length], axis=1, dtype=U, out=sums[:, 1:])
        out = []
        for k in range(1, min(self.longest, length) + 1):
            key = (sums[:, k:] - sums[:, :-k]) * _DOWN[: length - k + 1] + U(k)
            w, start = np.nonzero(self.maybe[_slot(key)])
            key = mix(key[w, start])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            out.append((start[same] + k, w[same], start[same], self.ids[at[same]]))
        end, w, start, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(end.astype(np.uint8), kind="stable")
        return end[order], w[order], start[order], piece[order]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, all at once: their ids one after another, and how many each has."""
        length, count = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, length)
        ends, of, starts, pieces = self._found(points)
        edge = np.searchsorted(ends, np.arange(length + 2))
        value = np.full((length + 1, count), -np.inf)
        value[0] = 0
        last = np.full((length + 1, count), -1, np.int64)  # the piece that ends here; -2: a character without piece
        size = np.zeros((length + 1, count), np.int64)
        for end in range(1, length + 1):
            w, start, piece = (x[edge[end]: edge[end + 1]] for x in (of, starts, pieces))
            single = np.zeros(count, bool)
            single[w[start == end - 1]] = True
            reached = value[start, w] > -np.inf
            w, start, piece = w[reached], start[reached], piece[reached]
            before = last[start, w]
            joint = np.flatnonzero(before >= 0)
            stands = np.ones(len(w), bool)
            stands[joint] = self.bpe.stand(before[joint], piece[joint])
            w, start, piece = w[stands], start[stands], piece[stands]
            new = value[start, w] + self.score[piece]
            np.maximum.at(value[end], w, new)
            best = new == value[end, w]
            w, start, piece = w[best], start[best], piece[best]
            last[end, w], size[end, w] = piece, end - start
            w = np.flatnonzero(~single & (value[end - 1] > -np.inf) & (last[end] == -1))
            value[end, w], last[end, w], size[end, w] = value[end - 1, w] - 1e6, -2, 1
        # All words walk back together; column t holds the piece t steps from the end.
        steps, where, end, w = [], [], np.full(count, length), np.arange(count)
        while (end > 0).any():
            steps.append(np.where(end > 0, last[end, w], -1))
            where.append(end)
            end = end - np.where(end > 0, size[end, w], 0)
        back, where = np.stack(steps[::-1], 1), np.stack(where[::-1], 1)
        row, column = np.nonzero(back != -1)
        ids, n = back[row, column], np.ones(len(row), np.int64)
        bare = np.flatnonzero(ids == -2)
        if len(bare):  # characters without a piece become several ids
            parts = [self._fallback(words[r][e - 1]) for r, e in zip(row[bare].tolist(), where[row[bare], column[bare]].tolist(), strict=True)]
            n[bare] = [len(x) for x in parts]
            at = np.cumsum(n) - n
            out = np.repeat(ids, n)
            out[spans(at[bare], n[bare])] = [i for x in parts for i in x]
            ids = out
        return ids, np.bincount(row, n, count).astype(np.int64)

    def _alone(self, word: str) -> list[int]:
        """One long word: the same recurrence, position by position."""
        reach, last, size = [True], [-1], [0]
        stands: dict[tuple[int, int], bool] = {}
        for end in range(1, len(word) + 1):
            hit = None
            for k in range(1, min(self.longest, end) + 1):
                if not reach[end - k]:
                    continue
                piece = self.pieces.get(word[end - k: end])
                if piece is None or not self.bpe.whole[piece]:
                    if k == 1 and word[end - 1] not in self.pieces:
                        hit = (-2, 1)
                    continue
                before = last[end - k]
                if before >= 0:
                    if (before, piece) not in stands:
                        stands[before, piece] = bool(self.bpe.stand(np.array([before]), np.array([piece]))[0])
                    if not stands[before, piece]:
                        continue
                hit = (piece, k)
            reach.append(hit is not None)
            last.append(hit[0] if hit else -1)
            size.append(hit[1] if hit else 0)
        ids, end = [], len(word)
        while end:
            ids.append([last[end]] if last[end] >= 0 else self._fallback(word[end - 1]))
            end -= size[end]
        return [i for part in reversed(ids) for i in part]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words that start with at most one space mark, as bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        edge = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if length[order[a]] == 0:
                continue
            if length[order[a]] > TOGETHER:
                for i in order[a:b].tolist():
                    out[i] = np.array(self._alone(words[i]), np.int32).tobytes()
                continue
            for k in range(a, b, 20_000):
                some = order[k: min(k + 20_000, b)].tolist()
                ids, n = self._together([words[i] for i in some])
                raw, end = ids.astype(np.int32).tobytes(), (4 * np.cumsum(n)).tolist()
                for i, x, y in zip(some, [0, *end], end, strict=False):
                    out[i] = raw[x:y]
        return out

    def _spaces(self, n: int) -> list[int]:
        most = max(self.runs)
        out = [self.runs[most]] * (n // most)
        while n % most and (rest := n % most):
            k = max(x for x in self.runs if x <= rest)
            out.append(self.runs[k])
            n -= k
        return out

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of words with the spaces before them, as bytes of 32-bit numbers."""
        heads = [1 if u[1:2] != SPACE and len(u) > 1 else len(u) - len(u.lstrip(SPACE)) for u in units]
        done = self._encode_words([u[h - 1:] if len(u) > h else "" for u, h in zip(units, heads, strict=True)])
        one = np.int32(self.runs[1]).tobytes()
        for i, (u, h) in enumerate(zip(units, heads, strict=True)):
            if len(u) == h or h > 1:
                before = h if len(u) == h or done[i][:4] == one else h - 1
                # What is left of the run: its last space too if that joined no piece.
                done[i] = np.array(self._spaces(before), np.int32).tobytes() + (done[i][4:] if before == h else done[i])
        return done

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with a space in front and with spaces for U+2581, and where each text's ids start."""
        space = data == 0x20
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(data)) if len(start) else start
        one, code = pretokens.distinct(data, start, end)
        flat, at = pretokens.pick_bytes(data, start[one], end[one])
        raw = flat.tobytes()
        units = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        ids = [cache.get(u) or older.get(u) for u in units]
        new = [i for i, x in enumerate(ids) if x is None]
        found = self._encode_units([units[i].decode("utf-8", "replace").replace(" ", SPACE) for i in new])
        for i, x in zip(new, found, strict=True):
            ids[i] = x
        for i in np.flatnonzero(np.bincount(code, minlength=len(one)) > 1).tolist():
            if units[i] not in cache:
                cache[units[i]] = ids[i]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        every = np.frombuffer(b"".join(ids), np.int32)
        tokens = every[spans((np.cumsum(size) - size)[code], size[code])]
        return tokens, np.concatenate([[0], np.cumsum(size[code])])[np.searchsorted(start, offsets)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, edge = self.encode_block(*words.buffer(spaced(pa.array(texts, pa.string()))))
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def decode_block(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, still with the space in front, and where each starts."""
        found = self.raw.take(pa.array(ids))
        if not len(found):
            return np.zeros(0, np.uint8), np.zeros(len(edges), np.int64)
        _, at, data = found.buffers()
        return np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64)[found.offset: found.offset + len(found) + 1][edges]

    def decode(self, ids) -> str:
        data, _ = self.decode_block(np.asarray(ids, np.int32), np.array([0, len(ids)]))
        text = data.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def spaced(texts: pa.Array) -> pa.Array:
    """Texts as they are encoded: a space in front (not of empty ones), spaces for U+2581."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
    return pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")), texts)


def codec(path: str) -> Codec:
    return kept((__name__, path), lambda: Codec(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Texts that are encoded together, by bytes.
TOGETHER_BYTES = 2 << 20


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, round_trip (whether decoding gives the text back) for every row."""
    importable_on_workers(docs.sparkSession)
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.string())
            for a, b, data, offsets in words.groups(texts, TOGETHER_BYTES):
                put, put_offsets = words.buffer(spaced(texts.slice(a, b - a)))
                ids, edge = c.encode_block(put, put_offsets)
                back, back_offsets = c.decode_block(ids, edge)
                same = _same(data, offsets, back, back_offsets)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(np.diff(edge)), pa.array(same)],
                                                 names=["id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: tidy(run(b)), f"id {kind}, ids array<int>, n_tokens long, round_trip boolean").select(
        F.col("id").alias(id_col), "ids", "n_tokens", "round_trip")


def _same(data: np.ndarray, offsets: np.ndarray, back: np.ndarray, back_offsets: np.ndarray) -> np.ndarray:
    """Whether each text is what was decoded, without the space in front."""
    size = np.diff(offsets)
    same = np.diff(back_offsets) == size + (size > 0)
    at = np.flatnonzero(same & (size > 0))
    differs = data[spans(offsets[at], size[at])] != back[spans(back_offsets[at] + 1, size[at])]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    end = np.cumsum(size[at])
    same[at] = wrong[end] == wrong[end - size[at]]
    return same


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text for every row; null ids are the empty text."""
    importable_on_workers(encoded.sparkSession)
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(i.values.to_numpy() if i.is_valid else []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: tidy(run(b)), f"id {kind}, text string").select(F.col("id").alias(id_col), "text")
