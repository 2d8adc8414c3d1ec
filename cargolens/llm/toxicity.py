"""Toxicity scores from a learned lexicon, matched with spelling errors (operator 8).

*Lexicon*: words and word beginnings that labelled toxic texts have and others lack, by a likelihood
ratio against chance; a word that always follows the same word (copies of one text) doesn't count.
*Matching*: the lexicon is a trie; a word is run through the product of that trie and the Levenshtein
automaton of 1 edit (2 for terms of ``LONG`` letters or more), first letter fixed.  The product is
made deterministic as words ask for it and kept, so most words cost a few dictionary look-ups
before they fall out of it.  Words that clean training texts use are never taken for a misspelling.
*Context*: a hit counts more with other hits within ``NEAR`` words and less inside quotation marks.
A ridge logistic regression over these window scores gives the probability.

Labels are learned only from rows of the training fold (``held_out``: crc32 of the id as text, mod 3,
is 1), at most about ``SAMPLE`` of them, chosen by a hash of the id.  What is broadcast are words of those rows
that at least two of them have.

Defined cases: null text is the empty text and scores like a text without hits; without
training rows of both labels every score is the smoothed share of toxic rows (0.5 without any); repeated rows are
scored each; an empty table gives an empty result; lang, source and other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bounded_sample, cut, importable_on_workers, kept

SAMPLE = 12_000
FIT_TASKS = 8
SHORT, LONG = 4, 8
STEMS = (4, 5)
NEAR = 8
THRESHOLD = 0.7
STEPS = 300_000

_words = regex.compile(r"[\p{L}\p{M}\p{N}@$*]+").findall
_marked = regex.compile(r"[\p{L}\p{M}\p{N}@$*]+|[\"“”„«»\n]").findall
_OPEN, _CLOSE = "“„«", "”»"


def words_of(text: str) -> list[str]:
    return [w.strip("@$*") for w in _words(text.lower())]


class LexiconAutomaton:
    """Trie of (term, weight); a term that ends in ``*`` stands for all words that begin so."""

    def __init__(self, terms: list[tuple[str, float]], benign: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.length: list[int] = [0]
        self.edits: list[int] = [0]
        self.benign = benign
        for term, weight in sorted(terms):
            stem, node, path = term.endswith("*"), 0, [0]
            for c in term.removesuffix("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.length.append(self.length[node] + 1)
                    self.edits.append(0)
                node = self.next[node][c]
                path.append(node)
            (self.stem if stem else self.word)[node] = weight
            k = 0 if stem else self.allowed(len(term))
            for x in path:
                self.edits[x] = max(self.edits[x], k)
        self._reset()

    @staticmethod
    def allowed(length: int) -> int:
        return 0 if length < SHORT + 1 else 1 if length < LONG else 2

    def _reset(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.number = {self.states[0]: 0}

    def _step(self, state: int, c: str) -> int:
        """The state after ``c``, or -1 if no term can be reached any more."""
        best: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.edits[node] and e < best.get(node, 9):
                best[node] = e
                if node:
                    for child in self.next[node].values():  # a letter of the term is missing
                        put(child, e + 1)

        for node, e in self.states[state]:
            for letter, child in self.next[node].items():
                if letter == c:
                    put(child, e)
                elif node:
                    put(child, e + 1)
            if node:
                put(node, e + 1)  # a letter too many
        if not best:
            return -1
        key = tuple(sorted(best.items()))
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best term for a word, (0, 0) if there is none."""
        if len(self.steps) > STEPS:
            self._reset()
        state, found, node = 0, 0.0, 0
        for i, c in enumerate(word):
            if node >= 0:
                node = self.next[node].get(c, -1)
                if node >= 0 and self.stem[node] and i + 1 < len(word):
                    found = max(found, self.stem[node])
            if state >= 0:
                n = self.steps.get((state, c))
                if n is None:
                    n = self.steps[state, c] = self._step(state, c)
                state = n
            if state < 0 and node < 0:
                break
        best = (found, 0)
        if node >= 0 and self.word[node] > best[0]:
            best = (self.word[node], 0)
        if state >= 0:
            for node, e in self.states[state]:
                if self.word[node] and e <= self.allowed(self.length[node]):
                    weight = self.word[node] * (1.0 if e == 0 else 0.8)
                    if weight > best[0]:
                        best = (weight, e)
        if best[0] and word in self.benign and best[1] == 0 and not (node >= 0 and self.word[node]):
            return 0.0, 0
        return (0.0, 0) if best[1] and word in self.benign else best


class Scorer:
    """Features of a text: best and summed window scores, density, different terms, quoted share."""

    FEATURES = 5

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton = automaton
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.cache.get(word)
        if w is None:
            if len(self.cache) >= 300_000:
                self.cache.clear()
            w = self.cache[word] = self.automaton.match(word)[0]
        return w

    def features(self, text: str) -> tuple[list[float], int]:
        low = text.lower()
        words = [w.strip("@$*") for w in _words(low)]
        weight = self.weight
        hot = {w for w in set(words) if w and weight(w) > 0}
        if not hot:
            return [0.0] * self.FEATURES, 0
        hits, quoted, at = [], False, 0
        for token in _marked(low):
            if token == '"':
                quoted = not quoted
            elif token in _OPEN:
                quoted = True
            elif token in _CLOSE or token == "\n":
                quoted = False
            else:
                word = token.strip("@$*")
                if word in hot:
                    hits.append((at, weight(word), quoted))
                at += 1
        place = np.array([h[0] for h in hits])
        near = np.searchsorted(place, place + NEAR, side="right") - np.searchsorted(place, place - NEAR) - 1
        inside = np.array([h[2] for h in hits])
        windows = np.array([h[1] for h in hits]) * (1 + 0.5 * np.minimum(near, 4)) * np.where(inside, 0.3, 1.0)
        return [float(windows.max()), math.log1p(float(windows.sum())), 100 * len(hits) / max(at, 1) / 10,
                math.log1p(len(hot)), float(inside.mean())], len(hits)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts of label 0, of label 1, places): places marks what comes before a word, or
    after a beginning, in 16 bits."""
    table: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            seen: dict[str, int] = {}
            for before, w in zip(["", *words], words):
                if len(w) >= 3:
                    if w not in seen:
                        seen[w] = 1 << (zlib.crc32(before.encode()) & 15)
                    for k in STEMS:
                        if len(w) > k:
                            s = w[:k] + "*"
                            seen[s] = seen.get(s, 0) | 1 << (zlib.crc32(w.encode()) & 15)
            for term, bits in seen.items():
                row = table.setdefault(term, [0, 0, 0])
                row[y] += 1
                if y:
                    row[2] |= bits
    terms = list(table)
    for a in range(0, len(terms), 50_000):
        part = terms[a: a + 50_000]
        cols = list(zip(*[table[t] for t in part], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(c, pa.int64()) for c in cols]],
                                         names=["term", "n0", "n1", "places"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression with an intercept, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    penalty = np.full(len(b), ridge * len(z) / 100)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + penalty * b
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


def _crc(col: str, parts: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("y")).where(
        "y in (0, 1) and _id is not null").where(_crc("_id", 3) != 1).distinct()
    marks = bounded_sample(marks, "_id", SAMPLE, 8)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .join(F.broadcast(marks), F.col("id") == F.col("_id"))  # about SAMPLE rows
               .select("text", "y").repartition(FIT_TASKS))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {"share": (n1 + 1) / (n0 + n1 + 2) if n0 + n1 else 0.5}
    terms = cut(rows.mapInArrow(_term_rows, "term string, n0 long, n1 long, places long").groupBy("term").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("places").alias("places")).where("n0 + n1 >= 2"))
    tested = max(2, terms.where("n0 + n1 >= 3").count())
    seen = F.col("n0") + F.col("n1")
    expected = [seen * (n0 / (n0 + n1)), seen * (n1 / (n0 + n1))]
    ratio = 2 * sum((F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / e)).otherwise(0.0) for c, e in zip(("n0", "n1"), expected, strict=True)), F.lit(0.0))
    odds = F.log((F.col("n1") + 0.1) / (n1 + 0.2)) - F.log((F.col("n0") + 0.1) / (n0 + 0.2))
    chosen = (terms.where("n1 >= 3").withColumn("ratio", ratio).withColumn("odds", odds)
              .where((F.col("ratio") >= 2 * math.log(tested)) & (F.col("odds") >= math.log(10)) & (F.bit_count("places") >= 3))
              .orderBy(F.col("ratio").desc(), "term").select("term", "odds").collect())  # of SAMPLE rows at most
    lexicon = [(r["term"], round(float(r["odds"]), 6)) for r in chosen]
    automaton = LexiconAutomaton(lexicon)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([automaton.match(t)[0] > 0 for t in b.column(0).to_pylist()], pa.bool_()))

    # Words that clean texts use although they look like a term; the lexicon's own words excepted.
    clean = (terms.where("n0 > 0 and not endswith(term, '*')").select("term", "n0").mapInArrow(near, "term string, n0 long")
             .collect())  # of SAMPLE rows at most
    benign = frozenset(r["term"] for r in clean) - {t for t, _ in lexicon}
    model = {"lexicon": lexicon, "benign": benign}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LexiconAutomaton(lexicon, benign))
        for b in batches:
            f = [scorer.features(t)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sorted((tuple(r["x"]), r["y"]) for r in rows.mapInArrow(features, "x array<double>, y int").collect())
    model["weights"] = logistic(np.array([x for x, _ in got]), np.array([y for _, y in got], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, n_hits for every row."""
    spark = docs.sparkSession
    importable_on_workers(spark)
    model = fit(docs, labels, id_col, text_col)
    held = F.coalesce(_crc(id_col, 3) == 1, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    if "share" in model:
        return docs.select(id_col, held, F.lit(float(model["share"])).alias("score")).select(
            id_col, "held_out", "score", predicted, F.lit(0).cast("long").alias("n_hits"))
    shared, run = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, b = kept((__name__, run), lambda: Scorer(LexiconAutomaton(m["lexicon"], m["benign"]))), m["weights"]
        for batch in batches:
            score, hits = [], []
            for text in batch.column(2):
                x, n = scorer.features(text.as_py())
                z = sum(a * c for a, c in zip(x, b, strict=False)) + b[-1]
                score.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(hits, pa.int64())],
                                             names=["id", "held_out", "score", "n_hits"])

    rows = docs.select(F.col(id_col).alias("id"), held, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scores, f"id {kind}, held_out boolean, score double, n_hits long").select(
        F.col("id").alias(id_col), "held_out", "score", predicted, "n_hits")
