"""Near-duplicate detection by fast similarity sketches (operator 4).

A document's set is its distinct five-word shingles (64-bit hashes).  The sketch has ``BINS``
coordinates and is filled in rounds: in round i every element is hashed to one bin with a value in
[i, i + 1), and a coordinate keeps its smallest value, so a round that follows never changes a
coordinate that is filled.  From round ``BINS`` on, round i puts all elements into bin i - ``BINS``,
so after 2 ``BINS`` rounds at the latest every coordinate is filled, also of a set with one element;
a set of n elements needs about BINS * ln(BINS) / n rounds.  The coordinates agree with the sets'
Jaccard likeness and concentrate as for independent hash functions.

Banding: documents that agree on all ``ROWS`` coordinates of one of ``BANDS`` bands are candidates.  At
likeness 0.75 a pair agrees on none of the 32 bands of 4 with probability 5e-6 (8e-9 at 0.8).
Within a bucket not all pairs are made: members are held against a few pivots, links are contracted to
components, and only members of buckets that still span several components go on (``link``).
Every link is confirmed on the full sets: 100 * intersection >= 75 * union.

Equal sets are one class before banding, so exact copies, however many, cost one row each.

Defined cases: null or wordless text has an empty set, is linked with nothing and kept; fewer than five
words are one shingle, the whole sequence; rows with equal ids are one document for linking and
share a component; a row without an id takes no part in links (null component, kept); an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import counted_broadcast, cut, fresh, importable_on_workers
from cargolens.llm.components import components
from cargolens.llm.words import FOLDED, Words, groups, mix, shingles

SIZE = 5
PERCENT = 75
BINS = 128
BANDS = 32
ROWS = BINS // BANDS
U = np.uint64
SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def distinct(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document (consecutive runs of ``count``) and their numbers."""
    out, n, a = [], np.zeros(len(count), np.int64), 0
    for d, c in enumerate(count):
        if c:
            x = np.sort(values[a: a + c])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            out.append(x)
            n[d] = len(x)
            a += c
    return (np.concatenate(out) if out else np.zeros(0, U)), n


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of a batch: concatenated sorted distinct hashes and each document's number."""
    return distinct(*shingles(Words(data, offsets, FOLDED), SIZE))


def sketches(elements: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sketch of each set, in rounds over the sets that still have an empty coordinate."""
    s = np.full((len(n), BINS), EMPTY, U)
    flat = s.reshape(-1)
    x, doc = elements, np.repeat(np.arange(len(n)), n)
    open_ = n > 0
    for i in range(2 * BINS):
        v = mix(x ^ SEEDS[i])
        place = (v >> U(57)).astype(np.int64) if i < BINS else np.int64(i - BINS)
        np.minimum.at(flat, doc * BINS + place, (v & U((1 << 56) - 1)) | U(i << 56))
        at = np.flatnonzero(open_)
        filled = at[(s[at] != EMPTY).all(axis=1)]
        if len(filled):
            open_[filled] = False
            if not open_.any():
                break
            keep = open_[doc]
            x, doc = x[keep], doc[keep]
    return s


def bands_of(s: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    rows = s.reshape(len(s), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U)[None, :] * U(0x9E3779B97F4A7C15) + U(1)
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r])
    return key


ROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                 ("bands", pa.list_(pa.int64()))])
#: Documents and shingles of one block; larger candidate groups are compared block by block.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 500_000


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offsets in groups(batch.column(1)):
            x, n = sets_of(data, offsets)
            owner = np.repeat(np.arange(len(n)), n)
            keys = []
            for seed in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
                k = np.zeros(len(n), U)
                np.add.at(k, owner, mix(x ^ seed))  # a sum of mixed elements names the set
                keys.append(mix(k + n.astype(U)).view(np.int64))
            bands = bands_of(sketches(x, n)).view(np.int64).reshape(-1)
            offs = np.arange(b - a + 1, dtype=np.int32) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(bands))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], schema=ROW)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (which name the set) and the band keys of every row."""
    importable_on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: _sketch_batches(fresh(b)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def confirmed_links(elements: np.ndarray, n: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what is linked by 100 * intersection >= 75 * union among the given sets.

    Intersections of one set with all others come from postings of the shingles that several sets
    have.  ``side``: compare only sets of different sides.  Returned are the links of a forest, not
    all pairs.
    """
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(elements, kind="stable")
    e, o = elements[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(e)))
    run = np.repeat(np.arange(len(first)), size)
    shared = size[run] > 1
    # Back in order of the sets: for each shared element of a set the run it belongs to.
    back = np.empty(len(e), np.int64)
    back[order] = np.where(shared, run, -1)
    ends = np.cumsum(n)
    forest, out = _Forest(len(n)), []
    for i in range(len(n)):
        mine = back[ends[i] - n[i]: ends[i]]
        mine = mine[mine >= 0]
        if 100 * len(mine) < PERCENT * n[i]:
            continue
        sizes = size[mine]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[mine], sizes)
        common = np.bincount(o[at], minlength=len(n))
        ok = 100 * common >= PERCENT * (n + n[i] - common)
        ok[: i + 1] = False
        if side is not None:
            ok &= side != side[i]
        for j in np.flatnonzero(ok):
            if forest.root(i) != forest.root(int(j)):
                forest.join(i, int(j))
                out.append((i, int(j)))
    return out


def _link_block(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    ids = table.column("node").to_numpy()
    side = table.column("side").to_numpy()
    xs, ns = [], []
    for _, _, data, offsets in groups(table.column("text")):
        x, n = sets_of(data, offsets)
        xs.append(x)
        ns.append(n)
    links = confirmed_links(np.concatenate(xs), np.concatenate(ns), side if side.any() else None)
    return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})


def link(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label) of all documents linked with another; nodes are the smallest ids of equal sets."""
    classes = cut(rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2")
                  .agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n")))
    bands = classes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = cut(components(bands.join(buckets, "band").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
               .withColumnRenamed("label", "grp").join(classes.groupBy("node").agg(F.max("n").alias("n")), "node"))
    # Sets of likeness 0.75 differ in size by a third at most, so by one size class (of 1.34) at most.
    near = near.withColumn("sc", F.floor(F.log(1.34, F.col("n").cast("double"))).cast("int"))
    whole = near.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("mass"))
    whole = whole.select("grp", ((F.col("docs") <= BLOCK_DOCS) & (F.col("mass") <= BLOCK_SHINGLES)).alias("one"))
    parts = near.groupBy("grp", "sc").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    one = near.join(whole.where("one"), "grp").select(
        "node", F.col("grp").alias("t0"), F.lit(-1).alias("t1"), F.lit(0).alias("t2"), F.lit(0).alias("t3"), F.lit(0).alias("side"))
    many = near.join(whole.where("not one"), "grp").join(parts, ["grp", "sc"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    above = parts.select("grp", (F.col("sc") - 1).alias("sc"), F.col("parts").alias("parts_above"))
    below = parts.select("grp", (F.col("sc") + 1).alias("sc"), F.col("parts").alias("parts_below"))
    many = many.join(above, ["grp", "sc"], "left").join(below, ["grp", "sc"], "left")

    def upto(n: str):
        return F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(0)) - 1) if n == "parts" else F.when(
            F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    # A block meets itself and the others of its size class once, and those of the next class.
    tasks = F.concat(
        F.transform(upto("parts"), lambda j: F.struct(F.col("sc").alias("t1"), F.least(j, F.col("part")).alias("t2"),
                                                      F.greatest(j, F.col("part")).alias("t3"),
                                                      F.when(j == F.col("part"), 0).when(j < F.col("part"), 2).otherwise(1).alias("side"))),
        F.transform(upto("parts_above"), lambda j: F.struct(F.col("sc").alias("t1"), F.col("part").alias("t2"), (-1 - j).alias("t3"), F.lit(1).alias("side"))),
        F.transform(upto("parts_below"), lambda j: F.struct((F.col("sc") - 1).alias("t1"), j.alias("t2"), (-1 - F.col("part")).alias("t3"), F.lit(2).alias("side"))))
    many = many.select("node", F.col("grp").alias("t0"), F.explode(tasks).alias("t")).select("node", "t0", "t.*")
    work = cut(one.unionByName(many.select(*one.columns)))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    links = (texts.join(counted_broadcast(work), "node")
             .groupBy("t0", "t1", "t2", "t3").applyInArrow(_link_block, "a long, b long"))
    again = rows.where("doc_id is not null and n_shingles > 0").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    return components(links.unionByName(again))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    rows = cut(sketched(docs, id_col, text_col))
    labels = link(docs, rows, id_col, text_col)
    slim = rows.select("doc_id", "n_shingles", "k1", "k2")
    nodes = slim.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = nodes.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component"))
    # Wordless rows match no set; a constant pair of keys for them would be one hot key for nothing.
    worded = slim.where("n_shingles > 0").join(nodes, ["k1", "k2"])
    rest = slim.where("n_shingles = 0").withColumn("component", F.col("doc_id"))
    out = worded.unionByName(rest).withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id.

    Of rows that repeat an id with words one stays, the one with the smallest text hash; wordless rows and rows without
    an id all stay.
    """
    found = cut(near_duplicates(docs, id_col, text_col))
    dropped = counted_broadcast(cut(found.where("not kept").select(F.col(id_col).alias("_drop")).distinct()))
    out = docs.join(dropped, F.col(id_col).cast("long") == F.col("_drop"), "left_anti")
    again = cut(found.where("kept and n_shingles > 0").groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("c"))
                .where("c > 1 and _again is not null").select("_again"))
    if again.isEmpty():
        return out
    again = counted_broadcast(again)
    same = F.col(id_col).cast("long") == F.col("_again")
    one = (out.join(again, same, "left_semi").groupBy(id_col)
           .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.coalesce(text_col, F.lit("")))).alias("_row")).select("_row.*"))
    return out.join(again, same, "left_anti").unionByName(one.select(*docs.columns))
