"""Approximate nearest neighbours by a hierarchical k-means tree (operator 3).

*Tree*: k-means with ``BRANCH`` centres, again within each cell, down to cells of about ``LEAF``
vectors, fitted on a bounded sample of distinct vectors (``SAMPLE``); it is broadcast (at most twice
``SAMPLE`` / ``LEAF`` nodes for each level).  *Index*: every distinct vector goes to the leaf it
descends to.  *Search*: best bin first: a priority queue holds the branches not taken, ordered by the
inner product of the query with their centres plus its length times the cell's radius (no vector of the sample's cell
can do better); leaves are visited in the order in which they leave the queue.  *Calibration*: for
``CHECKS`` sampled queries the true neighbours are found among all vectors, and the number of leaves visited is widened
until mean recall reaches ``RECALL``.

Work is joined by leaf.  Leaves are split into blocks of ``BLOCK`` vectors and their queries into blocks of
``QUERIES``, so no task grows with a hot leaf.  Equal vectors are one vector with its smallest ids, so
a vector that a third of all rows repeat is searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
and neither do vectors of another length than the most frequent one (of equally frequent, the longest); of rows
that repeat an id the smallest vector counts; fewer candidates than ``k`` are all returned; ties go to the smaller
id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import bounded_sample, cut, importable_on_workers

K = 20
BRANCH = 16
LEAF = 64
SAMPLE = 20_000
CHECKS = 200
RECALL = 0.97
BLOCK = 4096
QUERIES = 4096
#: Results of one block beyond k that are scored exactly, so that rounding in the matrix product loses none.
SLACK = 12


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from a k-means++ start; returns centres, none of them empty."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 0:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c[np.bincount(nearest(x, c), minlength=len(c)) > 0]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


class Tree:
    """Nodes with centre, radius and children; a node without children is a leaf."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        work = [(self._node(x), x)]
        while work:
            node, part = work.pop()
            c = kmeans(part, min(branch, max(2, -(-len(part) // leaf))), rng) if len(part) > leaf else part[:0]
            if len(c) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            own = nearest(part, c)
            for j in range(len(c)):
                child = self._node(part[own == j], c[j])
                self.children[node].append(child)
                work.append((child, part[own == j]))
        self.stack = {n: np.array([self.centre[i] for i in ch]) for n, ch in enumerate(self.children) if ch}

    def _node(self, part: np.ndarray, centre: np.ndarray | None = None) -> int:
        c = part.mean(0) if centre is None else centre
        self.centre.append(c)
        self.radius.append(float(np.sqrt(((part - c) ** 2).sum(1).max())) if len(part) else 0.0)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centre) - 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            own = nearest(x[rows], self.stack[node])
            work += [(child, rows[own == j]) for j, child in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves for a query, best bin first."""
        length, out, queue = float(np.sqrt(q @ q)), [], [(0.0, 0)]
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                continue
            for child, dot in zip(self.children[node], self.stack[node] @ q, strict=True):
                heapq.heappush(queue, (-(float(dot) + 0.5 * length * self.radius[child]), child))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def exact_best(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k best rows of x by inner product (ties: smaller ``first``) and their scores.

    The product of matrices only preselects; scores are sums over one vector pair at a time, so equal pairs
    have equal scores wherever they stand.
    """
    approx = q @ x.T
    m = min(k + SLACK, x.shape[0])
    top = np.argpartition(-approx, m - 1, axis=1)[:, :m] if m < x.shape[0] else np.tile(np.arange(m), (len(q), 1))
    score = np.stack([(x[t] * v).sum(1) for t, v in zip(top, q, strict=True)])
    order = np.lexsort((first[top], -score), axis=1)[:, :k]
    return np.take_along_axis(top, order, 1), np.take_along_axis(score, order, 1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, one for each id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(ok)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def search(df: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k nearest found."""
    spark = df.sparkSession
    importable_on_workers(spark)
    rows = cut(usable(df, id_col, vec_col))
    # Equal vectors: the smallest ids are chosen where the rows are, before anything is shuffled.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = cut(rows.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("v")
                   .agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "v"))
    asked = cut(rows.where(F.col("id") % every == 0).join(distinct.select("v", "key"), "v").select("id", "key"))
    count = distinct.count()
    sample = bounded_sample(distinct, "key", SAMPLE, 3, count).select("key", "v").collect()
    if not sample:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    sample.sort(key=lambda r: r["key"])
    tree = Tree(np.array([r["v"] for r in sample], np.float64))
    shared = spark.sparkContext.broadcast(tree)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.descend(_matrix(b.column(2))))], names=["key", "ids", "v", "leaf"])

    index = cut(distinct.mapInArrow(leaf_of, "key long, ids array<long>, v array<double>, leaf long"))
    queries = index.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    visits = _calibrated(index, queries, tree, k)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [shared.value.visit(q, visits) for q in _matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int64()))], names=["key", "v", "leaves"])

    wanted = cut(queries.mapInArrow(plan, "key long, v array<double>, leaves array<long>")
                 .select(F.col("key").alias("q"), "v", F.explode("leaves").alias("leaf")))
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    loads = wanted.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("loads"))
    shape = F.broadcast(cut(sizes.join(loads, "leaf")))  # one row a leaf of the tree
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    load = F.pmod(F.xxhash64("q"), F.col("loads")).cast("int").alias("load")
    left = index.join(shape, "leaf").select("leaf", block, F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("load"), "key", "ids", "v")
    right = wanted.join(shape, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), load, "q", "v")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        q, key, ids, score = [], [], [], []
        if len(x) and len(y):
            x, y = x.combine_chunks(), y.combine_chunks()
            first = x.column("key").to_numpy()
            vs, qs = _matrix(x.column("v").chunk(0)), _matrix(y.column("v").chunk(0))
            for a in range(0, len(qs), 512):
                top, s = exact_best(qs[a: a + 512], vs, first, k + 1)
                q.append(np.repeat(y.column("q").to_numpy()[a: a + 512], top.shape[1]))
                key.append(first[top].reshape(-1))
                ids.append(top.reshape(-1))
                score.append(s.reshape(-1))
        flat = [np.concatenate(z) if z else np.zeros(0, t) for z, t in ((q, np.int64), (key, np.int64), (ids, np.int64), (score, np.float64))]
        lists = x.column("ids").chunk(0).take(pa.array(flat[2])) if len(flat[2]) else pa.array([], pa.list_(pa.int64()))
        return pa.table({"q": pa.array(flat[0]), "first": pa.array(flat[1]), "ids": lists, "score": pa.array(flat[3])})

    found = left.groupBy("leaf", "block", "load").cogroup(right.groupBy("leaf", "block", "load")).applyInArrow(
        best, "q long, first long, ids array<long>, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "first")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # At most k + 1 vectors a query, each with at most k + 1 ids.
    pairs = F.transform(F.col("ids"), lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    lists = top.groupBy(F.col("q").alias("key")).agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("near"))
    out = asked.join(lists, "key").select(F.col("id").alias("query_id"), F.slice(
        F.filter("near", lambda s: s["id"] != F.col("id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def _calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int) -> int:
    """Leaves to visit so that the sampled queries find ``RECALL`` of their true neighbours."""
    checks = bounded_sample(queries, "key", CHECKS, 5).collect()
    if not checks:
        return 1
    q, keys = np.array([r["v"] for r in checks], np.float64), np.array([r["key"] for r in checks])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaf = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not len(b):
                continue
            top, s = exact_best(q, _matrix(b.column(1)), b.column(0).to_numpy(), k + 1)
            own = b.column(0).to_numpy()[top] == keys[:, None]
            score = np.hstack([score, np.where(own, -np.inf, s)])
            leaf = np.hstack([leaf, b.column(2).to_numpy()[top]])
            keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, leaf = np.take_along_axis(score, keep, 1), np.take_along_axis(leaf, keep, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(score.reshape(-1)), pa.array(leaf.reshape(-1))],
                                         names=["q", "score", "leaf"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "leaf")
    truth = (index.select("key", "v", "leaf").mapInArrow(scan, "q long, score double, leaf long").where(f"score > {float('-1e308')}")
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "leaf").collect())
    if not truth:
        return 1
    rank = [{leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves))} for v in q]
    needed = np.sort(np.array([rank[t["q"]][t["leaf"]] for t in truth]))
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1
