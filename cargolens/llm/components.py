"""Connected components of a large edge table by contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import cut

HASHED_FROM = 5


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the component's smallest node.

    Each round sends every node to the first of itself and its neighbours, jumps once more along these
    pointers, and contracts the edges to the nodes that are left.  First is the smallest node in the
    early rounds, which ends stars around a smallest node at once, and the smallest hash, other in
    every round, from round ``HASHED_FROM`` on, which shortens long chains by a constant share.  A node
    with very many edges only meets minima that are partly computed before the shuffle.
    """
    live = cut(edges.where("a <> b").select("a", "b").distinct())
    ups: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node"))
        if len(ups) >= HASHED_FROM:
            def place(c: str, seed: int = len(ups)):
                return F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("n"))
            up = both.agg(F.min(place("b")).alias("m")).select("node", F.least(place("node"), "m")["n"].alias("up"))
        else:
            up = both.agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = cut(up)
        up = cut(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")))
        ups.append(up)
        ends = [up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b")]
        live = cut(live.join(ends[0], "a").join(ends[1], "b").select(
            F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).where("a <> b").distinct())
    if not ups:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    known = ups[0].select("node", F.col("up").alias("label"))
    for up in ups[1:]:
        step = up.select(F.col("node").alias("label"), F.col("up").alias("to"))
        known = known.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    known = cut(known)
    if len(ups) <= HASHED_FROM:
        return known  # the smallest node has stayed in every round
    return known.join(known.groupBy("label").agg(F.min("node").alias("least")), "label").select("node", F.col("least").alias("label"))
