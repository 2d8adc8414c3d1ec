"""Mixing sources to target weights by entropy balancing (operator 10, built-in functions only).

Every document gets a rate between 0 and ``most`` copies.  Among all rates that meet each source's
token target, the ones taken have the largest entropy relative to "as it is" (rate ``most`` / 2):
the dual of that problem has one multiplier per source and the document's size as its covariate,
so the odds ``rate / (most - rate)`` are tilted exponentially by ``exp(multiplier * size / mean size)``.
Newton steps on the dual run over a table of (source, size, number of documents): rows with the same
source and size have the same rate, so that table is an exact and far smaller stand-in for the
documents, and a source with a third of all rows is pre-aggregated before anything moves.

Rates become whole copies by a fixed hash of the document id (so reruns agree); what this rounding
leaves of a source's target is then made up by as many moves by one copy as it takes, until no single
move brings the source nearer to its target.

Defined cases: null text has size 0; size 0 takes 0 words; a null source is a source of its own, last
in order; an empty table gives an empty result; repeated rows (same id and source) are rounded alike,
so a source of them can end off its target; columns other than id, text and source are not read by ``mix``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import BROADCAST_ROWS, WORD, counted_broadcast, cut, text_of
from cargolens.session import ensure_checkpoint_dir

#: Newton steps between two looks at whether all sources are solved, and steps at most.
STEPS_AT_ONCE, NEWTON_STEPS = 4, 40
#: Relative error of a source's tokens at which its multiplier counts as solved.
TOLERANCE = 1e-6
#: Parts that a source's sizes, or the documents of one size, are dealt to for running sums.
PARTS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Source sizes ``(source, source_size)`` with ``target``.

    Sources by code point (null last) take ``weights`` in turn and share ``share`` times all sizes by
    weight; a target stops at ``most`` times the source's size and what it leaves is shared anew by
    weight among the others.  In order of cap / weight the stopped sources come first, so the common
    level is found from running sums instead of by repeated sharing.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (t.withColumn("budget", share * F.sum("source_size").over(everything))
         .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after)))
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    t = t.withColumn("level", F.max(free).over(everything))  # the level falls after the first source that fits
    return t.select("source", "source_size",
                    F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    """most / (1 + exp(-tilt * x)); an infinite tilt gives 0 or ``most``."""
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-F.least(F.greatest(tilt * x, F.lit(-700.0)), F.lit(700.0))))


def _beside(df: DataFrame, few: bool) -> DataFrame:
    """A table with a row a source, for a join: broadcast if the sources were counted to be few."""
    return F.broadcast(df) if few else df


def solve(histogram: DataFrame, goals: DataFrame, most: int, few: bool) -> DataFrame:
    """Newton on the dual: ``histogram`` (source, size, n) and ``goals`` (source, source_size, target)
    give (source, source_size, target, mean_size, tilt).

    The function is monotone in each multiplier.  The start is the tilt that a source of equal sizes
    would need; a step that leaves the bracket is replaced by its middle (or by doubling while there
    is no bracket).  A target at its cap or at 0 needs no finite tilt.
    """
    mean = histogram.where("size > 0").groupBy(F.col("source").alias("_source")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    cap = most * F.col("source_size").cast("double")
    full, none = F.col("target") >= cap * (1 - 1e-12), F.col("target") <= 0
    state = cut(goals.join(mean, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", F.coalesce("mean_size", F.lit(1.0)).alias("mean_size"),
        F.when(full, F.lit(1e9)).when(none, F.lit(-1e9)).otherwise(F.log(F.col("target") / (cap - F.col("target")))).alias("tilt"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (full | none).alias("done")))
    for done in range(NEWTON_STEPS):
        if done % STEPS_AT_ONCE == 0 and state.where("not done").isEmpty():
            break
        s = _beside(state.select(F.col("source").alias("_source"), "tilt", "mean_size", "done").where("not done"), few)
        x = F.col("size") / F.col("mean_size")
        r = _rate(F.col("tilt"), x, most)
        mass = F.col("size") * F.col("n")
        sums = (histogram.join(s, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source")
                .agg(F.sum(mass * r).alias("value"), F.sum(mass * x * r * (F.lit(1.0) - r / most)).alias("slope")))
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        reach = 4 + 2 * F.abs("tilt")
        low, high = F.coalesce(lo, F.col("tilt") - reach), F.coalesce(hi, F.col("tilt") + reach)
        solved = F.abs(gap) <= TOLERANCE * F.col("target")
        live = ~F.col("done") & F.col("value").isNotNull()
        moved = F.when((step > low) & (step < high), step).when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(
            gap < 0, high).otherwise(low)
        state = cut(state.join(_beside(sums, few), F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "mean_size", F.when(live & ~solved, moved).otherwise(F.col("tilt")).alias("tilt"),
            F.when(live, lo).otherwise(F.col("lo")).alias("lo"), F.when(live, hi).otherwise(F.col("hi")).alias("hi"),
            (F.col("done") | ~live | solved).alias("done")))
    # Sums of doubles differ in their last bits from run to run; what follows must not.
    return state.select("source", "source_size", "target", "mean_size", F.round("tilt", 9).alias("tilt"))


def rounded(sized: DataFrame, solved: DataFrame, most: int, few: bool) -> DataFrame:
    """``sized`` (id, source, size, ...) with its source's target, its rate, its place ``u`` in [0, 1) among
    the documents of its source and size, and hashed whole ``copies``: one more if ``u`` is below the fraction."""
    s = _beside(solved.withColumnRenamed("source", "_source"), few)
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("id").cast("string"), F.col("source")), 11) / F.lit(float(2 ** 53))
    rate = _rate(F.col("tilt"), F.col("size") / F.col("mean_size"), most)
    return (sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0))).withColumn("u", u)
            .withColumn("copies", F.when(F.col("size") > 0, F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0))
                        .otherwise(0).cast("long")))


def _rooms(rows: DataFrame, most: int, few: bool) -> DataFrame:
    """``rows`` with what is ``left`` of the source's target, and how many copies of each size can be added or
    taken away: ``near`` while every document keeps its rate rounded up or down, ``wide`` within 0 and ``most``."""
    left = rows.groupBy(F.col("source").alias("_source")).agg(
        (F.first("target") - F.sum(F.col("size") * F.col("had"))).alias("left"))
    more = F.col("left") > 0
    return (rows.join(_beside(left, few), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("near", F.greatest(F.when(more, F.col("n") * F.col("up") - F.col("had")).otherwise(
                F.col("had") - F.col("n") * F.col("down")), F.lit(0)))
            .withColumn("wide", F.when(more, F.col("n") * most - F.col("had")).otherwise(F.col("had"))))


def _stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, by way of Parquet files: a checkpoint keeps its plan's estimated size, and joins multiply
    those, so in a chain of rounds that join a table with itself the estimate's digits double every time."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/mixing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _moved(rows: DataFrame, k: Column) -> DataFrame:
    """The rows after moving ``k`` copies of each towards the target; ``k`` stays as a column."""
    k = F.coalesce(k, F.lit(0)).cast("long")
    return _stored(rows.select("source", "size", "n", "down", "up", "target",
                               (F.col("had") + F.signum("left").cast("long") * k).alias("had"), k.alias("k")))


def _spread(rows: DataFrame, most: int, few: bool) -> DataFrame:
    """Moves the same share of every size's near room, rounded down."""
    r = _rooms(rows, most, few)
    room = F.when(F.col("size") <= F.abs("left"), F.col("near")).otherwise(0)
    total = r.groupBy(F.col("source").alias("_source")).agg(F.sum(room * F.col("size")).alias("total"))
    share = F.least(F.abs("left") / F.greatest("total", F.lit(1)), F.lit(1.0))
    return _moved(r.join(_beside(total, few), F.col("source").eqNullSafe(F.col("_source"))), F.floor(room * share))


def _prefix(rows: DataFrame, most: int, few: bool) -> DataFrame:
    """Moves the sizes not above the remainder, in the order of a hash, as far as their running sum fits.

    Near rooms are used while there are any.  The running sum has two levels, over the at most ``PARTS``
    parts of a source and over the sizes in a part, so no task holds a source.
    """
    order = F.xxhash64(F.lit("move"), F.col("source"), F.col("size"))
    r = _rooms(rows, most, few).withColumn("order", order).withColumn("part", F.pmod("order", F.lit(PARTS)))
    fits = r.where(F.col("size") <= F.abs("left"))
    parts = fits.groupBy(F.col("source").alias("_source"), F.col("part").alias("_part")).agg(
        F.sum(F.col("near") * F.col("size")).alias("near_mass"), F.sum(F.col("wide") * F.col("size")).alias("wide_mass"))
    near = F.sum("near_mass").over(Window.partitionBy("_source")) > 0
    parts = parts.withColumn("use_near", near)
    mass = F.when(F.col("use_near"), F.col("near_mass")).otherwise(F.col("wide_mass"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_source", "_part", "use_near", F.coalesce(F.sum(mass).over(earlier), F.lit(0)).alias("earlier"))
    r = r.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")), "left")
    room = F.when(F.col("size") <= F.abs("left"), F.when(F.col("use_near"), F.col("near")).otherwise(F.col("wide"))).otherwise(0)
    before = Window.partitionBy("source", "part").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("room", room)
    before = F.col("earlier") + F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
    r = r.withColumn("fit", F.floor((F.abs("left") - before) / F.col("size")))
    return _moved(r, F.least(F.greatest("fit", F.lit(0)), F.col("room")))


def _single(rows: DataFrame, most: int, few: bool) -> DataFrame:
    """Moves one document of each source, the one that leaves least, if that is less than before."""
    r = _rooms(rows, most, few)
    rest = F.abs(F.abs("left") - F.col("size"))
    best = r.where((F.col("wide") > 0) & (rest < F.abs("left"))).groupBy(F.col("source").alias("_source")).agg(
        F.min_by("size", F.struct(rest, F.col("near") == 0, "size")).alias("_size"))
    return _moved(r.join(_beside(best, few), F.col("source").eqNullSafe(F.col("_source")), "left"),
                  F.when(F.col("size") == F.col("_size"), 1))


def repairs(copied: DataFrame, most: int, few: bool) -> DataFrame:
    """Rules (_source, _size, base, last) for the sizes whose copies change: a document has ``base``
    copies, and one more if its ``u`` is not above ``last``.

    Documents of one source and size are interchangeable, so moves are decided on that table, by the
    number of copies ``had`` of all its documents.  Every move brings its source nearer to the target,
    so the rounds end; they do when no single document of less than twice the remainder can be moved.
    """
    n = F.col("n")
    rows = _stored(copied.where("size > 0").groupBy("source", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.floor("rate")).alias("down"), F.first(F.ceil("rate")).alias("up"),
        F.first("target").alias("target"), F.sum("copies").alias("had")))
    hashed = rows.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("had").alias("hashed"))
    rows = _spread(rows, most, few)
    while True:
        rows = _single(_prefix(rows, most, few), most, few)
        if rows.where("k > 0").isEmpty():
            break
    rules = cut(rows.join(hashed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
                .where("had <> hashed").select("_source", "_size", F.floor(F.col("had") / n).alias("base"), (F.col("had") % n).alias("extra")))
    # The place of the extra-th document of a size: its part by counts, then its rank in the part.
    docs = (copied.where("size > 0").join(counted_broadcast(rules.where("extra > 0")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
            .select("_source", "_size", "extra", "u", F.floor(F.col("u") * PARTS).alias("part")))
    parts = docs.groupBy("_source", "_size", "extra", "part").agg(F.count(F.lit(1)).alias("in_part"))
    upto = Window.partitionBy("_source", "_size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("rank", F.col("extra") - F.sum("in_part").over(upto) + F.col("in_part")).where("rank between 1 and in_part")
    parts = parts.select(F.col("_source").alias("s"), F.col("_size").alias("z"), F.col("part").alias("p"), "rank")
    there = docs.join(parts, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z")) & (F.col("part") == F.col("p")))
    place = F.row_number().over(Window.partitionBy("_source", "_size").orderBy("u"))
    last = there.withColumn("place", place).where("place = rank").select("s", "z", F.col("u").alias("last"))
    return cut(rules.join(last, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z")), "left")
               .select("_source", "_size", "base", F.coalesce("last", F.lit(-1.0)).alias("last")))


def plan(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame, bool]:
    """The small tables that decide every document's copies, solved sources and rules, and
    whether the sources are few enough to be broadcast (there is another way beyond that)."""
    histogram = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = cut(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    few = per_source.count() <= BROADCAST_ROWS
    solved = solve(histogram, targets(per_source, weights, share, most), most, few)
    return solved, repairs(rounded(sized, solved, most, few), most, few), few


def _decided(sized: DataFrame, solved: DataFrame, rules: DataFrame, few: bool, most: int) -> DataFrame:
    out = rounded(sized, solved, most, few).join(
        counted_broadcast(rules), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left")
    ruled = F.col("base") + F.when(F.col("u") <= F.col("last"), 1).otherwise(0)
    return out.withColumn("copies", F.coalesce(ruled, F.col("copies")).cast("long")).drop("_source", "_size", "base", "last", "u")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken."""
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                            word_count(text_of(text_col)).alias("size")))
    out = _decided(sized, *plan(sized, weights, share, most), most)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                      "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: every document as often as it has copies, with the columns of ``docs``.

    The texts don't move while the two tables that decide can be broadcast: each row finds its copies where it is read.
    """
    names = docs.columns
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"),
                      F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"))
    sized = cut(one.select("id", "source", "size"))
    out = _decided(one, *plan(sized, weights, share, most), most).where("copies > 0")
    return (out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
            .select(*[F.col("row").getField(c).alias(c) for c in names]))
