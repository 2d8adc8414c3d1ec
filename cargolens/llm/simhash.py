"""Document fingerprints by SimHash (operator 9, built-in functions only).

Terms are pairs of neighbouring words (the last word stands alone), weighted by how often they
occur.  Two 64-bit hashes of a term vote +1 or -1 on 128 bits; a bit is set if more than half of the
votes are for it.  The votes are counted by an ordinary aggregate over exploded terms: each of its
64 sums holds two 32-bit counters of one half word, so generated code adds longs and nothing else.

``near_pairs`` finds all fingerprints within a Hamming radius through permuted block tables.

Defined cases: null text is the empty text; a text without words has the fingerprint of zeros; equal
texts have equal fingerprints; rows with equal id and text get equal rows, of other rows with one id
the successor text is the one with the smallest hash; a document without an id has no successor (its
edited text is its first half, ``near_next`` is null); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.common import SPACE, cut, text_of

BITS = 128
#: Keeps the lowest bit of both 32-bit halves of a long.
HALVES = 0x0000000100000001


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` with ``hi``, ``lo``: the 128 bits as two longs.  Rows with equal keys must have equal texts.

    Partial sums are built where the texts are read; only they are shuffled, and nothing is if
    ``docs`` is already partitioned by a key.
    """
    words = F.split(text_of(text_col), f"[{SPACE}]+")
    terms = docs.select(*keys, words.alias("w")).select(*keys, F.explode(
        F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("t"))
    a, b = F.col("t").getField("a"), F.col("t").getField("b")
    hashed = terms.select(*keys, *[
        F.when(a != "", F.xxhash64(F.lit(seed), a, F.when(b != "", b))).alias(h) for h, seed in (("h1", 1), ("h2", 2))])
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(HALVES))).alias(f"{h}_{i}")
            for h in ("h1", "h2") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count("h1").alias("_votes"), *sums)

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"{h}_{i}", 32)
            for place, ones in ((i, low), (i + 32, high)):
                bit = (1 << place) - (1 << 64 if place == 63 else 0)
                out = out.bitwiseOR(F.when(2 * ones > F.col("_votes"), F.lit(bit)).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*keys, bits("h1").alias("hi"), bits("h2").alias("lo"))


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """Share of the bits that agree."""
    return F.lit(1.0) - distance(hi, lo, hi2, lo2) / F.lit(float(BITS))


def successors(ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, next): each distinct key's successor in ascending order, the first after the last.

    The keys are sorted over many partitions and cut; each partition links its own keys, and the last
    of it takes the first key of the next partition from a table with one row a partition.
    """
    order = cut(ids.select(key).where(F.col(key).isNotNull()).distinct().sort(key)
                .withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    firsts = order.groupBy("part").agg(F.min(key).alias("first"))
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(Window.orderBy("part")),
                                                   F.min("first").over(Window.partitionBy())))
    inner = order.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(key)))
    return (inner.join(F.broadcast(firsts.select("part", "after")), "part")  # one row a partition
            .select(key, F.coalesce("next", "after").alias("next")))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in ascending id order.  Texts are shuffled once by id; of the next
    document only the part that is put in moves to its neighbour.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    own = cut(fingerprints(rows, ["id", "h"]))
    slim = cut(rows.select("id", "h", "n_chars"))
    heads = slim.where("id is not null").groupBy("id").agg(F.min("h").alias("h"))
    links = (slim.where("id is not null").distinct().join(successors(slim), "id")
             .join(heads.select(F.col("id").alias("next"), F.col("h").alias("next_h")), "next"))
    links = cut(links.select("id", "h", "next", "next_h", F.floor(F.col("n_chars") / 2).cast("int").alias("half")))

    # Both joins below read one shuffle of the texts, so both take the same columns and rows of it.
    texts = rows.where("id is not null").select("id", "h", "text").repartition("id")
    wanted = links.select(F.col("id").alias("for_id"), F.col("h").alias("for_h"), F.col("next").alias("id"),
                          F.col("next_h").alias("want_h"), "half")
    # The hash is compared as a difference, so that joins and sums all use the one partitioning by id.
    put = (texts.join(wanted, "id").where(F.col("h") - F.col("want_h") == 0)
           .select("for_id", "for_h", F.substring("text", F.lit(1), F.col("half")).alias("put"))
           .repartition("for_id").groupBy("for_id", "for_h").agg(F.max("put").alias("put")))
    n = F.length("text")
    first_half = F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int"))
    edited = texts.join(put, (F.col("id") == F.col("for_id")) & (F.col("h") - F.col("for_h") == 0)).select(
        "id", "h", F.concat(first_half, F.col("put")).alias("text"))
    alone = rows.where("id is null").select("id", "h", first_half.alias("text"))

    def after_edit(df: DataFrame) -> DataFrame:
        df = df.select("id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), "text")
        return fingerprints(df, ["id", "h", "edited_sha256"])

    after = after_edit(edited).unionByName(after_edit(alone)).withColumnsRenamed({"hi": "hi2", "lo": "lo2"})

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    own = own.withColumnsRenamed({"id": "oid", "h": "oh"})
    nxt = own.select(F.col("oid").alias("nid"), F.col("oh").alias("nh"), F.col("hi").alias("hi3"), F.col("lo").alias("lo3"))
    after = after.withColumnsRenamed({"id": "aid", "h": "ah"})
    links = links.select(F.col("id").alias("lid"), F.col("h").alias("lh"), "next", "next_h").join(
        nxt, (F.col("next") == F.col("nid")) & (F.col("next_h") == F.col("nh")))
    out = (slim.join(own, same("id", "oid") & same("h", "oh"))
           .join(after, same("id", "aid") & same("h", "ah"))
           .join(links, (F.col("id") == F.col("lid")) & (F.col("h") == F.col("lh")), "left"))
    mine = (F.col("hi"), F.col("lo"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(*mine).alias("fingerprint"),
        as_hex(F.col("hi2"), F.col("lo2")).alias("edited_fingerprint"),
        likeness(*mine, F.col("hi2"), F.col("lo2")).alias("near_edited"),
        likeness(*mine, F.col("hi3"), F.col("lo3")).alias("near_next"), F.col("next").alias("next_id"))


def near_pairs(prints: DataFrame, radius: int = 3, spare: int = 2, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """All pairs of distinct fingerprints within ``radius`` bits: (members, pairs).

    ``prints`` has ``id_col``, ``hi``, ``lo``.  Equal fingerprints are one class, named by its
    smallest id; ``members`` is (id, class_id) and ``pairs`` links classes (a, b, bits; a < b).
    The bits are cut into ``radius + spare`` blocks.  Two fingerprints within the radius agree on
    some ``spare`` of them, so one permuted table for each choice of ``spare`` blocks, joined on these
    blocks' bits, finds every pair; a pair that several tables find is kept by its first table.
    """
    blocks = radius + spare
    classes = cut(prints.groupBy("hi", "lo").agg(F.min(id_col).alias("class_id")))
    members = prints.join(classes, ["hi", "lo"]).select(F.col(id_col), "class_id")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def masks(a: int, b: int) -> tuple[int, int]:
        m = ((1 << b) - 1) ^ ((1 << a) - 1)
        signed = [x - (1 << 64) if x >> 63 else x for x in (m >> 64, m & ((1 << 64) - 1))]
        return signed[0], signed[1]

    parts = [masks(a, b) for a, b in itertools.pairwise(edges)]
    agree = [(F.col("hi").bitwiseXOR(F.col("hi2")).bitwiseAND(F.lit(x)) == 0)
             & (F.col("lo").bitwiseXOR(F.col("lo2")).bitwiseAND(F.lit(y)) == 0) for x, y in parts]
    tables = list(itertools.combinations(range(blocks), spare))
    keyed = classes.select("class_id", "hi", "lo", F.explode(F.array(*[
        F.struct(F.lit(n).alias("t"),
                 F.col("hi").bitwiseAND(F.lit(_either(parts, t, 0))).alias("k1"),
                 F.col("lo").bitwiseAND(F.lit(_either(parts, t, 1))).alias("k2")) for n, t in enumerate(tables)])).alias("k")).select(
        "class_id", "hi", "lo", "k.*")
    other = keyed.withColumnsRenamed({"class_id": "b", "hi": "hi2", "lo": "lo2"})
    first = F.lit(len(tables))
    for n, t in reversed(list(enumerate(tables))):
        both = agree[t[0]]
        for i in t[1:]:
            both = both & agree[i]
        first = F.when(both, F.lit(n)).otherwise(first)
    bits = distance(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2"))
    pairs = (keyed.withColumnRenamed("class_id", "a").join(other, ["t", "k1", "k2"])
             .where((F.col("a") < F.col("b")) & (bits <= radius) & (F.col("t") == first))
             .select("a", "b", bits.alias("bits")))
    return members, pairs


def _either(parts: list[tuple[int, int]], chosen: tuple[int, ...], word: int) -> int:
    out = 0
    for i in chosen:
        out |= parts[i][word]
    return out
