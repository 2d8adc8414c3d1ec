"""Classifiers by held-out accuracy, mixing by its targets, neighbours by recall, the pipeline by its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import ann_tree, mixing, quality, toxicity
from cargolens.llm.common import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_on_held_out_rows(spark, awkward, nothing, labels):
    rows = quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held > 0.93
    without = quality.classify(awkward, labels).collect()
    assert len(without) == awkward.count() and {r["score"] for r in without} == {0.5}
    some = quality.classify(awkward, table(spark, SF, "labels").where("doc_id > 99")).count()
    assert some == awkward.count() and quality.classify(nothing, labels).count() == 0


def test_rejecting_keeps_columns_and_everything_without_labels(awkward, labels):
    kept = quality.keep_good(awkward, labels)
    assert kept.schema == awkward.schema and kept.count() == awkward.count()


def test_scores_do_not_depend_on_the_batch(spark):
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, marks)
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(d, model).collect()} for d in (docs, docs.where("doc_id < 50").repartition(7)))
    assert all(a[i] == pytest.approx(s, abs=1e-12) for i, s in b.items())


def test_toxicity_on_held_out_rows(spark, awkward, nothing, labels):
    found = toxicity.classify(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels"))
    rows = found.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out")
    r = rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("acc"),
                 F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["acc"] > 0.97 and r["false"] < 0.01
    assert {x["score"] for x in toxicity.classify(awkward, labels).collect()} == {0.5}
    assert toxicity.classify(nothing, labels).count() == 0


def test_automaton_equals_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    terms = ["idiot", "scum", "worthless", "disgusting", "lol"]
    automaton = toxicity.LexiconAutomaton([(t, 1.0) for t in terms])
    rng = np.random.default_rng(3)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(w) + 1))
                kind = rng.integers(0, 3)
                if kind == 0:
                    w.insert(at, "abcdimorst"[rng.integers(0, 10)])
                elif w and at < len(w):
                    w[at: at + 1] = [] if kind == 1 else ["abcdimorst"[rng.integers(0, 10)]]
            word = "".join(w)
            near = [edits(word, x) for x in terms if word[:1] == x[0] and edits(word, x) <= automaton.allowed(len(x))]
            weight, n = automaton.match(word)
            assert (weight > 0) == bool(near) and (not near or n == min(near))
    assert toxicity.LexiconAutomaton([("chlla*", 2.0)]).match("chllanu") == (2.0, 0)


def test_quotation_weighs_less_than_abuse():
    scorer = toxicity.Scorer(toxicity.LexiconAutomaton([("idiot", 2.0), ("scum", 2.0)]))
    abuse, quoted = scorer.features("you idiot scum")[0], scorer.features('he said "you idiot scum" then')[0]
    assert abuse[0] > quoted[0] and quoted[4] == 1.0 and scorer.features("fine text") == ([0.0] * 5, 0)


def brute_targets(sizes, share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target = share * sum(sizes.values()), {}
    live = list(order)
    while True:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > most * sizes[s]] if live else []
        if not over:
            return target | {s: left * weight[s] / total for s in live}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        live = [s for s in live if s not in over]


@pytest.mark.parametrize("which", ["awkward", "sf"])
def test_mixture_meets_its_targets(spark, awkward, which):
    docs = awkward if which == "awkward" else table(spark, SF, "documents")
    rows = mixing.mix(docs).collect()
    want = {}
    for r in docs.select("source", "text").collect():
        want[r["source"]] = want.get(r["source"], 0) + len((r["text"] or "").encode().split())
    target = brute_targets(want)
    assert len(rows) == docs.count()
    taken = {}
    for r in rows:
        assert r["source_size"] == want[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    if which == "sf":
        assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in taken)
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted(again) == sorted(rows)


def test_rounding_is_made_up_however_much_it_leaves(spark):
    """Sources with a few very long documents, with different ones and with equal ones, each beside its target."""
    short = [200 + i * 7919 % 201 for i in range(1500)]
    sizes = {"a": short + [150_000], "b": short + [30_000] * 10, "c": [300] * 1500, "d": short, None: short + [150_000]}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, weights=(4, 5, 3, 5, 6), share=1.1).collect()
    assert len(out) == len(rows) and all(0 <= r["copies"] <= 2 for r in out)
    for s, ns in sizes.items():
        mine = [r for r in out if r["source"] == s]
        assert 0.5 < mine[0]["target"] / sum(ns) < 1.9
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= min(ns) / 2


def test_tilted_rates_maximise_entropy(spark):
    """At the solution the odds of all documents of a source lie on one exponential of their size."""
    rows = [r for r in mixing.mix(table(spark, SF, "documents")).collect() if r["size"] and 1e-3 < r["rate"] < 2 - 1e-3]
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(np.log(r["rate"] / (2 - r["rate"])) / r["size"])
    assert by and all(np.ptp(x) < 1e-6 for x in by.values())


def test_mixed_documents_repeat_whole_rows(spark, awkward, nothing):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    n = sum(r["copies"] for r in mixing.mix(awkward).collect())
    assert out.count() == n and mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_neighbours_reach_recall_and_rank_exactly(spark):
    df = table(spark, SF, "embeddings")
    rows = ann_tree.search(df).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    hit, n = 0, 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        score = (x * data[q]).sum(1)
        assert all(abs(score[np.searchsorted(ids, r["vec_id"])] - r["score"]) < 1e-12 for r in mine)
        assert sorted(mine, key=lambda r: (-r["score"], r["vec_id"])) == mine
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hit, n = hit + len(set(best) & {r["vec_id"] for r in mine}), n + 20
    assert hit / n >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]),
                                                          (120, [float("inf"), 1.0]), (140, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann_tree.search(df, k=20).collect()
    assert {r["query_id"] for r in found} == {0, 20}
    data = {i: v for i, v in reversed(rows[:30])}
    for q in (0, 20):
        want = sorted(((-(data[q][0] * v[0] + data[q][1] * v[1]), i) for i, v in data.items() if i != q))[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    assert ann_tree.search(df.limit(0)).count() == 0
    assert ann_tree.search(df.where("vec_id in (0, 1, 2)")).count() == 2  # fewer candidates than k


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs, names = table(spark, SF, "documents"), [n for n, _ in p.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "pii", "source_mixing", "sentencepiece_encoding"]
    counts = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != names[-1]:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    kept = spark.read.parquet(f"{tmp_path}/{names[0]}")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert counts[0] > counts[1] and counts[3] == counts[4] and docs.where("not round_trip").count() == 0
