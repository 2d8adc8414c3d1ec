"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import importable_on_workers, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cargolens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.ann_tree import search

    return search(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.phrases import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.pii import find_personal

    return find_personal(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.simhash import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    first = ["doc_id", "size", "source_size", "target", "taken"]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cargolens.llm.tokenizer_alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cargolens.llm.byte_bpe import decode_documents, encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    numbers = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cargolens.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    fns = [op1_quality, op2_token_counts, op3_ann_tree, op4_minhash, op5_phrases, op6_sentencepiece, op7_pii, op8_toxicity, op9_simhash, op10_mixing,
           op11_alignment, op12_byte_bpe, op13_whitening]
    out: dict[str, Query] = {}
    for fn in fns:
        def run(spark: SparkSession, sf_dir: str, fn: Query = fn) -> DataFrame:
            importable_on_workers(spark)
            return fn(spark, sf_dir)
        out[fn.__name__] = run
    return out


_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws
  FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5
        THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh)
        WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
      WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_OP5_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS seq FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT seq FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM win JOIN again USING (seq)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.j) AS text, count(*) AS n
         FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": _OP4_SQL, "op5_phrases": _OP5_SQL}
