"""The queries of this folder's operators, for the entry file: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, common, fertility, jaccard, maxent, media, mixing, pii, repeats, secrets, toxicity


def op1_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.documents(spark, sf_dir))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.report(common.documents(spark, sf_dir))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fertility.verdicts(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "n_tokens", "n_byte_tokens", "m_chars", "m_entropy")


def op3_media_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media.described(media.packed(common.documents(spark, sf_dir)))
    rows = media.contents(index, keep=("n_bytes", "width", "height", "bit_depth"))
    filled = ["width", "height", "bit_depth"]
    return rows.select(*(c for c in rows.columns if c not in filled), *filled)


def op4_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(common.documents(spark, sf_dir))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(common.documents(spark, sf_dir))


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(common.documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(common.documents(spark, sf_dir), with_ids=False)


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii_boosted": op1_pii_boosted, "op2_fertility": op2_fertility, "op3_media_tar": op3_media_tar, "op4_token_groups": op4_token_groups, "op5_entropy_mix": op5_entropy_mix, "op6_toxicity_gru": op6_toxicity_gru, "op7_suffix_repeats": op7_suffix_repeats, "op8_byte_bpe": op8_byte_bpe, "op9_secret_ownership": op9_secret_ownership, "op10_maxent_lm": op10_maxent_lm}


#: All pairs that share a shingle, compared; components by the closure of their links. The other operators have no SQL: vocabularies, models, images and
#: spans with their places are beyond it, and strings of 200 bytes at every place too slow.
OP4 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2)::BIGINT)) AS i FROM w WHERE len(ws) > 0), g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM p), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL), l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, to_) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.to_ = e.a), m AS (SELECT id, min(to_) AS first FROM r GROUP BY id), d AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.first, w.doc_id) AS component_id, coalesce(d.k, 0) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id LEFT JOIN d ON d.a = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_token_groups": OP4}
