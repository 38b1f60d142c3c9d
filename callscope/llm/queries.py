"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import (
    bpe,
    decontaminate,
    html_text,
    language,
    pieces,
    quality_classifier,
    quality_rules,
    repair,
    search,
    secret_scan,
    simhash,
    suffix_dedup,
    token_shards,
)
from callscope.llm.common import table


def vocabulary() -> str:
    """Where the public vocabulary file lies; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """Where the public piece model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_file() -> tuple[str, str]:
    """Path and splitting pattern of the public rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), vocabulary())


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash(table(spark, folder, "documents"))


def op8_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return token_shards.materialise(table(spark, folder, "documents"), *rank_file())


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), piece_model())


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, folder, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Windows of 13 words joined by a space are compared as text; words hold no space.
OP10 = """
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item_words WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT g.r, g.i, g.size, x.item_id FROM grams g JOIN windows x USING (size, gram)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS j FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


#: Every document against every item by plain counting.
OP12 = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
used AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n, words FROM docs WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM used),
tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM used) GROUP BY r, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, corpus),
items AS (
  SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS words
  FROM benchmark),
asked AS (
  SELECT item, item_id, unnest(words) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, words FROM items WHERE len(words) > 0)),
scores AS (
  SELECT item, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN used USING (r), corpus
  GROUP BY item, item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN used USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_decontamination": OP10, "op12_search": OP12}
