"""Thin queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hmm_scoring, mixing, near_dedup, quality_classifier, quality_rules, ranked_search, secrets, simhash, suffix_dedup, token_shards, url_filters


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), secrets.train(secrets.builtin_samples(spark)))


def op2_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_re_pair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_ppl", "lower", "upper")


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.score(read(spark, sf_dir, "documents"))


def op9_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * i >= 80 * (n - i)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN least_of ON s.doc_id = least_of.x
"""


def op10_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op11_pivot_distance_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(read(spark, sf_dir, "documents"), k=4, most=4, seed=42)


def op12_hierarchical_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), most=20)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(ts) AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT item_id, d.doc_id, p.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM
  (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE score > 0)
WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_markov_secrets": op1_markov_secrets,
        "op2_greedy_string_tiling": op2_greedy_string_tiling,
        "op3_re_pair_shards": op3_re_pair_shards,
        "op4_quality_rules": op4_quality_rules,
        "op5_co_training": op5_co_training,
        "op6_entropy_balancing": op6_entropy_balancing,
        "op7_suffix_arrays": op7_suffix_arrays,
        "op8_hidden_markov": op8_hidden_markov,
        "op9_min_max_hashing": op9_min_max_hashing,
        "op10_association_rules": op10_association_rules,
        "op11_pivot_distance_tables": op11_pivot_distance_tables,
        "op12_hierarchical_max_tree": op12_hierarchical_max_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_min_max_hashing": OP9_SQL, "op12_hierarchical_max_tree": OP12_SQL}
