"""The operators applied to whole tables, under the names the entry point registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.llm import (
    bit_sliced_search,
    embedding_whitening,
    hard_negatives,
    html_extraction,
    language_id,
    license_scan,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    sentencepiece_sampling,
    simhash,
    warc,
)
from receivables.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return quality_classifier.score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read_back(table(spark, sf_dir, "pages"))


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.sample_segmentations(table(spark, sf_dir, "documents"))


def op7_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_search.search_top_k(table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    return language_id.predict_language(docs, trees).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(
        table(spark, sf_dir, "embeddings").withColumn("label", moved)
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_packing": op1_packing,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_sentencepiece_sampling": op6_sentencepiece_sampling,
        "op7_bit_sliced_search": op7_bit_sliced_search,
        "op8_html_extraction": op8_html_extraction,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
        "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


# DuckDB has no base32: five bits of the digest's hexadecimal digits at a time.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex_digest, 1 + CAST(5 * (k // 4) AS INTEGER), 5))::INTEGER
        >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1)), '')"""


# The rules' conditions over the counts, written out a second time.
_RULES = [
    ("bad", "100 * n_symbols > 10 * n_words"),
    ("bad", "100 * n_dup_lines > 30 * n_lines"),
    ("bad", "100 * n_repeat_words > 40 * n_words"),
    ("bad", "100 * n_capitals > 40 * n_letters"),
    ("bad", "10 * word_chars < 25 * n_words OR 10 * word_chars > 150 * n_words"),
    ("bad", "100 * n_letters < 65 * word_chars"),
    ("bad", "100 * n_bare_words > 15 * n_words"),
    ("good", "10 * word_chars >= 35 * n_words AND 10 * word_chars <= 90 * n_words"),
    ("good", "100 * n_letters >= 85 * word_chars"),
    ("good", "n_words >= 100"),
]


def _rules_sql() -> str:
    """The counts, the rounds of expectation-maximisation as a recursive query, the verdicts."""
    r = quality_rules
    space = r"[\x20\x09-\x0D]"
    evidence = " + ".join(
        f"CASE WHEN votes[{i}] THEN ln(on_good[{i}] / on_bad[{i}]) "
        f"ELSE ln((1 - on_good[{i}]) / (1 - on_bad[{i}])) END"
        for i in range(1, len(_RULES) + 1)
    )
    posterior = f"1 / (1 + exp(-(ln(share / (1 - share)) + {evidence})))"

    def rates(weight: str, total: str, place: int) -> str:
        each = []
        for i, (kind, _) in enumerate(_RULES, 1):
            guess, (low, high) = r.GUESS[kind][place], r.BOUNDS[kind][place]
            seen = f"sum(CASE WHEN votes[{i}] THEN {weight} ELSE 0 END)"
            each.append(
                f"least(greatest(({seen} + {r.WEIGHT * guess}) / ({total} + {r.WEIGHT}), {low}), {high})"
            )
        return "[" + ", ".join(each) + "]"

    first = [[r.GUESS[kind][place] for kind, _ in _RULES] for place in (0, 1)]
    low, high = r.SHARE_BOUNDS
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, i, words[i : i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
),
covered AS (
  SELECT doc_id, sum(least(3, coalesce(next - i, 3))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM repeated)
  GROUP BY doc_id
),
counted AS (
  SELECT split.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(length(list_aggregate(words, 'string_agg', '')), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters,
         length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) AS n_bare_words
  FROM split LEFT JOIN covered ON covered.doc_id = split.doc_id
),
voted AS (SELECT *, [{", ".join(when for _, when in _RULES)}] AS votes FROM counted),
seen AS (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes),
rounds AS (
  SELECT 0 AS round, CAST({r.SHARE} AS DOUBLE) AS share,
         CAST({first[0]} AS DOUBLE[]) AS on_good, CAST({first[1]} AS DOUBLE[]) AS on_bad
  UNION ALL
  SELECT round + 1,
         least(greatest((sum(good) + {r.WEIGHT * r.SHARE}) / (sum(n) + {r.WEIGHT}), {low}), {high}),
         {rates("good", "sum(good)", 0)},
         {rates("n - good", "sum(n - good)", 1)}
  FROM (SELECT round, votes, n, n * ({posterior}) AS good FROM rounds, seen WHERE round < {r.ROUNDS})
  GROUP BY round
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND ({posterior}) >= {r.THRESHOLD} AS kept
FROM voted, (SELECT * FROM rounds WHERE round = {r.ROUNDS})"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": _rules_sql(),
        "op5_warc": f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex_digest FROM pages
),
first AS (SELECT payload AS p, min(page_id) AS first_id FROM hashed GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM hashed JOIN first ON payload = p""",
        "op7_bit_sliced_search": """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
        "op11_ngram_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda w: w <> '') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
           lambda i: array_to_string(words[i : i + 2], ' '))) END AS items
  FROM split
),
listed AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
links AS (
  SELECT a.doc_id AS one, b.doc_id AS other
  FROM listed a JOIN listed b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id, doc_id AS reached FROM sets
  UNION
  SELECT reach.doc_id, other FROM reach JOIN links ON one = reached
)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, least AS component_id
FROM sets JOIN (SELECT doc_id, min(reached) AS least FROM reach GROUP BY doc_id) USING (doc_id)""",
        "op12_hard_negatives": """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE r <= 5""",
    }
