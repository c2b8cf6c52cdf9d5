"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import (
    ball_tree,
    bpe,
    cross_polytope,
    fingerprints,
    html_text,
    id_coder,
    lexical,
    line_dedup,
    lm,
    packing,
    quality,
    simhash,
    whitening,
)
from spendlens.llm.common import stored, table

#: The vocabulary that op3 and op6 encode with, and that op2 counts tokens of.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    scored = quality.with_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document, its tokens and an end mark, in packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), bpe.n_ids(F.col("text"), VOCABULARY) + 1)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's token ids, from files written and read back."""
    files = id_coder.write_ids(table(spark, sf_dir, "documents"), VOCABULARY, end_id=2)
    return id_coder.read_digests(files).withColumnRenamed("id", "doc_id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    rows = table(spark, sf_dir, "embeddings")
    return cross_polytope.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language-model score of every document, from counts over all documents."""
    return lm.backoff_scores(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and of their decoded text."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines and a digest of what stays of every document."""
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of highest inner product for every fiftieth."""
    rows = table(spark, sf_dir, "embeddings")
    return ball_tree.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four leading whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4).withColumnRenamed("id", "vec_id")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; for every fiftieth, how many others are within three bits."""
    prints = stored(fingerprints.fingerprints(table(spark, sf_dir, "documents")), "prints")
    counted = fingerprints.with_near_counts(prints, F.col("id") % 50 == 0, radius=3)

    def digits(name: str):
        return F.lower(F.lpad(F.hex(name), 16, "0"))

    return counted.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digits("fp").alias("fingerprint"),
        digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    ranked = lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_packing,
        op3_token_files,
        op4_nearest,
        op5_backoff_scores,
        op6_bpe,
        op7_line_dedup,
        op8_main_text,
        op9_top_k,
        op10_simhash,
        op11_whitening,
        op12_fingerprints,
        op13_lexical,
    )
}

ORACLE = {
    "op13_lexical": r"""
        WITH words AS (
            SELECT doc_id, r, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)
        ),
        sizes AS (SELECT doc_id, r, count(*) AS n FROM words GROUP BY ALL),
        totals AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS terms FROM sizes),
        counts AS (SELECT r, term, count(*) AS tf FROM words GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM totals) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts GROUP BY term
        ),
        lengths AS (SELECT doc_id, r, 100 - 90 + (90 * n * (SELECT docs FROM totals)) // (SELECT terms FROM totals) AS m FROM sizes),
        asked AS (
            SELECT DISTINCT item_id, item, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark)
        ),
        scored AS (
            SELECT item_id, item, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r) GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score
        FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 10
    """,
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, u.pos, u.line, trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
                 LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) u
        ),
        shared AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM lines LEFT JOIN shared USING (key)
        GROUP BY doc_id
    """,
    "op5_backoff_scores": r"""
        WITH words AS (
            SELECT doc_id, pos, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), chr(10)) AS before
            FROM (
                SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
                FROM (
                    SELECT doc_id, regexp_extract_all(
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
                    ) AS ws
                    FROM documents
                )
            )
        ),
        bigrams AS (SELECT before, w, count(*) AS n2 FROM words GROUP BY before, w HAVING count(*) >= 2),
        unigrams AS (
            SELECT w, count(*) AS n1 FROM words GROUP BY w
            UNION ALL SELECT chr(10), count(*) FROM words WHERE before = chr(10)
        ),
        priced AS (
            SELECT doc_id, CASE
                WHEN n2 IS NOT NULL THEN round(ln(n2) * 1000000) - round(ln(ub.n1) * 1000000)
                ELSE round(ln(0.4) * 1000000) + round(ln(uw.n1) * 1000000)
                     - round(ln((SELECT count(*) FROM words)) * 1000000)
            END AS micro
            FROM words LEFT JOIN bigrams USING (before, w)
            JOIN unigrams ub ON ub.w = before JOIN unigrams uw ON uw.w = words.w
        )
        SELECT doc_id, count(micro) AS n_words, CAST(coalesce(sum(micro), 0) AS BIGINT) AS log_micro,
               sum(micro) / count(micro) / 1000000 AS score
        FROM documents LEFT JOIN priced USING (doc_id) GROUP BY doc_id
    """,
    "op9_top_k": r"""
        WITH vectors AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER best AS INT) AS rank, vec_id, score
        FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 5
    """,
}
