"""The registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.bpe import encode_digests
from cuewright.llm.collocations import collocations
from cuewright.llm.common import load
from cuewright.llm.divergence import source_divergence
from cuewright.llm.exact_dedup import exact_dedup
from cuewright.llm.fingerprint import fingerprints
from cuewright.llm.html_extract import extract_pages
from cuewright.llm.jaccard import jaccard_components
from cuewright.llm.lattice import lattice_scores
from cuewright.llm.license_scan import license_scan
from cuewright.llm.line_dedup import line_dedup
from cuewright.llm.packing import pack
from cuewright.llm.token_counts import token_counts
from cuewright.llm.toxicity import toxicity

MIN_SITES = 10


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op2_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(load(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_fingerprints,
        op2_extract_pages,
        op3_byte_bpe,
        op4_jaccard_join,
        op5_license_scan,
        op6_line_dedup,
        op7_lattice_scores,
        op8_pack,
        op9_exact_dedup,
        op10_toxicity,
        op11_collocations,
        op12_token_counts,
        op13_source_divergence,
    ]
    return {f.__name__: f for f in found}


SQL = {
    "op6_line_dedup": rf"""
        WITH parts AS (
            SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
        ), lines AS (
            SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
        ), keyed AS (
            SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM lines
        ), spread AS (
            SELECT k, min(doc_id) AS first_id FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}
        ), marked AS (
            SELECT keyed.*, coalesce(keyed.doc_id <> spread.first_id, false) AS gone FROM keyed LEFT JOIN spread USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
        FROM marked GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op9_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM normal WINDOW same AS (PARTITION BY text_sha256)""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (
                SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
        ), starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words WHERE len(ws) > 0
        ), grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM starts, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(ws)
        ), f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL
        ), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (SELECT lang, k, g, a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND a >= 30
        ), cuts AS (SELECT lang, k, g, a, ws, unnest(range(1, k)) AS cut FROM c
        ), scored AS (
            SELECT cuts.lang, cuts.g, cuts.k, cuts.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score FROM cuts
            JOIN f x ON x.lang = cuts.lang AND x.k = cut AND x.g = array_to_string(ws[1:cut], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - cut AND y.g = array_to_string(ws[cut + 1:], ' ')
        ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
        ), kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 80 * b.a AND contains(' ' || c.g || ' ', ' ' || b.g || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) <= 2000""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), places AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (SELECT lang, term FROM places GROUP BY ALL HAVING count(DISTINCT id) >= 3
        ), c AS (SELECT lang, source, term, count(*) AS n FROM places SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
        ), grid AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + v.v)::HUGEINT AS p
            FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)
        ), pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
            FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        ), whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM c GROUP BY lang, term
        ), terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM grid JOIN whole USING (lang, term) WHERE cnt > 0 AND p > q
        ), r AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
        QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
