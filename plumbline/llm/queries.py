"""Queries of the training-data problems, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.docpairs import code_pairs, informative_ids, lexed_pairs
from plumbline.llm.mixing import mix_sources
from plumbline.llm.paragraphs import near_paragraphs
from plumbline.llm.provenance import THIRD_PARTY_DIRS, not_hand_written, third_party_paths, vendored_containment
from plumbline.llm.spans import shared_portion, shared_spans
from plumbline.llm.syntax import invalid_files, invalid_rates
from plumbline.llm.tokenizer import encode_corpus, token_sizes
from plumbline.llm.topn import top_n_per_group
from plumbline.session import stage
from plumbline.sources.tables import load


def p1_found(spark, d):
    return not_hand_written(load(spark, d, "files"), load(spark, d, "documents")).select("file_id")


def p1_reasons(spark, d):
    return not_hand_written(load(spark, d, "files"), load(spark, d, "documents"))


def p1_containment(spark, d):
    """How much of each file lies in third-party directories of other repositories, whatever its header says."""
    return vendored_containment(third_party_paths(load(spark, d, "files")), load(spark, d, "documents")).withColumn("contained", F.round("contained", 9))


def p2_found(spark, d):
    return top_n_per_group(load(spark, d, "symbols"), "file_id", "id", "rank", 3).withColumnRenamed("id", "symbol_id")


def p3_found(spark, d):
    return invalid_files(load(spark, d, "documents"))


def p3_rates(spark, d):
    return invalid_rates(load(spark, d, "files"), load(spark, d, "documents"))


def p4_found(spark, d):
    return informative_ids(load(spark, d, "symbols"))


def p4_pairs(spark, d):
    return code_pairs(load(spark, d, "symbols"), load(spark, d, "documents"))


def p4_lexed(spark, d):
    return lexed_pairs(load(spark, d, "documents"))


def p6_ids(spark, d):
    return encode_corpus(load(spark, d, "documents"), ["doc_id"])


def _mixed(spark, d):
    sized = stage(token_sizes(load(spark, d, "documents").where("source IS NOT NULL"), ["doc_id", "source"]), "sizes")
    return mix_sources(sized, load(spark, d, "mix_targets"))


def p7_mix(spark, d):
    return _mixed(spark, d)[0]


def p7_shares(spark, d):
    return _mixed(spark, d)[1]


def p8_found(spark, d):
    return shared_spans(load(spark, d, "documents"))


def p8_portion(spark, d):
    docs = load(spark, d, "documents")
    return shared_portion(docs, shared_spans(docs))


def p8_paragraphs(spark, d):
    return near_paragraphs(load(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_containment": p1_containment,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_lexed": p4_lexed,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_portion": p8_portion,
    "p8_paragraphs": p8_paragraphs,
}

#: Every window of 200 code points of every text, by brute force.
_SPANS = """
        WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
            w AS (SELECT doc_id, b, md5_number(substr(text, b + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, n - 199)) AS b FROM d)),
            s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
            x AS (SELECT doc_id, b, CASE WHEN b > lag(b) OVER (PARTITION BY doc_id ORDER BY b) + 200 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN s USING (h)),
            r AS (SELECT doc_id, b, sum(new) OVER (PARTITION BY doc_id ORDER BY b) AS k FROM x),
            spans AS (SELECT doc_id, CAST(min(b) AS INT) AS span_start, CAST(max(b) + 200 AS INT) AS span_end FROM r GROUP BY doc_id, k)"""

ORACLES = {
    "p8_found": f"{_SPANS} SELECT * FROM spans",
    "p8_portion": f"""{_SPANS}
        SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars,
            CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE coalesce(c, 0) / length(text) END AS shared
        FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS c FROM spans GROUP BY doc_id) USING (doc_id)""",
    "p1_containment": f"""
        WITH f AS (SELECT id AS file_id, split_part(path, '/', 1) AS repo, coalesce(regexp_matches(lower(path), '{THIRD_PARTY_DIRS}'), false) AS marked
                FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, sha256 DESC) AS k FROM files) WHERE k = 1),
            t AS (SELECT DISTINCT file_id, line FROM (SELECT file_id, trim(unnest(string_split_regex(text, '[\r\n]')), chr(32) || chr(9) || chr(12) || chr(11) || chr(65279)) AS line
                FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL) WHERE length(line) >= 16),
            l AS (SELECT file_id, line, repo, marked FROM t JOIN f USING (file_id)),
            x AS (SELECT line, min(repo) AS r0, max(repo) AS r1 FROM l WHERE marked GROUP BY line)
        SELECT file_id, count(*) AS lines, round(avg(CASE WHEN r0 <> repo OR r1 <> repo THEN 1.0 ELSE 0.0 END), 9) AS contained FROM l LEFT JOIN x USING (line) GROUP BY file_id""",
    "p2_found": """
        SELECT file_id, id AS symbol_id FROM (
            SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY
                CASE WHEN rank IS NULL OR isnan(rank) THEN 1 ELSE 0 END,
                CASE WHEN isnan(rank) THEN NULL ELSE rank END DESC NULLS LAST, id) AS k
            FROM (SELECT DISTINCT file_id, id, rank FROM symbols))
        WHERE k <= 3""",
}
