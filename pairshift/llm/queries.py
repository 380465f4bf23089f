"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairshift.llm.best_fit_packing import best_fit_packing
from pairshift.llm.collocations import collocations
from pairshift.llm.common import table
from pairshift.llm.conversation_trie import conversation_trie
from pairshift.llm.exact_dedup import exact_dedup
from pairshift.llm.host_quality import host_quality
from pairshift.llm.jaccard_join import jaccard_components
from pairshift.llm.language_ppm import predicted_languages
from pairshift.llm.license_scan import license_scan
from pairshift.llm.pii import find_pii
from pairshift.llm.quality_ftrl import quality_scores
from pairshift.llm.sentencepiece_fst import encoded
from pairshift.llm.shared_passages import shared_anchors
from pairshift.llm.suffix_dedup import suffix_dedup
from pairshift.llm.url_filter import url_verdicts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup(docs, shared=shared_anchors(docs)).withColumnRenamed("id", "doc_id")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


#: The rules of the task: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS r(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("last_conv_id", "last_turn")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece_fst": op2_sentencepiece_fst,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_host_quality": op4_host_quality,
    "op5_license_scan": op5_license_scan,
    "op6_quality_ftrl": op6_quality_ftrl,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_language_ppm": op12_language_ppm,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)""",
    "op4_host_quality": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
        c AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
        h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
        t0 AS (SELECT count(*) AS hosts, sum(n) AS n, sum(f) / sum(n) AS raw, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS m, sum(f * f / n) AS ff FROM h),
        t1 AS (SELECT m, greatest(ff / n - raw * raw - m * (1 - m) * hosts / n, 0) AS v FROM t0),
        prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS s FROM t1),
        post AS (SELECT source, m * s + f AS a, (1 - m) * s + n - f AS z FROM h, prior),
        bad AS (SELECT source FROM post WHERE a / (a + z) - 1.645 * sqrt(a / (a + z) * (z / (a + z)) / (a + z + 1)) > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b""",
    "op10_url_filter": r"""
        WITH u AS (SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fit AS (SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS won FROM u JOIN r
                ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY page_id)
        SELECT page_id, host, path, won.rule AS rule, coalesce(won.v, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
                     lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k)) GROUP BY ALL),
        t AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 100),
        i AS (SELECT lang, unnest(list_transform(range(1, k - m + 2), lambda s: array_to_string(ws[s:s + m - 1], ' '))) AS phrase, a
              FROM c, range(2, 5) AS x(m) WHERE m < k),
        keep AS (SELECT * FROM c ANTI JOIN (SELECT DISTINCT c.lang, c.phrase FROM c JOIN i USING (lang, phrase) WHERE 100 * i.a >= 100 * c.a) USING (lang, phrase)),
        cut AS (SELECT keep.lang, keep.phrase, a, x.j, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS score
                FROM keep JOIN range(1, 5) AS x(j) ON x.j < k JOIN t USING (lang)
                JOIN g AS l ON l.lang = keep.lang AND l.phrase = array_to_string(ws[1:x.j], ' ')
                JOIN g AS r ON r.lang = keep.lang AND r.phrase = array_to_string(ws[x.j + 1:], ' ')),
        low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM top WHERE rank <= 2000""",
    "op13_conversation_trie": r"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS e
                   FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT c, list(e ORDER BY i) AS es FROM t GROUP BY c),
        h AS (SELECT c, es, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                lambda a, d: list_reduce(list_prepend(xor(a, d), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4 AS h FROM s),
        f AS (SELECT h.c, list_concat(coalesce(b.es, [])[:h.h], h.es[h.h + 1:]) AS es FROM h LEFT JOIN s AS b ON b.c = h.base),
        m AS (SELECT c, len(es) AS n, d AS depth, es[:d] AS p, CASE WHEN d > 0 THEN es[:d - 1] END AS up, es[d] AS last FROM (SELECT *, unnest(range(0, len(es) + 1)) AS d FROM f)),
        g AS (SELECT p, any_value(depth) AS depth, any_value(up) AS up, any_value(last) AS last, min(c) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '')) AS ends_sha256 FROM m GROUP BY p),
        k AS (SELECT up AS p, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
        q AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(last.t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own
              FROM g LEFT JOIN k USING (p)),
        a AS (SELECT q.p, o.own, o.n_children = 0 AS leaf FROM q AS o JOIN m ON m.c = o.conv_id AND m.depth <= o.depth JOIN q ON q.p = m.p),
        b AS (SELECT p, sum(leaf::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM a GROUP BY p)
        SELECT q.conv_id, q.depth, u.conv_id AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, q.ends_sha256
        FROM q JOIN b USING (p) LEFT JOIN q AS u ON q.depth > 0 AND u.p = q.up""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
        SELECT doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
