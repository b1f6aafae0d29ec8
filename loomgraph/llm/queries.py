"""The registered queries of this subpackage, with production parameters, and their SQL.

Each applies its operator to its whole table and keeps the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, importance, lexical_search, license_scan, ngram_join, pii, quality, substring_dedup, suffix_dedup, token_counts, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, one_in=20)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20, scale=64.0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5, modulus=5, held=0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, modulus=4, held=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(_table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=3, buckets=10_000, percent=5, least_words=20, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contracts in DuckDB's SQL, where it can express them on whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOW)} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN concat('short ', array_to_string(w, ' ')) ELSE array_to_string(w[s : s + 4], ' ') END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
        SELECT reach.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, (SELECT count(*) FROM e WHERE e.a = reach.a) AS n_links FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a""",
    "op5_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
        t AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        x AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
        m AS (SELECT doc_id, s, k, item_id FROM x JOIN t USING (k, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
        o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
        x AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
        f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM x JOIN f USING (g) WHERE first < doc_id) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)""",
    "op11_ranked_lexical_search": f"""
        WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
        tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
        df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
        q AS (SELECT DISTINCT item_id, unnest({_PLAIN}) AS t FROM benchmark),
        r AS (SELECT item_id, doc_id, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN df USING (t) JOIN tf USING (t), s GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""",
    "op13_importance_resampling": f"""
        WITH RECURSIVE x AS (SELECT 's' AS side, doc_id, {_PLAIN} AS w FROM documents UNION ALL SELECT 't', NULL, {_PLAIN} FROM benchmark),
        f AS (SELECT side, doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))), list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) AS g FROM x),
        poly(i, step, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE step = 8),
        u AS (SELECT g, hex(encode(g)) AS h, strlen(g) AS n FROM (SELECT DISTINCT g FROM f)),
        crc(g, h, n, p, v) AS (SELECT g, h, n, 0, 4294967295 FROM u UNION ALL SELECT g, h, n, p + 1, xor(v >> 8, t[1 + (xor(v, CAST(concat('0x', substr(h, 2 * p + 1, 2)) AS BIGINT)) & 255)]) FROM crc, tab WHERE p < n),
        bucket AS (SELECT g, xor(v, 4294967295) % 10000 AS b FROM crc WHERE p = n),
        c AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN bucket USING (g) GROUP BY b),
        total AS (SELECT CAST(sum(s) AS BIGINT) AS s_all, CAST(sum(t) AS BIGINT) AS t_all FROM c),
        gain AS (SELECT b, CAST(floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, total),
        weighed AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN bucket USING (g) JOIN gain USING (b) WHERE side = 's' GROUP BY doc_id),
        scored AS (SELECT x.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', x.doc_id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM x LEFT JOIN weighed USING (doc_id) WHERE side = 's'),
        drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20 QUALIFY rank <= floor(5 * count(*) OVER () / 100))
        SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)""",
}
