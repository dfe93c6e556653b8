"""Queries ``(spark, sf_dir) -> DataFrame`` of the operators in this subpackage, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import archives, bytebpe, chat, divergence, jaccard, langid, maxent, merkle, mixing, quality, suffixes, tokencount, vectors
from quillspark.llm.shared import documents
from quillspark.session import ship


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_preferences(chat.swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return out.select("conv_id", "paired", "n_common", "prompt", "chosen_text", "rejected_text", flat("chosen_spans").alias("chosen_spans"), flat("rejected_spans").alias("rejected_spans"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, model = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    return tokencount.count_tokens(docs, model, tokencount.seeded_cache(docs, model))


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir)).select("doc_id", "source", "copy_no", "n_copies", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(documents(spark, sf_dir), merkle.without_line_feeds())


def op12_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [op1_arc_to_warc, op2_language_centroids, op3_preference_formatting, op4_ngram_jaccard, op5_suffix_dedup, op6_byte_bpe, op7_token_counts, op8_robust_quality, op9_kmeans_tree, op10_poisson_mixing, op11_merkle_manifest, op12_maxent_scores, op13_source_divergence]
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in plain}


def _part(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


#: CRC-32 of the decimal ``doc_id``, bit by bit: a code of -1 is a shift, any other one a byte.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": """
            WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT page_id, payload_bytes, p.payload_digest,
                CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
            FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""",
        "op3_preference_formatting": """
            WITH t AS (
                SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
                    count(*) OVER (PARTITION BY conv_id) AS n
                FROM conversations WHERE conv_id IS NOT NULL),
            l AS (SELECT conv_id, max(k) AS last_k FROM t WHERE role = 'assistant' GROUP BY 1),
            r AS (SELECT t.conv_id, t.text AS reply, last_k FROM t JOIN l ON t.conv_id = l.conv_id AND t.k = l.last_k),
            c AS (
                SELECT t.*, a.last_k, a.reply, b.reply AS other, a.reply IS NOT NULL AND b.reply IS NOT NULL AS paired
                FROM t LEFT JOIN r a ON t.conv_id = a.conv_id LEFT JOIN r b ON b.conv_id = xor(t.conv_id, 1)),
            s AS (
                SELECT *, CASE WHEN NOT paired THEN 0 WHEN reply = other THEN n ELSE last_k - 1 END AS n_common,
                    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS yes,
                    CASE WHEN paired THEN '<|' || role || '|>' || chr(10) || CASE WHEN k = last_k THEN other ELSE text END || '<|end|>' || chr(10) END AS no
                FROM c),
            w AS (
                SELECT *, coalesce(sum(CASE WHEN k > n_common THEN length(yes) END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS yes_at,
                    coalesce(sum(CASE WHEN k > n_common THEN length(no) END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS no_at
                FROM s)
            SELECT conv_id, bool_and(paired) AS paired, CAST(max(n_common) AS BIGINT) AS n_common,
                coalesce(string_agg(yes, '' ORDER BY k) FILTER (k <= n_common), '') AS prompt,
                coalesce(string_agg(yes, '' ORDER BY k) FILTER (k > n_common), '') AS chosen_text,
                coalesce(string_agg(no, '' ORDER BY k) FILTER (k > n_common), '') AS rejected_text,
                coalesce(string_agg(CAST(CAST(yes_at AS BIGINT) AS VARCHAR) || '+' || CAST(length(yes) - length(role) - 6 AS VARCHAR), ',' ORDER BY k) FILTER (k > n_common AND role = 'assistant'), '') AS chosen_spans,
                coalesce(string_agg(CAST(CAST(no_at AS BIGINT) AS VARCHAR) || '+' || CAST(length(no) - length(role) - 6 AS VARCHAR), ',' ORDER BY k) FILTER (k > n_common AND role = 'assistant' AND no IS NOT NULL), '') AS rejected_spans
            FROM w GROUP BY conv_id""",
        "op4_ngram_jaccard": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
            g AS (
                SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram
                FROM w, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS u(i) WHERE len(words) > 0),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
            o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
        "op10_poisson_mixing": """
            WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
            r AS (SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM c),
            q AS (SELECT source, greatest(1, CAST(ceil(rate / 64) AS BIGINT)) AS pieces, rate / greatest(1, CAST(ceil(rate / 64) AS BIGINT)) AS rate FROM r),
            k AS (SELECT source, pieces, rate, k FROM q, unnest(generate_series(0, 200)) AS u(k)),
            f AS (SELECT source, pieces, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
            s AS (SELECT source, pieces, list(cdf ORDER BY k) AS cdf FROM f GROUP BY 1, 2),
            j AS (
                SELECT doc_id, d.source, text, cdf, (CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
                FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source, unnest(generate_series(1, pieces)) AS v(j)),
            m AS (SELECT doc_id, source, md5(coalesce(any_value(text), '')) AS text_md5, CAST(sum(len(list_filter(cdf, lambda z: z < u))) AS BIGINT) AS n_copies FROM j GROUP BY 1, 2)
            SELECT doc_id, source, CAST(i AS BIGINT) AS copy_no, n_copies, md5('order20:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || CAST(i AS VARCHAR)) AS shuffle_key, text_md5
            FROM m, unnest(generate_series(1, n_copies)) AS w(i)""",
            "op11_merkle_manifest": f"""
            WITH RECURSIVE d AS (
                SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS got FROM documents),
            r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, coalesce('=' || source, '') AS t FROM d),
            v AS (
                SELECT t, 0 AS level, idx, n, leaf AS h FROM r
                UNION ALL SELECT t, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM v WHERE n > 1 GROUP BY t, level, n, idx // 3),
            w AS (
                SELECT 0 AS level, row_number() OVER (ORDER BY t) - 1 AS idx, count(*) OVER () AS n, h FROM v WHERE n = 1
                UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM w WHERE n > 1 GROUP BY level, n, idx // 3),
            s AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS place FROM v WHERE n = 1),
            a AS (
                SELECT x.t, x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lft, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS rgt
                FROM v x JOIN v y ON x.t = y.t AND x.level = y.level AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2, 3),
            b AS (
                SELECT x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lft, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS rgt
                FROM w x JOIN w y ON x.level = y.level AND x.idx // 3 = y.idx // 3 WHERE x.n > 1 GROUP BY 1, 2),
            p AS (
                SELECT r.t, r.idx, a.level, lft, rgt FROM r JOIN a ON a.t = r.t AND a.idx = r.idx // CAST(pow(3, a.level) AS BIGINT)
                UNION ALL SELECT r.t, r.idx, 100 + b.level, lft, rgt FROM r JOIN s ON s.t = r.t JOIN b ON b.idx = s.place // CAST(pow(3, b.level) AS BIGINT)),
            q AS (SELECT *, row_number() OVER (PARTITION BY t, idx ORDER BY level) AS k, count(*) OVER (PARTITION BY t, idx) AS steps FROM p),
            f AS (SELECT t, idx, 0 AS k, got AS h FROM r UNION ALL SELECT f.t, f.idx, q.k, sha256(lft || h || rgt) FROM f JOIN q ON q.t = f.t AND q.idx = f.idx AND q.k = f.k + 1),
            g AS (SELECT t, idx, arg_max(h, k) AS folded_root FROM f GROUP BY 1, 2),
            z AS (SELECT t, idx, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof_sha256 FROM p GROUP BY 1, 2)
            SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
            FROM r JOIN s ON s.t = r.t JOIN g ON g.t = r.t AND g.idx = r.idx LEFT JOIN z ON z.t = r.t AND z.idx = r.idx, (SELECT h AS root FROM w WHERE n = 1)""",
            "op13_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
            t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
            v AS (SELECT lang, count(*) :: HUGEINT AS v, sum(n) AS total FROM k GROUP BY 1),
            c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
            s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
            g AS (SELECT DISTINCT lang, source FROM d),
            p AS (
                SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 :: HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v) AS BIGINT) AS p,
                    CAST(1 + 1000000000 :: HUGEINT * (k.n + 2) // (v.total + 2 * v) AS BIGINT) AS q
                FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
            e AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
            QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10""",
    }
