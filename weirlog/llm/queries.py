"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (
    bpe,
    chat,
    exact_dedup,
    filter_audit,
    language,
    lexical_search,
    licenses,
    line_dedup,
    mixing,
    near_vectors,
    ngram_join,
    secrets,
    token_counts,
)
from .common import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return chat.format_turns(conversations, chat.learn(conversations))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_groups(table(spark, folder, "embeddings"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ALL: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_secret_scan,
        op3_language_id,
        op4_chat_format,
        op5_byte_bpe,
        op6_ngram_join,
        op7_token_counts,
        op8_exact_dedup,
        op9_near_vectors,
        op10_mixing,
        op11_line_dedup,
        op12_lexical_search,
        op13_filter_audit,
    )
}

_SIZES = r"""
    SELECT doc_id, source, coalesce(text, '') AS text,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: The golden ratio's fraction, and what of it a chunk of slots adds up to, as the schedule takes them.
_GOLDEN = f"{float(mixing.GOLDEN)!r}::DOUBLE"
_PER_CHUNK = f"{float((Decimal(mixing.CHUNK) * Decimal(mixing.GOLDEN)) % 1)!r}::DOUBLE"

SQL: dict[str, str] = {
    "op9_near_vectors": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
        ),
        reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ),
        groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
        SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = g.vec_id) AS n_links, component_id,
               vec_id = component_id AS kept
        FROM groups g
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END
                ) AS shingle
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)
        ),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
        ),
        groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents d JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_mixing": f"""
        WITH sizes AS ({_SIZES}),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
                   [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
            FROM sizes GROUP BY source
        ),
        filling AS (
            SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM sources
        ),
        levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER earlier, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
            FROM filling
            WINDOW earlier AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        targets AS (
            SELECT source, source_size,
                   least(cap, weight * (SELECT level FROM levels WHERE cap >= level * weight ORDER BY place LIMIT 1)) AS target
            FROM levels
        ),
        placed AS (
            SELECT doc_id, s.source, size, source_size, target, floor(target + 0.5)::BIGINT AS wanted,
                   (sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), size
                                    ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ),
        taken AS (
            SELECT *, (CASE WHEN size = 0 THEN 0 ELSE
                size * (wanted // source_size) + greatest(0, least(size, wanted % source_size - start)) END)::BIGINT AS taken
            FROM placed
        ),
        planned AS (
            SELECT *, (wanted // whole) * blocks + ceil((wanted % whole) / 512.0::DOUBLE)::BIGINT AS slots
            FROM (SELECT source, source_size, floor(target + 0.5)::BIGINT AS wanted, greatest(source_size, 1) AS whole,
                         ceil(greatest(source_size, 1) / 512.0::DOUBLE)::BIGINT AS blocks FROM targets)
        ),
        ranges AS (
            SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0.0::DOUBLE) AS low
            FROM (SELECT *, (sum(slots) OVER (ORDER BY source NULLS LAST))::DOUBLE / (sum(slots) OVER ())::DOUBLE AS high
                  FROM planned WHERE slots > 0)
        ),
        points AS (
            SELECT slot, part + rest - floor(part + rest) AS point
            FROM (SELECT slot, (slot // {mixing.CHUNK}) * {_PER_CHUNK} - floor((slot // {mixing.CHUNK}) * {_PER_CHUNK}) AS part,
                         (slot % {mixing.CHUNK} + 0.5::DOUBLE) * {_GOLDEN} AS rest
                  FROM (SELECT unnest(range((SELECT coalesce(sum(slots), 0)::BIGINT FROM planned))) AS slot))
        ),
        drawn AS (
            SELECT slot, source, slots, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth
            FROM points JOIN ranges ON point >= low AND point < high
        ),
        schedule AS (
            SELECT slot, source, nth FROM drawn WHERE nth < slots
            UNION ALL
            SELECT (SELECT sum(slots)::BIGINT FROM planned), source, unnest(range(reached, slots))
            FROM (SELECT p.source, any_value(p.slots) AS slots, count(d.slot) AS reached
                  FROM planned p LEFT JOIN drawn d ON d.source IS NOT DISTINCT FROM p.source GROUP BY p.source)
        ),
        filled AS (
            SELECT slot, p.source, nth % blocks AS block, wanted - (nth // blocks) * source_size AS until
            FROM schedule s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
        ),
        pieces AS (
            SELECT doc_id, source, block, greatest(block * 512, start) AS first, least((block + 1) * 512, start + size) AS behind
            FROM (SELECT doc_id, source, start, size, unnest(range(start // 512, (start + size - 1) // 512 + 1)) AS block
                  FROM taken WHERE size > 0)
        ),
        slots_of AS (
            SELECT doc_id, min(slot) AS first_slot, count(*) AS n_slots
            FROM pieces x JOIN filled f ON x.block = f.block AND x.source IS NOT DISTINCT FROM f.source
            WHERE least(behind, until) > first GROUP BY doc_id
        )
        SELECT doc_id, size, source_size, target, taken, first_slot, coalesce(n_slots, 0) AS n_slots
        FROM taken LEFT JOIN slots_of USING (doc_id)
    """,
    "op11_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ),
        shared AS (
            SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ),
        judged AS (
            SELECT doc_id, place, line, keep_id IS NOT NULL AND keep_id <> doc_id AS dropped
            FROM keyed LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_lexical_search": f"""
        WITH words AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
        docs AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM docs),
        postings AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM postings, totals GROUP BY term, n_docs
        ),
        wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id
        ),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
            FROM documents
        ),
        masks AS (
            SELECT part, doc_id, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
                   + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
                   + (CASE WHEN low < doc_id THEN 16 ELSE 0 END) AS mask
            FROM words
        ),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        counts AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
        ),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
        places(filter_order, bits) AS (
            SELECT '', []::INTEGER[] UNION ALL
            SELECT filter_order || letter, list_append(bits, bit) FROM places, letters WHERE NOT contains(filter_order, letter)
        ),
        steps AS (
            SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
            FROM places, range(1, 6) AS r(step) WHERE len(bits) = 5
        ),
        audited AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(counts.toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY ALL
        )
        SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audited
    """,
}
