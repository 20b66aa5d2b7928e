"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "found_links")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .elias_fano import token_files

    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import placed_turns, prefix_trie, with_shared_heads

    placed = cut(placed_turns(table(spark, sf_dir, "conversations")))
    convs = placed.select("conv_id").distinct()
    return prefix_trie(with_shared_heads(placed, convs), convs).drop("turn_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_secret_scan,
        op2_quality_rules,
        op3_lm_scoring,
        op4_packing,
        op5_exact_dedup,
        op6_near_dedup,
        op7_toxicity,
        op8_mixing,
        op9_sharding,
        op10_token_files,
        op11_decontamination,
        op12_prefix_trie,
        op13_hard_negatives,
    )}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op9_sharding": """
        WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i)),
          b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
          c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda i: (strpos('0123456789ABCDEF', i[1]) - 1) * 16 + strpos('0123456789ABCDEF', i[2]) - 1)),
              lambda x, y: xor(x >> 8, crc_table[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crc),
          s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
          p AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INT AS shard FROM s)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM p
    """,
    "op11_decontamination": r"""
        WITH texts AS (SELECT doc_id AS id, NULL AS item, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark),
        t AS (SELECT id, item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        item_places AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM t WHERE item IS NOT NULL AND len(w) > 0),
        item_windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM item_places),
        doc_places AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM t, (SELECT DISTINCT n FROM item_windows) WHERE id IS NOT NULL),
        hits AS (SELECT id, item, n, k FROM (SELECT id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM doc_places) JOIN item_windows USING (n, words)),
        covered AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY id),
        found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
        SELECT t.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM t LEFT JOIN covered ON t.id = covered.id LEFT JOIN found ON t.id = found.id WHERE t.item IS NULL
    """,
    "op12_prefix_trie": """
        WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i)),
        c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM c, crc),
        rebuilt AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h], []), h.s[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
        prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
        nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, p),
        edges AS (SELECT n.d, n.p, q.p AS parent, q.conv_id AS parent_conv_id FROM nodes n JOIN nodes q ON q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]),
        children AS (SELECT d - 1 AS d, parent AS p, count(*) AS n_children FROM edges GROUP BY d, parent),
        one AS (SELECT d, p, n_convs, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].text) END AS saved FROM nodes LEFT JOIN children USING (d, p)),
        sums AS (SELECT e AS d, p[1:e] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM one) GROUP BY e, p[1:e])
        SELECT n.conv_id, n.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM nodes n JOIN sums USING (d, p) LEFT JOIN edges USING (d, p) LEFT JOIN children USING (d, p)
    """,
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
        FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER w <= 5
    """,
}
