"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt_dedup, exact_dedup, fingerprints, hard_negatives, mixing, order_minhash, paragraphs, prefix_trie, sentence_pieces, toxicity, warc_zip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records in stored ZIP members, and read back: what each record says."""
    return warc_zip.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every text repeats an earlier 100-byte string, and the digest of what stays."""
    return bwt_dedup.without_repeats(_documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text and its edited text, and their likenesses."""
    return fingerprints.with_edits(_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, learned from labels that aren't held out."""
    return toxicity.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and its first slot."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, by prefix counts of its words."""
    return bpe.token_counts(_documents(spark, sf_dir), tokenizer_path())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of their decoding."""
    return bpe.encoded_digests(_documents(spark, sf_dir), tokenizer_path())


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every text because its paragraph or passage repeats, or nearly does."""
    rows = paragraphs.without_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_removed", "removed_words", "removed_bytes", F.sha2("text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts that every row is in, and whether it stays."""
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.with_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that every document is in."""
    return order_minhash.near_classes(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the digest of those that end there."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "subtree_end")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every anchor and positive, from all embeddings."""
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids under a merge-type sentence piece vocabulary, and of their decoding."""
    return sentence_pieces.encoded_digests(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zip": op1_warc_zip,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_paragraph_minhash": op8_paragraph_minhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_order_minhash": op10_order_minhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentence_pieces": op13_sentence_pieces,
}

ORACLE: dict[str, str] = {
    "op1_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        f AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ), by_source AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM by_source
        ), ratios AS (SELECT *, cap::DOUBLE / w AS ratio FROM weighed), levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM ratios WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), first_open AS (SELECT ratio, rank, level FROM levels WHERE level * w <= cap ORDER BY ratio, rank LIMIT 1),
        targets AS (
            SELECT l.source, l.rank, l.source_size, CASE WHEN f.rank IS NULL OR (l.ratio, l.rank) < (f.ratio, f.rank) THEN l.cap::DOUBLE ELSE f.level * l.w END AS target
            FROM levels l LEFT JOIN first_open f ON true
        ), streams AS (
            SELECT s.doc_id, s.size, t.rank, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
                CAST(coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), shares AS (
            SELECT *, coalesce(lag(hi) OVER (ORDER BY rank), 0.0::DOUBLE) AS lo
            FROM (SELECT *, CAST(round(target) AS BIGINT) AS words, sum(target) OVER () AS total, sum(target) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS hi FROM targets)
        ), points AS (
            SELECT i, x - floor(x) AS x FROM (SELECT range AS i, (range % 1048576) * 0.6180339887498949::DOUBLE + (range // 1048576 % 1048576) * 0.607787409740351::DOUBLE + (range // 1099511627776) * 0.2909558982617013::DOUBLE AS x
                FROM range((SELECT CAST(ceil(max(total) / 512) AS BIGINT) FROM shares)))
        ), placed AS (
            SELECT p.i AS slot, s.rank, s.words, row_number() OVER (PARTITION BY s.rank ORDER BY p.i) - 1 AS k, count(*) OVER (PARTITION BY s.rank) AS n FROM points p JOIN shares s ON p.x >= s.lo AND p.x < s.hi AND s.target > 0
        ), schedule AS (
            SELECT * FROM placed UNION ALL SELECT (SELECT count(*) FROM points) + rank, rank, words, 0, 1 FROM shares WHERE target > 0 AND rank NOT IN (SELECT rank FROM placed)
        ), blocks AS (
            SELECT rank, slot, CAST(floor(k * (words::DOUBLE / n) + 1e-6::DOUBLE) AS BIGINT) AS block_begin, CASE WHEN k + 1 = n THEN words ELSE CAST(floor((k + 1) * (words::DOUBLE / n) + 1e-6::DOUBLE) AS BIGINT) END AS block_end FROM schedule
        ), spans AS (SELECT s.rank, s.off, s.off + c * s.source_size AS a, least(s.off + s.size + c * s.source_size, s.words) AS b FROM streams s, (VALUES (0), (1), (2)) AS v(c) WHERE s.size > 0),
        met AS (
            SELECT p.rank, p.off, CAST(sum(least(p.b, q.block_end) - greatest(p.a, q.block_begin)) AS BIGINT) AS taken, min(q.slot) AS first_slot
            FROM spans p JOIN blocks q ON p.rank = q.rank AND p.a < q.block_end AND q.block_begin < p.b WHERE p.a < p.b GROUP BY p.rank, p.off
        )
        SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(m.taken, 0) AS taken, m.first_slot FROM streams s LEFT JOIN met m ON s.rank = m.rank AND s.off = m.off AND s.size > 0
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # CRC-32 of a decimal id, by its table; then every prefix as a text of digests, in preorder when sorted.
    "op11_prefix_trie": """
        WITH entries AS (SELECT list(t ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t FROM range(256) AS r(i))),
        turns AS (
            SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, left(d, 30) AS letter, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(d, 30)) AS pos
            FROM (SELECT *, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL)
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM turns), entries
        ), rebuilt AS (
            SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, pos) AS depth, letter, bytes
            FROM convs c JOIN (SELECT conv_id, pos, letter, bytes, unnest([false, true]) AS own FROM turns) t ON t.conv_id = CASE WHEN own THEN c.conv_id ELSE c.base END AND own = (pos > h)
        ), paths AS (
            SELECT conv_id, depth, bytes, string_agg(letter, ' ') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
            UNION ALL SELECT conv_id, 0, 0, '' FROM convs
        ), longest AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id), nodes AS (
            SELECT min(p.conv_id) AS conv_id, depth, path, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = n), '')) AS ends_sha256
            FROM paths p JOIN longest l ON p.conv_id = l.conv_id GROUP BY depth, path
        ), families AS (
            SELECT c.*, p.conv_id AS parent_conv_id, p.path AS above FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = rtrim(left(c.path, greatest(len(c.path) - 30, 0)))
        ), children AS (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM families WHERE depth > 0 GROUP BY above, depth),
        counted AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM families f LEFT JOIN children c ON c.above = f.path AND c.depth = f.depth),
        subtrees AS (
            SELECT p.path, p.depth, count(*) AS size, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM counted u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.path, p.depth
        )
        SELECT conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        FROM counted c JOIN subtrees s ON s.path = c.path AND s.depth = c.depth
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT row_number() OVER () AS uid, CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT a.uid AS anchor, a.vec_id AS anchor_id, r.uid, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
            FROM e a, e r WHERE a.vec_id % 100 = 0 AND a.uid <> r.uid
        ), positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
        WINDOW best AS (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.uid) QUALIFY row_number() OVER best <= 10
    """,
}
