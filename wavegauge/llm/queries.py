"""The registered queries of this package and their SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


@query(
    "op5_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))


JUMP_SQL = """
    WITH RECURSIVE k AS (
      SELECT doc_id, text, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2147483646 + 1 AS seed,
             CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 8)) AS BIGINT) % 1024 AS slice FROM documents
    ), walk AS (
      SELECT doc_id, n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, seed AS k FROM k, (VALUES (24), (25)) t(n)
      UNION ALL
      SELECT doc_id, n, j, CAST(floor((j + 1) * 2147483647.0::DOUBLE / ((k * 48271) % 2147483647)) AS BIGINT), (k * 48271) % 2147483647 FROM walk WHERE j < n
    ), shard AS (SELECT doc_id, n, CAST(max(b) AS INTEGER) AS shard FROM walk GROUP BY ALL),
    crc_step AS (
      SELECT i AS b, 0 AS s, CAST(i AS BIGINT) AS v FROM range(256) t(i)
      UNION ALL
      SELECT b, s + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE s < 8
    ), crc AS (SELECT list(v ORDER BY b) AS t FROM crc_step WHERE s = 8)
    SELECT k.doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:-2], lambda h: CAST(('0x' || h) AS BIGINT))),
               lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
           'key' AS law, s.shard, CAST(row_number() OVER (PARTITION BY s.shard ORDER BY slice, k.doc_id) - 1 AS BIGINT) AS slot, g.shard AS grown_shard
    FROM k JOIN shard s ON s.doc_id = k.doc_id AND s.n = 24 JOIN shard g ON g.doc_id = k.doc_id AND g.n = 25, crc
    """


@query("op7_sharding", JUMP_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24)


@query(
    "op10_line_dedup",
    """
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
    ), k AS (
      SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ), r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    m AS (SELECT k.*, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_pattern_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, span_text

    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "grammar")
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


@query(
    "op2_minhash_near_dedup",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), s AS MATERIALIZED (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
    walk AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT v.node, e.b FROM walk v JOIN e ON e.a = v.reached),
    c AS (SELECT node, min(reached) AS component_id FROM walk GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


@query(
    "op3_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    walk AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT w.node, l.b FROM walk w JOIN l ON l.a = w.reached),
    c AS (SELECT node, min(reached) AS component_id FROM walk GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import cross_entropy_difference

    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import decode_pieces, encode_pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(table(spark, sf_dir, "documents"), path)
    digest = F.crc32(F.array_join("ids", ",").cast("binary"))
    kept = encoded.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_crc32"), "ids")
    out = decode_pieces(kept, path)
    return out.select("doc_id", "n_ids", "ids_crc32", (F.col("decoded") == F.col("text")).alias("round_trip"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(
    "op12_quality_rules",
    """
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), pos AS (SELECT r, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
    win AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos, (VALUES (3), (15), (51)) t(k) WHERE i + k - 1 <= n),
    rep AS (SELECT r, k, unnest(list(i)) AS i FROM win GROUP BY r, k, g HAVING count(*) >= 2),
    cov AS (SELECT DISTINCT r, k, unnest(range(i, i + k)) AS i FROM rep),
    c AS (SELECT r, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 15) AS n15, count(*) FILTER (k = 51) AS n51 FROM cov GROUP BY r),
    l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
    u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    v AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n3, 0) AS n_repeat_words, coalesce(n15, 0) AS covered_words, coalesce(n51, 0) AS n51
      FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN u ON u.r = d.r
    ), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
           NOT base_failed AND 100 * covered_words <= 30 * n_words AND n51 = 0 AS kept
    FROM f
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query(
    "op11_filter_audit",
    """
    WITH d AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), m AS (
      SELECT part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask,
             coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
      FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id
    ), n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(f, bit)),
    o AS (
      SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
    ), s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) r(step)),
    x AS (
      SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (mask & CAST(before + own AS INTEGER) = 0), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & own > 0), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INTEGER) > 0 AND mask & own > 0), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & own > 0), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & own > 0), 0) AS BIGINT) AS toxic_lost
      FROM n, s GROUP BY part, filter_order, step, own
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM x
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_collocations",
    """
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents
    ), w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cut AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, range(1, 4) t(j) WHERE j < k),
    s AS (
      SELECT cut.lang, cut.phrase, cut.k, a, j, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    part AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k),
    most AS (SELECT lang, phrase, max(a) AS a FROM part GROUP BY ALL),
    kept AS (SELECT b.* FROM b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.a IS NULL OR 100 * m.a < 80 * b.a),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))
