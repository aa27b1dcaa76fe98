"""One query per operator over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import (bpe, chat, divergence, embeddings, fingerprint, langid, minhash, packing, pii, quality, tokencache,
                          variants, warc)
from playlens.llm.common import doc_fold, small_batches, stage, table
from playlens.session import ensure_checkpoint_dir


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` within their labels, links at cosine 0.98 and more: one row per vector."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and what is reachable over links; for tables of thousands of vectors.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS length FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * a.length * b.length
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded: one row per document."""
    small_batches(spark)
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", coder.round_trip(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to deduplicated archives and read back: one row per page."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/playlens-warc/{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path, with_payload=False).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 8), lambda i:
           translate(to_base(CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT), 32, 4),
                     '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest
  FROM p
), o AS (
  SELECT payload_digest, max(page_id) AS original FROM d GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM d JOIN o USING (payload_digest)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from two of three folds: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_fold(3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return (docs.select("doc_id", held_out.alias("held_out"), model.predict(spark, F.col("text")).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens: one row per piece."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pieces(table(spark, sf_dir, "documents"), path)
    return packing.pack(stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all whole ``documents``, of their edited texts, and likenesses: one row per document."""
    fp = fingerprint
    rows = fp.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fp.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = fp.with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fp.to_text(F.col("sketch")).alias("fingerprint"), fp.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


#: Key of the surrogates in the queries; a user passes a secret one.
PII_KEY = "playlens"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with personal data replaced: doc_id, masked text, entities by kind."""
    done = pii.masked(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)

    def number(kind: str) -> Column:
        return F.size(F.filter("pii_entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("pii_entities").cast("long").alias("n_entities"), *map(number, pii.PATTERNS))


#: Score from which a document counts as good.
GOOD = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from four of five folds: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(doc_fold(5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = quality.train(docs, quality.trusted(labels))
    return (docs.select("doc_id", held_out.alias("held_out"), model.score(spark, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= GOOD).cast("int")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all whole ``documents``: one row per document. The groups are
    planned so that a pair right at 0.85 is missed with probability 1e-6."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.PERCENT)


#: Common shingles of all pairs that have one, and what is reachable over links; for tables of thousands of documents.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
           lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), held AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least ON least.a = s.doc_id
"""


#: Conversation -1: texts that hold the template's own marks.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1 formatted and read back: one row per conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    marked = marked.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    done = chat.format_conversations(rows.unionByName(marked))
    turns = chat.parse_turns(F.col("formatted"))
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = chat.loss_text(F.col("segments"))
    return done.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), m AS (
  SELECT *, 12 + 1 + 10 + 1 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(code, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM m GROUP BY conv_id
"""


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``: one row per document. The cache starts empty,
    so that every run encodes each distinct text; a user names a lasting one."""
    tokenizer = tokencache.TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/playlens-token-cache/{uuid.uuid4().hex}"
    return tokencache.count_tokens(table(spark, sf_dir, "documents"), tokenizer, path)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole ``documents`` with their more frequent spelling: one row per word."""
    vocab = variants.vocabulary(table(spark, sf_dir, "documents"), variants.one_letter_lost)
    return variants.spelling_variants(vocab).select("word", "form", "root", "n", "n_near", "form_n")


#: In order: words by crc32 (table by its polynomial, bytes through hex), one lost letter, counts; near words by
#: levenshtein after every letter became one ASCII byte; forms; chains.
OP12_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS spelled
  FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(spelled) // 2),
           lambda i: CAST('0x' || substr(spelled, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) AS h
  FROM counted, crc
), v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n,
         translate(word, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß',
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS a
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT))
                  ELSE run END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, a, n, unnest(list_distinct(list_prepend(a, list_transform(range(1, length(a) + 1),
           lambda i: substr(a, 1, CAST(i - 1 AS BIGINT)) || substr(a, CAST(i + 1 AS BIGINT)))))) AS d FROM v
), near AS (
  SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.d = y.d AND x.word <> y.word AND levenshtein(x.a, y.a) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of all sources of ``documents`` within each language, and their marked terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), used AS (
  SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN used USING (lang, source)
  GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(u.c, 0) + 5) // (g.n + 5 * l.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.c + 5) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_quality": op8_quality,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_chat": op10_chat,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op9_minhash_dedup": OP9_SQL,
    "op10_chat": OP10_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
