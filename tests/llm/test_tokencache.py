"""Cached token counts against the libraries themselves."""

import itertools
import tempfile

import public_tokenizers
import sentencepiece
from nasty import documents, empty, sf_dir, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playlens.llm import queries, tokencache

JSON = public_tokenizers.path("word_bpe_49k.json")
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def library():
    coder = Tokenizer.from_file(JSON)
    return lambda text: len(coder.encode(text, add_special_tokens=False).ids)


def folder():
    return tempfile.mkdtemp(prefix="playlens-cache-", dir="/tmp")


def test_query_on_nasty_rows(spark):
    want = library()
    got = queries.op11_token_counts(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    rows = [(r.doc_id, len((r.text or "").encode()), want(r.text or "")) for r in documents(spark).collect()]
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit={n > 2048})" for i, b, n in rows)
    assert queries.op11_token_counts(spark, sf_dir(spark, documents=empty(spark))).count() == 0


def test_words_count_as_the_library_counts():
    with open(JSON, "rb") as f:
        words = tokencache.Words(f.read())
    want = library()
    some = [chr(a) + chr(b) + "a" + chr(a) for a in range(256) for b in (0, 9, 0x1C, 0x20, 0x27, 0x41, 0x5F, 0x85, 0xA0, 0xAA, 0xB2, 0xB5, 0xC9, 0xD7, 0xDF)]
    some += ["".join(c) for c in itertools.product(["Don't", "'S", "é", "É", "J̌", "4²", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "ΣΑΣ", "İ"], repeat=3)]
    some += [t or "" for t in texts()]
    for t in some:
        assert words.count(t) == want(t), repr(t)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    with open(JSON, "rb") as f:
        words = tokencache.Words(f.read())
    some = [t or "" for t in texts()] + ["漢字 É <|endoftext|> Σ " * 50]
    want = library()
    monkeypatch.setattr(tokencache, "LONG_TEXT", 7)
    assert [words.count(t) for t in some] == [want(t) for t in some]


def test_white_space_is_one_content(spark):
    file = tokencache.TokenizerFile(JSON)
    assert file.kind is tokencache.Words
    forms = [f"a{chr(c)}b" for c in WHITE_SPACE] + ["a \n\t b", " a b　"]
    assert spark.range(1).select(file.normalised(F.lit("a\ufeffb"))).first()[0] == "a\ufeffb"
    rows = spark.createDataFrame([(t,) for t in forms], "text string").select(file.normalised(F.col("text")).alias("t")).distinct()
    assert [r.t for r in rows.collect()] == ["a b"]
    assert {library()(t) for t in forms} == {library()("a b")}
    # Java's class must not hold what the tokenizer's does not.
    every = spark.range(0x110000).where("id not between 55296 and 57343 and id != 65279").select(  # decode drops a byte order mark
        "id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("t"))
    assert sorted(r.id for r in every.where(F.regexp_replace("t", r"(?U)\s+", "") == "").collect()) == WHITE_SPACE


def test_only_misses_are_encoded_and_versions_stay_apart(spark):
    path, docs = folder(), documents(spark)
    file = tokencache.TokenizerFile(JSON)
    cache = tokencache.DigestCache(spark, path, file.version)
    first = sorted(map(str, tokencache.count_tokens(docs, file, path).collect()))
    stored = spark.read.parquet(cache.path)
    before = stored.count()
    assert before == stored.select("digest").distinct().count() == docs.select(
        file.normalised(F.col("text"))).distinct().count()
    assert sorted(map(str, tokencache.count_tokens(docs, file, path).collect())) == first
    assert spark.read.parquet(cache.path).count() == before
    more = docs.unionByName(spark.createDataFrame([(99, "one  two", None, None, 8), (100, "a new one", None, None, 9)], docs.schema))
    got = {r.doc_id: r.n_tokens for r in tokencache.count_tokens(more, file, path).collect()}
    assert got[99] == library()("one two") and got[100] == library()("a new one")
    assert spark.read.parquet(cache.path).count() == before + 1
    # A stored count is what a hit returns; another tokenizer's is not.
    spark.read.parquet(cache.path).withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(f"{path}/changed/version={file.version}")
    assert {r.n_tokens for r in tokencache.count_tokens(docs, file, f"{path}/changed").collect()} == {7}
    other = tokencache.TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = tokencache.count_tokens(docs.where("doc_id < 12"), other, f"{path}/changed").collect()
    want = {r.doc_id: len(coder.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert all(r.n_tokens == want[r.doc_id] for r in got) and len({r.n_tokens for r in got}) > 3


def test_a_repeated_append_changes_nothing(spark):
    path, docs = folder(), documents(spark)
    file = tokencache.TokenizerFile(JSON)
    first = sorted(map(str, tokencache.count_tokens(docs, file, path).collect()))
    cache = tokencache.DigestCache(spark, path, file.version)
    cache.append(spark.createDataFrame(cache.read().collect(), tokencache.CACHE_SCHEMA))
    assert sorted(map(str, tokencache.count_tokens(docs, file, path).collect())) == first


def test_sentencepiece_file(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokencache.count_tokens(documents(spark), tokencache.TokenizerFile(path), folder()).collect()
    want = {r.doc_id: len(coder.encode(r.text or "")) for r in documents(spark).where("doc_id is not null").collect()}
    assert all(r.n_tokens == want[r.doc_id] for r in got if r.doc_id is not None)


def test_hot_text_is_joined_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("playlens.llm.common.HOT_ROWS", 100)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t "), "id")).otherwise("hot text").alias("text"))
    got = tokencache.count_tokens(docs, tokencache.TokenizerFile(JSON), folder()).collect()
    want = library()
    assert len(got) == 3000 and all(r.n_tokens == want(f"t {r.doc_id}" if r.doc_id % 3 == 0 else "hot text") for r in got)
