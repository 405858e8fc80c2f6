"""BPE and token counts against the libraries that own the vocabulary files."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hallmark.llm import bpe, token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(2)
    mixed = ["".join(r.choice("abtheTHE '.ç\nßΣσİ中🙂-_=1\t²<|>▁") for _ in range(r.randint(0, 90))) for _ in range(300)]
    return [
        None, "", " ", "\n", "a", "Hello <|endoftext|> wörld's  i'm", "<|startoftext|><|endoftext|>x", "aaaaaaa aaaaaaaaaaaaaa",
        "</s> x <unk> <0x0A> <s>", "    def f(x):\n        return", " " * 40 + "the", "e\u0301 cafe\u0301", "\x1c\x00\x85\u3000",
        "word " * 6000, "x" * 5000, *mixed,
    ]


def table(spark):
    rows = list(enumerate(texts()))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_bpe_equals_the_library_both_ways(spark):
    rows, docs = table(spark)
    model = Tokenizer.from_file(WORD)
    for r in bpe.decode(bpe.encode(docs, WORD), WORD).collect():
        ids = model.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == model.decode(ids, skip_special_tokens=False)
    at_once = bpe.round_trip(docs, WORD)
    assert at_once.exceptAll(bpe.decode(bpe.encode(docs, WORD), WORD)).isEmpty() and at_once.count() == len(rows)
    assert bpe.encode(docs.where("false"), WORD).count() == 0


def test_bpe_knows_the_classes_of_all_characters():
    model, own = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    probes = [f"a{chr(c)}b {chr(c)}" for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000 and c not in (0x1C89, 0x1C8A)]
    flat, bounds = own.encode(probes)
    for k, found in enumerate(model.encode_batch(probes, add_special_tokens=False)):
        assert found.ids == flat[bounds[k] : bounds[k + 1]].tolist(), probes[k]


def test_token_counts_equal_the_library(spark):
    rows, docs = table(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in token_counts.token_counts(docs, PIECE, 20).collect():
        text = rows[r.doc_id][1] or ""
        assert r.n_tokens == len(model.encode(text)) and r.n_bytes == len(text.encode())
        assert r.over_limit == (r.n_tokens > 20)
        if len(text) < 200:
            assert r.fit_chars == max(k for k in range(len(text) + 1) if len(model.encode(text[:k])) <= 20)


def test_every_prefix_has_its_count(spark):
    _, docs = table(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    few = docs.where("doc_id between 0 and 60 and (text is null or length(text) < 100)")
    counted = token_counts.prefix_counts(few, PIECE).join(few, "doc_id")
    asked = counted.select(
        "text", "counts", token_counts.tokens_of(F.col("counts"), F.lit(7)).alias("seven"), token_counts.longest_within(F.col("counts"), 5).alias("five")
    )
    for r in asked.collect():
        text = r.text or ""
        right = [len(model.encode(text[:k])) for k in range(len(text) + 1)]
        assert r.counts == right and r.seven == right[min(7, len(text))]
        assert r.five == max(k for k, n in enumerate(right) if n <= 5)


def test_queries_give_digests(spark):
    from hallmark.llm import queries

    row = queries.op2_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    model = Tokenizer.from_file(WORD)
    ids = model.encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_limit_is_met_as_in_the_counts_of_all_prefixes(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    model = token_counts.PrefixCounter(PIECE)
    texts = ["", " ", "  a", "\n\n\tb", "héé 日本語 𝔘𝔫 x", "日" * 300, "word " * 400, "x" * 5000]
    texts += [" ".join(f"unit{k * n} of{k}" for k in range(90)) for n in range(1, 6)]
    for text in texts:
        counts = model.counts(text)
        for limit in (0, 1, 2, 5, 17, 100, 10_000):
            fine = [k for k, n in enumerate(counts.tolist()) if n <= limit]
            assert model.counted(text, limit) == (counts[-1], fine[-1])
    assert len(model.total) <= 40 + 300
