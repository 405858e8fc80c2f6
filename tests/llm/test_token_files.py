"""Token files against the tokenizers library, and grammars against what they compress."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hallmark.llm import token_files
from hallmark.llm.grammar import compressed

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("kinds", [2, 5, 300])
def test_grammar_round_trip_and_random_access(kinds):
    r = np.random.default_rng(kinds)
    ids = np.concatenate([r.integers(0, kinds, 3000), np.tile(r.integers(0, kinds, 40), 60), np.zeros(500, int)])
    found = compressed(ids, kinds)
    assert len(found) == len(ids) and (found.ids() == ids).all()
    assert len(found.rules) and len(found.symbols) < len(ids) * 0.8
    for _ in range(200):
        a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
        assert (found.ids(a, b) == ids[a:b]).all()


def test_grammar_of_few_ids():
    for ids in ([], [1], [1, 1], [1] * 40, [0, 1] * 8, [2] * 17):
        assert compressed(np.array(ids, np.int64), 3).ids().tolist() == ids


def test_rules_derive_what_they_say():
    ids = np.array([1, 2, 3, 4] * 50 + [1, 2] * 30)
    found = compressed(ids, 5)
    derived = {k: [k] for k in range(5)}
    for k, (a, b) in enumerate(found.rules.tolist()):
        derived[5 + k] = derived[a] + derived[b]
        assert len(derived[5 + k]) == found.lengths[k]
    assert [x for s in found.symbols.tolist() for x in derived[s]] == ids.tolist()


def odd_texts(seed=4):
    r = random.Random(seed)
    bits = ["word", "don't", " ", "  ", "   ", "\n", "\r\n", "\t", "É", "ß", "日本語", " ", " ", "\x1c", "42", "1st",
            "<|endoftext|>", "<|", "|>", "...", "'s", "'", "🙂", "é", "A", "-", "\x00", "\u0085", "б", "x" * 30]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("slice_bytes", [40, 1 << 20])
def test_encoder_equals_the_library_on_odd_texts(library, monkeypatch, slice_bytes):
    monkeypatch.setattr(token_files, "SLICE", slice_bytes)
    texts = [None, "", *odd_texts()]
    encoder = token_files.Encoder(PATH)
    got = {}
    for row, ids, ended in encoder.stream(pa.array(texts)):
        got.setdefault(row, []).extend(ids.tolist())
    assert [got[k] for k in range(len(texts))] == [ids_of(library, t) for t in texts]


def test_encoder_that_forgets_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    encoder = token_files.Encoder(PATH)
    texts = odd_texts(5)
    for k in range(0, 400, 4):
        got = [ids.tolist() for _, ids, _ in encoder.stream(pa.array(texts[k : k + 4]))]
        assert got == [ids_of(library, t) for t in texts[k : k + 4]]
    assert len(encoder.known) < 500


def rows():
    texts = odd_texts(9)[:120]
    found = [(k * 7 % 120 - 20, t) for k, t in enumerate(texts)]
    return found + [(None, "none"), (3, "again"), (3, "again"), (3, None), (500, "a b " * 900)]


def expected(library, of):
    """{(doc_id, start, n, crc)}; rows that share a doc_id go by texts' hashes, so they only have to tile their span."""
    start, found = 0, []
    for d, t in of:
        ids = ids_of(library, t)
        found.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("shard_ids", [64, 1 << 20])
def test_files_hold_every_document_in_order(spark, library, tmp_path, shard_ids):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns(
        {"start": F.lit("clash"), "part": F.lit("clash"), "_hash": F.lit(1)}
    )
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy("doc_id", F.xxhash64("t"), "t").collect()
    want = expected(library, [(r.doc_id, r.t) for r in ordered])
    path = str(tmp_path / "ids")
    token_files.write(docs.repartition(5), PATH, path, shard_ids=shard_ids)
    found = token_files.summed(spark, path)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want

    pieces = token_files.read(spark, path, low=3, high=500).orderBy("start", "before").collect()
    whole = {}
    for p in pieces:
        assert p.before == len(whole.setdefault((p.doc_id, p.start), []))
        whole[p.doc_id, p.start] += p.ids
    wanted = [(d, s, n, c) for d, s, n, c in want if d is not None and 3 <= d <= 500]
    assert [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, s), x in whole.items()] == wanted
    if shard_ids == 64:
        assert any(p.before for p in pieces)


def test_long_text_without_a_space_and_empty_table(spark, library, tmp_path):
    text = "abc123-" * 900_000
    docs = spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string")
    token_files.write(docs, PATH, str(tmp_path / "long"))
    got = token_files.summed(spark, str(tmp_path / "long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(library, [(1, text), (2, "end")])
    token_files.write(docs.where("false"), PATH, str(tmp_path / "none"))
    assert token_files.summed(spark, str(tmp_path / "none")).count() == 0


def test_joined_check_sums():
    r = random.Random(2)
    for _ in range(50):
        a, b = (r.randbytes(r.randint(0, 300)) for _ in range(2))
        assert token_files.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_not_a_shard():
    with pytest.raises(ValueError):
        token_files.unpacked(bytes(64))
