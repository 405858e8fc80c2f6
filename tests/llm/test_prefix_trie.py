"""Prefix tries against plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hallmark.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(700), 120) + [100, 200]:
        turns = [(r.choice(["user", "system", None]), r.choice(["hi", "", None, "été 🙂", "hello there"])) for _ in range(r.randint(1, 7))]
        if r.random() < 0.5:
            turns = [("system", "be brief"), ("user", "hi"), ("assistant", "hello")][: r.randint(1, 3)] + turns[:2]
        rows += [(c, r.choice([k, k, None]) if r.random() < 0.1 else k, *t) for k, t in enumerate(turns)]
    rows += [(None, 1, "user", "lost"), (903, 1, "user", "only"), (903, 1, "user", "only")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit, bits", [(1, 0), (30, 2), (20_000, 12)])
def test_equals_plain_tries_at_every_container_size(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(prefix_trie, "MEMBER_BITS", bits)
    rows = made(limit)
    table = spark.createDataFrame(rows, ROWS).withColumns({"depth": F.lit("clash"), "end": F.lit("x"), "pos": F.lit("y")})
    assert found(prefix_trie.shared_prefixes(table, limit=limit)) == brute(rows)


def test_many_equal_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MEMBER_BITS", 3)
    rows = [(c, k, "user", f"turn {k}") for c in range(150) for k in range(4)]
    rows += [(1000, k, "user", "x" * (k % 7)) for k in range(5000)]
    table = spark.createDataFrame(rows, ROWS).repartition(7)
    assert found(prefix_trie.shared_prefixes(table, limit=3)) == brute(rows)


def test_places_are_counted_across_tasks(spark):
    rows = [(c, k, "u", "ab"[: 1 + k % 2]) for c in (1, 2) for k in range(3000)]
    placed = prefix_trie.placed(prefix_trie.turns(spark.createDataFrame(rows, ROWS).repartition(5)))
    got = sorted((r.conv_id, r.pos, r.upto) for r in placed.collect())
    upto = [sum(1 + i % 2 for i in range(k + 1)) for k in range(3000)]
    assert got == [(c, k, upto[k]) for c in (1, 2) for k in range(3000)]


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "gone") for c in (101, 102, 103, 104)]
    table = spark.createDataFrame(rows, ROWS)
    assert found(prefix_trie.shared_prefixes(table)) == brute(rows)
    assert prefix_trie.shared_prefixes(table.where("false")).count() == 0
