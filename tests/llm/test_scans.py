"""Decontamination and licence scans against brute force, and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hallmark.llm import decontaminate, licenses


def words(text):
    return (text or "").encode().lower().split()


def best_windows(docs, items):
    found = {}
    for d, text in docs:
        own = words(text)
        for i, item in items:
            want = words(item)
            size = min(5, len(want))
            if not want:
                continue
            a = Counter(tuple(want[k : k + size]) for k in range(len(want) - size + 1))
            values = []
            for s in range(len(own) - len(want) + 1):
                b = Counter(tuple(own[k : k + size]) for k in range(s, s + len(want) - size + 1))
                both = sum((a & b).values())
                joint = sum((a | b).values())
                if 100 * both >= 80 * joint:
                    values.append((both / joint, -s))
            if values:
                v, s = max(values)
                found[d, i] = (-s, len(want), len(values), v)
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(150)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 3, 5, 12, 40, 41))))) for k in range(25)]
    items += [(30, "same same same same same same same same"), (31, None), (32, " "), (33, items[0][1])]
    docs = []
    for k in range(60):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 2)):
            leak = words(r.choice(items)[1])
            leak = [w.decode() for w in leak]
            for _ in range(r.choice((0, 0, 1, 2))):
                if leak:
                    leak[r.randrange(len(leak))] = r.choice(vocabulary)
            at = r.randint(0, len(text))
            text[at:at] = leak
        docs.append((k, " ".join(text).upper() if k % 7 == 0 else "\n".join(text)))
    docs += [(100, None), (101, ""), (102, "same " * 50)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    old, decontaminate.ITEM_BYTES = decontaminate.ITEM_BYTES, 400
    got = decontaminate.contaminated(table, bench).collect()
    decontaminate.ITEM_BYTES = old
    right = best_windows(docs, items)
    assert {(x.doc_id, x.item_id): (x.start, x.n_words, x.n_windows) for x in got} == {k: v[:3] for k, v in right.items()}
    assert all(math.isclose(x.similarity, right[x.doc_id, x.item_id][3]) for x in got)
    stay = decontaminate.without_items(table, bench)
    assert stay.columns == table.columns
    assert {x.doc_id for x in stay.collect()} == {d for d, _ in docs} - {d for d, _ in right}
    assert decontaminate.contaminated(table.where("false"), bench).count() == 0
    assert decontaminate.without_items(table, bench.where("false")).count() == len(docs)


def test_texts_shorter_than_an_item_equal_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((4, 5, 8, 9, 12, 30, 51))))) for k in range(40)]
    items += [(50, "same " * 20), (51, "a b c d e f g h i " + "x " * 30), (52, items[0][1])]
    docs = [(0, " ".join(dict(items)[51].split()[:-3])), (1, "same " * 17), (2, "same " * 12), (3, "same")]
    for k, (_, item) in enumerate(items):
        for cut in (1, 2, 4, 9):
            own = item.split()
            own = own[r.randint(0, cut) :][: max(0, len(own) - cut)]
            if own and r.random() < 0.3:
                own[r.randrange(len(own))] = "other"
            docs.append((100 + 10 * k + cut, " ".join(own)))
    right = {}
    for d, text in docs:
        own = text.split()
        for i, item in items:
            want = item.split()
            size, length = min(5, len(want)), min(len(own), len(want))
            a = Counter(tuple(want[k : k + size]) for k in range(len(want) - size + 1))
            values = []
            for s in range(len(own) - length + 1):
                b = Counter(tuple(own[k : k + size]) for k in range(s, s + length - size + 1))
                both, joint = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= 80 * joint:
                    values.append((both / joint, -s))
            if values:
                right[d, i] = (-max(values)[1], length, len(values), max(values)[0])
    assert sum(n < len(dict(items)[i].split()) for (_, i), (_, n, _, _) in right.items()) > 20
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, x.n_words, x.n_windows, x.similarity) for x in decontaminate.contaminated(table, bench).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in right.items()}
    assert all(math.isclose(got[k][3], right[k][3]) for k in right)
    assert {x.doc_id for x in decontaminate.without_items(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in right}


def test_repeated_shingles_are_found_as_by_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]

    def some(n):
        return [r.choice(vocabulary) for _ in range(n)]

    items, docs = [], []
    for k in range(12):
        item = some(164) + ["same"] * 24 if k % 2 else some(60) + ["|"] * 60 + some(70)
        items.append((k, " ".join(item)))
        for n in range(8):
            # Other words stand where equal ones did, or equal ones where others did.
            leak = item[:-n] + some(n) if n and k % 2 else item[n:]
            if n % 3 == 2:
                leak[10 : 10 + n] = ["again"] * n
            docs.append((10 * k + n, " ".join(some(9) + leak + some(9))))
    docs += [(900, "| " * 20_000), (901, " ".join(some(60) + ["|"] * 3000 + some(70)))]
    right = best_windows([d for d in docs if d[0] != 900], items)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_windows for x in decontaminate.contaminated(table, bench).collect()}
    assert len(right) > 60 and set(got) <= set(right)
    windows = sum(n for _, _, n, _ in right.values())
    assert sum(got.values()) >= 0.97 * windows and len(got) >= 0.99 * len(right)


def test_hamming_blocks_miss_nothing_and_meet_few():
    r = np.random.default_rng(3)
    items = r.integers(0, 256, (400, 16), dtype=np.uint8)
    rows = r.integers(0, 256, (200, 16), dtype=np.uint8)
    near = items[:200].copy()
    for k, row in enumerate(near):
        for bit in r.choice(128, k % (decontaminate.RADIUS + 4), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    index = decontaminate.HammingBlocks(items)
    met = index.met(rows)
    assert len(met[0]) < 0.05 * len(rows) * len(items) and len(set(zip(*met, strict=True))) == len(met[0])
    both = np.concatenate((rows, near, near[:5]))
    apart = np.unpackbits(both[:, None] ^ items, axis=2).sum(axis=2)
    right = set(zip(*np.nonzero(apart <= decontaminate.RADIUS), strict=True))
    assert set(zip(*index.within(both), strict=True)) == right and len(right) > 150


def test_item_blocks_are_bounded_and_whole(spark):
    bench = spark.createDataFrame([(k, "ab" * k) for k in range(20)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, 50))
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == list(range(20))


def cosine_of(unit, template, idf, other):
    a, b = (Counter(re.findall("[0-9a-z\x80-\U0010ffff]+", x.lower())) for x in (unit, template))
    weight = lambda t: idf.get(t, other)
    dot = sum(a[t] * b[t] * weight(t) ** 2 for t in a.keys() & b.keys())
    norm = lambda x: math.sqrt(sum((n * weight(t)) ** 2 for t, n in x.items()))
    return dot / (norm(a) * norm(b)) if a and b else 0.0


def test_licence_scan_equals_brute_force(spark):
    filler = "The of to and under version work this file later\nsome prose here"
    rows = [
        (0, "a/LICENSE", "Apache License\nLicensed under the Apache License, Version 2.0."),
        (1, "a/b/x.py", f"# Released under the MIT License.\n{filler}"), (2, "a/b/y.py", filler), (3, "a/b/c/z.py", None),
        (4, "q/y.py", filler), (5, None, "Licensed under CC BY-NC 4.0."), (6, "a/b/COPYING.txt", "permission is hereby granted, free of charge"),
        (7, "top.py", ""), (8, "q/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (9, "q/LICENSE.md", "Licensed under CC BY 4.0."), (10, "q/r//s.py", filler), (2, "a/b/y.py", filler),
        (11, "z/w.py", "word " * 20_000 + "\n\nThis Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0.\n\n" + filler),
    ]
    table = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    found = licenses.scan(table).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    # brute force over all lines and paragraphs
    vocabulary = {t for _, x in licenses.TEMPLATES for t in re.findall("[0-9a-z]+", x.lower())}
    df = Counter(t for _, _, x in rows for t in set(re.findall("[0-9a-z\x80-\U0010ffff]+", (x or "").lower())) & vocabulary)
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocabulary}
    other = math.log(1 + len(rows)) + 1
    for d, path, text in rows:
        units = (text or "").split("\n") + re.split("\n[ \t]*\n", text or "")
        if path and re.match("(?i)(licen[cs]e|copying|notice)", path.split("/")[-1]):
            units.append(text or "")
        score, name = max(((round(cosine_of(u, t, idf, other), 9), n) for u in units for n, t in licenses.TEMPLATES), key=lambda x: x[0])
        assert got[d].own_license == (name if score >= licenses.THRESHOLD else None), (d, score, name)
        assert got[d].own_license is None or math.isclose(got[d].similarity, score, abs_tol=1e-8)
    assert (got[2].license, got[2].inherited_from) == ("Apache-2.0", "a") and got[3].license == "Apache-2.0"
    assert got[4].license in ("GPL-3.0", "CC-BY-4.0") and got[10].license == got[4].license and got[10].inherited_from == "q"
    assert got[7].license is None and got[5].license == "CC-BY-NC-4.0" and got[1].license == "MIT" and got[1].inherited_from is None
    assert licenses.scan(table.where("false")).count() == 0


def test_top_folder_gives_its_licence(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "deep/er/file", "x"), (3, "file", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[2].license == got[3].license == "MIT" and got[2].inherited_from == ""


def test_a_header_scores_the_same_in_corpora_of_any_size(spark):
    def corpus(files):
        common = [(k, f"x/{k}.py", f"the code is good\nunder work {'software' if k % 2 else 'released'}") for k in range(files)]
        own = [(k, f"y/{k}/LICENSE", "Released under the MIT License software") for k in range(10**6, 10**6 + files // 20)]
        return common + own + [(-1, "y/rare.py", "Released under the MIT License zyxwvut abcdefgh")]

    scores = {}
    for files in (100, 1000, 20_000):
        rows = corpus(files)
        for head in (licenses.HEAD_TERMS, 2):  # terms behind the head are joined
            old, licenses.HEAD_TERMS = licenses.HEAD_TERMS, head
            got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
            licenses.HEAD_TERMS = old
            scores[files, head] = got[10**6].similarity
            assert got[10**6].own_license == "MIT"
            df = Counter(t for _, _, x in rows for t in set(re.findall("[0-9a-z]+", x.lower())))
            vocabulary = {t for _, x in licenses.TEMPLATES for t in re.findall("[0-9a-z]+", x.lower())} | set(df)
            idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in vocabulary}
            for d, text in ((10**6, rows[files][2]), (-1, rows[-1][2])):
                right = max(cosine_of(text, t, idf, 0.0) for _, t in licenses.TEMPLATES)
                assert (got[d].own_license is not None) == (right >= licenses.THRESHOLD)
                assert got[d].own_license is None or math.isclose(got[d].similarity, right, abs_tol=1e-8)
    assert max(scores.values()) - min(scores.values()) < 0.02
