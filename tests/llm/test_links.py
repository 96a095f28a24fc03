import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from iotrail.llm import components, neardup, vectors


def groups(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)] + [(5, 5), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(3)).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == groups(nodes, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, passage = [], " ".join(word() for _ in range(60))
    for i in range(60):  # all share one passage, none alike
        rows.append(passage + " " + " ".join(word() for _ in range(rng.randint(5, 60))))
    base = [word() for _ in range(300)]
    for _ in range(120):  # a large group of near copies, some just below the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    for _ in range(40):  # pairs around the threshold, short texts
        short = [word() for _ in range(rng.randint(1, 30))]
        rows.append(" ".join(short))
        short[rng.randrange(len(short))] = word()
        rows.append("  ".join(short).upper() + "\n")
    rows += ["same exact text of some words"] * 30 + ["a b", "A\tB", "a", None, "", " \n", "é É", "x " * 20000, "x " * 20001 + "y"]
    return list(enumerate(rows))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, "same exact text of some words", 1, 2)], "doc_id long, text string, n long, component int").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(docs, size, percent).collect()]
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    want = groups(list(sets), links)
    assert sorted(r for r in got if r[0] is not None) == sorted((i, len(sets[i]), want[i]) for i in sets)
    assert [r for r in got if r[0] is None] == [(None, len(shingles("same exact text of some words", size)), None)]
    more = spark.createDataFrame([(None, "no other text has these words in it", 1, 2), (5, rows[5][1], 1, 2)], docs.schema)
    kept = sorted(neardup.keep_one(docs.unionByName(more), size=size, percent=percent).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    # Rows without an id are documents like others: the copy of a group goes, the one alone stays; so do repeated rows.
    assert [r.doc_id for r in kept] == [*sorted(set(want.values())), None]
    assert kept[-1].text.startswith("no other") and kept[0].asDict().keys() == {"doc_id", "text", "n", "component"}


@pytest.mark.parametrize("words,count,share", [(632, 2000, 0.05), (2500, 150, 0.10)])
def test_near_misses_are_not_compared(spark, monkeypatch, words, count, share):
    """A family of forms, just below the threshold to each other: few pairs reach the comparison of whole sets, none
    is linked but the copies among them. The longer ones have more shingles than the largest sketch, so their
    similarity is known but for a sampling error, and more of them reach it (6 % were measured)."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, own = [word() for _ in range(words * 89 // 100)], words - words * 89 // 100
    rows = [" ".join(template + [word() for _ in range(own)]) for _ in range(count)]
    rows += [rows[7] + " one more", rows[7] + " two more words", rows[9].replace(" ", "  ")]
    a, b = (shingles(rows[k], 3) for k in (0, 1))
    assert 0.77 < len(a & b) / len(a | b) < 0.82
    asked, confirm = [], neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda pairs, *more: asked.append(pairs.count()) or confirm(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.link(docs, 3, 85).collect()}
    assert got == {i: i for i in range(count)} | {count: 7, count + 1: 7, count + 2: 9}
    assert sum(asked) < share * count * (count - 1) / 2


def test_near_duplicates_empty(spark):
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.link(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("cell,block,fanout", [(None, 1024, 256), (20, 16, 256), (5, 16, 3)])
def test_vectors(spark, cell, block, fanout):
    rng = np.random.default_rng(3)
    rows = []
    centre = rng.normal(size=8)
    for i in range(150):
        v = centre + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4]) if i % 3 else rng.normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(300 + i, rows[7][1] if i % 2 else rows[8][1], int(i % 2)) for i in range(40)]  # equal vectors
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [float("nan")] * 8, 1), (204, [1.0, None], 1), (205, [1.0] * 8, None), (206, [1.0] * 8, 5), (207, [2.0] * 8, 5), (208, [2.0] * 4, 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(206, [1.0] * 8, 5, 0), (None, [1.0] * 8, 5, 0)], "vec_id long, embedding array<float>, label int, cell int").repartition(3)
    got = [tuple(r) for r in vectors.link(df, 0.93, cell, block, fanout).collect()]
    ok = {i: (np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.93]
    want = groups([r[0] for r in rows], links)
    n = {r[0]: sum(r[0] in x for x in links) for r in rows}
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted([(r[0], n[r[0]], want[r[0]]) for r in [*rows, rows[-3]]] + [(None, 0, None)], key=key)


def test_vectors_empty(spark):
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("width", [3, 64])
def test_copies_of_vectors_are_bounded(spark, width):
    """Random vectors: in few dimensions cells are divided and take less to join; in many, nothing is copied."""
    import math

    rng = np.random.default_rng(width)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, width)))]
    _, classes = vectors._classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    placed = vectors._cells(vectors.materialise(classes, "t"), "double", math.acos(0.99 if width == 3 else 0.93), 100, 8)
    cells = placed.groupBy(*vectors.CELL).agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("all")).collect()
    assert sum(c.own for c in cells) == 3000
    cost = sum(c.own * c["all"] for c in cells)
    assert cost < 0.3 * 3000**2 and len(cells) > 8 if width == 3 else cost == 3000**2 and sum(c["all"] for c in cells) == 3000
