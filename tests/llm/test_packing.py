import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from iotrail.llm import common, packing


def check(solution, counts, capacity):
    got = {}
    for times, filling in solution:
        assert sum(k * n for k, n in filling) <= capacity
        for k, n in filling:
            got[k] = got.get(k, 0) + times * n
    assert got == {k: n for k, n in counts.items() if n}
    return sum(times for times, _ in solution)


def optimum(items, capacity):
    """Brute force: fewest bins by trying every bin for every item, largest first."""
    best = len(items)

    def go(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[at] <= capacity and bins[k] not in bins[:k]:
                go(at + 1, [*bins[:k], bins[k] + items[at], *bins[k + 1 :]])
        go(at + 1, [*bins, items[at]])

    go(0, [])
    return best


def test_search_finds_the_optimum():
    rng = random.Random(5)
    worse = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 11))), reverse=True)
        counts = {k: len(list(g)) for k, g in itertools.groupby(items)}
        n, want = check(packing.complete(counts, capacity), counts, capacity), optimum(items, capacity)
        assert n >= want >= packing.bound(counts, capacity)
        worse += n > want
    assert worse == 0


def test_fillings_are_the_undominated_ones():
    def replaces(larger, smaller):
        """Do the pieces of `smaller` fit, in groups, into those of `larger`?"""
        if not smaller:
            return True
        k, rest = smaller[0], smaller[1:]
        return any(k <= x and replaces([*larger[:i], x - k, *larger[i + 1 :]], rest) for i, x in enumerate(larger) if x not in larger[:i])

    assert set(packing.fillings({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == {((6, 1), (4, 1))}
    rng = random.Random(3)
    for _ in range(150):
        room = rng.randint(1, 14)
        counts = {k: rng.randint(0, 3) for k in rng.sample(range(1, 15), 5)}
        usable = [k for k in counts if k <= room]
        every = []
        for some in itertools.product(*(range(counts[k] + 1) for k in usable)):
            if sum(n * k for n, k in zip(some, usable)) <= room:
                every.append(sorted((k for n, k in zip(some, usable) for _ in range(n)), reverse=True))
        want = [f for f in every if not any(g != f and replaces(g, f) for g in every)]
        got = [[k for k, n in f for _ in range(n)] for f in packing.fillings(counts, room)]
        assert sorted(got) == sorted(want)
        waste = [room - sum(f) for f in got]
        assert waste == sorted(waste)


def test_pack_with_small_buckets(spark):
    rng = random.Random(9)
    rows = [(i % 97, i // 97, rng.choice([1, 3, 3, 3, 5, 7]), 1) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, __x int")
    got = packing.pack(df, 10, per_bucket=20).collect()
    assert sorted((r.doc_id, r.piece, r.length, r["__x"]) for r in got) == sorted(rows)
    taken = {}
    for r in got:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in taken.values():
        ends = list(itertools.accumulate(n for _, n in sorted(x)))
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 10
    counts = {k: sum(r[2] == k for r in rows) for k in (1, 3, 5, 7)}
    assert len(taken) == sum(n for n, _ in packing.complete(counts, 10))


def test_search_beats_best_fit():
    counts = {6: 2, 5: 1, 4: 1, 3: 3}  # capacity 10: 6+4, 6+... best-fit wastes
    assert check(packing.complete(counts, 10), counts, 10) == optimum([6, 6, 5, 4, 3, 3, 3], 10)


def test_large_counts_reach_the_bound():
    rng = random.Random(1)
    counts = {k: rng.randint(0, 5000) for k in range(1, 2049)}
    assert check(packing.complete(counts, 2048), counts, 2048) - packing.bound(counts, 2048) <= 2


def test_thousands_of_pieces_of_few_lengths():
    assert check(packing.complete({700: 3000}, 2048), {700: 3000}, 2048) == 1500
    for counts in ({700: 30000, 690: 7}, {900: 4000, 700: 5001, 300: 2500}):
        assert check(packing.complete(counts, 2048), counts, 2048) <= sum(n for n, _ in packing.best_fit(counts, 2048))


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "wort " * rng.choice([1, 5, 70, 300, 3000])) for i in range(120)] + [(500 + i, "the same text again") for i in range(300)] + [(7, "wort"), (7, "wort"), (None, "x"), (1000, None), (1001, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.manifest(docs, public_tokenizers.path("word_bpe_49k.json"), 256).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, a // 256, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for a in range(0, len(ids), 256)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) - -(-sum(r.length for r in got) // 256) <= 2


def test_pack_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.manifest(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert common.WORD
