"""Token counts, quality, decontamination and the pipeline against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from iotrail.llm import common, counts, decontaminate, neardup, packing, quality

from .test_links import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng, n=5):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))


def test_token_counts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(word(rng) for _ in range(rng.randint(0, 40))), rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", None]), 1) for i in range(60)] + [(99, None, "en", "a", 1)]
    ledger = common.materialise(counts.count_tokens(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("byte_bpe_50k.json"), "v1"), "t")
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r[0]: len(tokens.encode(r[1] or "").ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in ledger.collect()} == n
    rollup = counts.Rollup(spark, common.work_path(spark, "t"))
    assert rollup.totals().count() == 0
    rollup.commit("1", counts.insert(ledger))
    gone = ledger.where("doc_id < 20")
    for _ in range(2):
        rollup.commit("2", counts.delete(gone))
    left = ledger.where("doc_id >= 20")
    rollup.commit("3", counts.revise(left.where("doc_id < 30"), left.where("doc_id < 30").withColumn("n_tokens", F.col("n_tokens") * 2)))
    rollup.commit("4", counts.insert(ledger.limit(0)))

    def want():
        out = {}
        for r in rows:
            if r[0] >= 20:
                d, t = out.get((r[3], r[2], "v1"), (0, 0))
                out[r[3], r[2], "v1"] = (d + 1, t + n[r[0]] * (2 if r[0] < 30 else 1))
        return out

    got = lambda: {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert got() == want()
    rollup.compact("s1")
    assert got() == want() and len(rollup.batches()) == 1
    rollup.commit("2", counts.delete(gone))  # folded: counted already
    assert got() == want()
    with pytest.raises(AssertionError):
        rollup.commit("5", counts.delete(left))
        assert got() == want()


def test_token_counts_after_crashes(spark, monkeypatch):
    """Whatever write fails, totals are those before or after, and the same call again gives those after."""
    rollup = counts.Rollup(spark, common.work_path(spark, "t"))
    rows = lambda n: spark.createDataFrame([("a", None, "v", n, 10 * n)], counts.DELTA)
    total = lambda: [tuple(r) for r in rollup.totals().collect()]
    rollup.commit("1", rows(1))
    rollup.commit("2", rows(2))
    for call, after in ((lambda: rollup.commit("3", rows(3)), 6), (lambda: rollup.compact("s"), 6)):
        before = total()
        for fail_at in (0, 1):

            def publish(self, name, parts, fail_at=fail_at):
                for part in list(parts)[:fail_at]:
                    parts[part].write.parquet(f"{self.path}/.{name}-x{fail_at}/{part}")
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(counts.Rollup, "_publish", publish)
                with pytest.raises(RuntimeError):
                    call()
            assert total() == before
        call()
        assert total() == [("a", None, "v", after, 10 * after)]
        call()
        assert total() == [("a", None, "v", after, 10 * after)]
    rollup.commit("4", rows(4))
    assert rollup.batches() == ["batch=4", "snapshot=s"] and total() == [("a", None, "v", 10, 100)]


def test_op3_query_against_a_plain_count(spark):
    data = "/root/testdata/sf0.001"
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect():
        first.setdefault(r.text or "", r)
    want = {}
    for text, r in first.items():
        d, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = d + 1, t + len(tokens.encode(text, add_special_tokens=False).ids) + 1
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in counts.op3_token_counts(spark, data).collect()} == want



def test_token_counts_with_null_ids(spark, tmp_path):
    rows = [(None, "one two three", "en", "a", 1), (None, "four five", "en", "a", 1), (None, "four five", "en", "a", 1), (1, "one two three", "en", "a", 1), (2, "six", "en", "a", 1), (2, "six", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = [(r.documents, r.tokens) for r in counts.op3_token_counts(spark, str(tmp_path)).collect()]
    assert got == [(3, sum(len(tokens.encode(t).ids) + 1 for t in ("one two three", "four five", "six")))]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_keep_one_of_rows_without_an_id_of_their_own(spark, most):
    text = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    rows = [(1, text[0]), (1, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (3, text[2]), (2, text[2]), (None, None), (9, "")]
    got = [(r.doc_id, r.text) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most).collect()]
    assert sorted(got, key=str) == sorted([(1, text[0]), (None, text[1]), (2, text[2]), (None, None), (9, "")], key=str)


def test_stage_and_query_decide_alike(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * i, "en", "s", i) for i in range(1, 11)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(quality, "apply", lambda docs, trees: docs.withColumn("score", F.col("doc_id") / 10))
    good = {r.doc_id for r in quality.op6_quality(spark, str(tmp_path)).where("predicted = 1").collect()}
    assert good == {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()} == {7, 8, 9, 10}


def test_quality_of_documents_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, "some words"), (1, None), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.held_out for r in quality.op6_quality(spark, str(tmp_path)).collect()}
    assert got == {None: False, 1: zlib.crc32(b"1") % 4 == 2, 2: zlib.crc32(b"2") % 4 == 2}


def quality_rows(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = [word(rng, rng.randint(2, 9)) for _ in range(rng.randint(20, 80))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "en", "s", len(text), int(good)))
    return rows


def test_quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(None, None, None, None, 0), (5000, "", "en", "s", 0), (5001, "y" * 300000, "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels, trees=20)
    scored = {r.doc_id: r.score for r in quality.apply(docs, trees).collect()}
    held = {r.doc_id for r in docs.where(quality.fold(F.col("doc_id")) == 2).collect()}
    right = [(scored[r[0]] >= 0.5) == bool(r[5]) for r in rows if r[0] in held]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert len(scored) == len(rows) + 3 and all(0 <= s <= 1 for s in scored.values())
    again = quality.train(docs.repartition(7), labels.repartition(3), trees=20)
    assert (again.leaf == trees.leaf).all() and (again.feature == trees.feature).all()
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.apply(docs, none).collect()} == {0.5}
    assert quality.apply(docs.limit(0), trees).count() == 0


def test_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, quality.N_STATS)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = quality.fit(x, y, trees=15)

    def one(row):
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    got = t.score(x)
    assert np.allclose(got, [one(r) for r in x])
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.95


def plain_alignment(item, text, cost):
    best, above = 0.0, [0.0] * (len(text) + 1)
    for a in item:
        row = [0.0]
        for j, b in enumerate(text):
            row.append(max(0.0, above[j] + (1.0 if a == b else -cost), above[j + 1] - cost, row[j] - cost))
        best, above = max(best, *row), row
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, text = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))
        assert decontaminate.align(item, text, 0.5)[0] == pytest.approx(plain_alignment(item.tolist(), text.tolist(), 0.5))


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_decontamination(spark, block):
    rng = random.Random(5)
    texts = [[word(rng) for _ in range(rng.randint(15, 60))] for _ in range(12)]
    fill = lambda n: [word(rng) for _ in range(n)]
    docs, want = [], {}
    for i in range(60):
        words = fill(rng.randint(10, 300))
        if i % 3 == 0:
            k = rng.randrange(len(texts))
            copy = [w if rng.random() > 0.1 else word(rng) for w in texts[k]] if i % 2 else [w.capitalize() + "," for w in texts[k]]
            at = rng.randint(0, len(words))
            words[at:at] = copy
            want[i] = k
        docs.append((i, " ".join(words), "en", "s", 0))
    docs += [(100, None, None, None, 0), (101, "", None, None, 0), (102, " ".join(texts[0][: len(texts[0]) // 4]), None, None, 0), (103, " ".join(texts[1]) + " " + "z " * 50000, None, None, 0)]
    want[103] = 1
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    items = spark.createDataFrame([(k, " ".join(t), 1) for k, t in enumerate(texts)] + [(50, None, 1), (51, "", 1), (52, "a b", 1)], "item_id long, text string, score int")
    got = decontaminate.find(df, items, block=block).collect()
    assert {r.doc_id: r.item_id for r in got} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(df, items, block=block).collect()} == {d[0] for d in docs} - set(want)
    assert decontaminate.find(df, items.limit(0)).count() == 0 and decontaminate.find(df.limit(0), items).count() == 0


def test_decontamination_of_frequent_passages(spark):
    rng = random.Random(11)
    one, other = ([word(rng) for _ in range(40)] for _ in range(2))
    edited = [word(rng) if k % 5 == 4 else w for k, w in enumerate(one)]
    fill = lambda: [word(rng) for _ in range(30)]
    docs = [(i, " ".join(fill() + (edited if i < 300 else other[:20]) + fill()), "en", "s", 0) for i in range(600)] + [(900, " ".join(fill()), "en", "s", 0)]
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find(spark.createDataFrame(docs, SCHEMA), items).collect()}
    assert set(got) == {(i, 1 if i < 300 else 2) for i in range(600)}
    assert got[0, 1] == pytest.approx((32 - 0.5 * 7) / 40) and got[300, 2] == pytest.approx(0.5)


def alignment_with_start(item, text, cost):
    """Best local alignment by the plain recurrence: sum and all (start, end) that reach it."""
    cell = {}
    for i in range(len(item) + 1):
        for j in range(len(text) + 1):
            ways = [(0.0, {j})]
            if i and j:
                ways += [(cell[i - 1, j - 1][0] + (1.0 if item[i - 1] == text[j - 1] else -cost), cell[i - 1, j - 1][1])]
            if i:
                ways += [(cell[i - 1, j][0] - cost, cell[i - 1, j][1])]
            if j:
                ways += [(cell[i, j - 1][0] - cost, cell[i, j - 1][1])]
            top = max(w[0] for w in ways)
            cell[i, j] = top, set().union(*(w[1] for w in ways if w[0] > top - 1e-9))
    best = max(c[0] for c in cell.values())
    return best, {(s, j) for (_, j), c in cell.items() if c[0] > best - 1e-9 for s in c[1]}


@pytest.mark.parametrize("block", [30, 1_000_000])
def test_decontamination_against_all_pairs(spark, block):
    """Every document with every item: reported if they share an n-gram and align well enough, and only then."""
    rng = random.Random(21)
    few = [word(rng, 3) for _ in range(40)]  # few words, so hits by chance are many
    items = [[rng.choice(few) for _ in range(rng.randint(1, 14))] for _ in range(14)] + [[f"w{k}" for k in range(10)]]
    docs = [[rng.choice(few) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    for k in range(60):
        copy = [w for w in rng.choice(items) if rng.random() > 0.1]
        copy = [w if rng.random() > 0.25 else rng.choice(few) for w in copy]
        docs.append(docs[k % 40][:7] + copy + docs[k % 40][7:])
    docs.append("w0 w1 w2 x w4 w5 x w7 w8 x".split())  # one seed only
    docs += [docs[-1], items[3] + ["z"]]
    rows = [(i, " ".join(d), "en", "s", 0) for i, d in enumerate(docs)]
    rows[-2] = rows[-3]  # a row that repeats another
    rows[-1] = (None, *rows[-1][1:])
    want, spans = {}, {}
    for r, d in zip(rows, docs):
        for k, t in enumerate(items):
            size = min(3, len(t))
            if {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} & {tuple(d[i : i + size]) for i in range(len(d) - size + 1)}:
                total, where = alignment_with_start(t, d, 0.5)
                if total / len(t) >= 0.5 - 1e-12:
                    want.setdefault((r[0], k), []).append(round(total / len(t), 9))
                    spans[r[0], k] = where
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t), 1) for k, t in enumerate(items)], "item_id long, text string, score int")
    got = {}
    for r in decontaminate.find(df, bench, block=block).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(round(r.score, 9))
        assert (r.start, r.end) in spans[r.doc_id, r.item_id]
    assert got == want and len(got[100, 14]) == 2 and got[100, 14][0] == 0.6
    left = sorted((r.text for r in decontaminate.drop_leaks(df, bench, block=block).collect()))
    leaking = {d for d, _ in want}
    assert left == sorted(r[1] for r in rows if r[0] not in leaking) and None in leaking


def test_word_edges():
    a, n = decontaminate.word_ids(pa.array(['"Hello," (world).', "hello world", "...", ""]))
    assert n.tolist() == [2, 2, 1, 0] and a[:2].tolist() == a[2:4].tolist()


def test_pipeline_stages(spark, tmp_path):
    rows = quality_rows(240)
    rng = random.Random(8)
    item = [word(rng) for _ in range(30)]
    clean = [r for r in rows if r[5]]
    extra = [(1000 + i, r[1] + " " + word(rng), "en", "s", 0) for i, r in enumerate(clean[:5])] + [(1100, clean[20][1] + " " + " ".join(item), "en", "s", 0), (1101, clean[30][1] + " token = abcdef0123456789", "en", "s", 0), (1102, None, None, None, None)]
    docs = spark.createDataFrame([r[:5] for r in rows] + extra, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialise(stage(spark, now, str(tmp_path)), "t")
        assert now.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in now.collect()})
    bad = {r[0] for r in rows if not r[5]}
    assert not bad & set(kept[0]) and {r[0] for r in clean} <= set(kept[0])
    sets = {i: shingles(t, 5) for i, t in kept[0].items()}
    for i in range(1000, 1005):
        a, b = sets[i], sets[clean[i - 1000][0]]
        assert (i in kept[1]) == (len(a & b) < 0.8 * len(a | b))
    assert set(kept[1]) - set(kept[2]) == {1100} & set(kept[1]) != set()
    assert kept[3].keys() == kept[2].keys() and (1101 not in kept[3] or "abcdef0123456789" not in kept[3][1101])
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(kept[3])
    assert packing.bound({}, 10) == 0
