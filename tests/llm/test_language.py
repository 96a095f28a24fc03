import numpy as np
import pytest
from pyspark.sql import functions as F

from iotrail.llm import entry, language
from iotrail.llm.quality import fold

WORDS = {"aa": "zorbal kendra mipolu taro", "bb": "schlüft würgen ängst bläue", "cc": "привет словам нового мира"}


def documents(spark, each=40):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for lang, words in WORDS.items():
        for _ in range(each):
            rows.append((k, " ".join(rng.choice(words.split(), 12)), lang, "x"))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def test_grams_equal_plain_python():
    texts = ["Ab cde, f", "", "1 2", "É\0x yz", "İs"]
    h, owner, letters = language.grams(texts)
    want = []
    for k, t in enumerate(texts):
        marked = "\0" + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
        for size in language.SIZES:
            want += [(k, marked[p : p + size]) for p in range(len(marked) - size + 1) if "\0" not in marked[p + 1 : p + size - 1]]
    assert sorted(owner.tolist()) == sorted(k for k, _ in want)
    assert len(set(h.tolist())) == len({g for _, g in want})
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]


def test_filters_hold_what_was_put_in():
    """No gram of a language is missed, false finds are as frequent as reckoned, and 130 languages fit three words."""
    rng = np.random.default_rng(1)
    n, bits = 130, 12
    masks = np.zeros((1 << bits, 3), np.uint64)
    sets = [rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(n)]
    for k, s in enumerate(sets):
        for p in language._places(s, bits):
            masks[p, k // 64] |= np.uint64(1 << (k % 64))
    full = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(n)])
    f = language.Filters([f"{k:03}" for k in range(n)], 0, masks, full**language.PROBES)
    bit = lambda found, k: (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
    for k in (0, 63, 64, 129):
        assert bit(f.languages(sets[k]), k).all()
        new = f.languages(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
        assert bit(new, k).mean() == pytest.approx(f.false[k], abs=0.003)


def test_held_out_accuracy(spark):
    docs = documents(spark)
    got = language.predict(docs, language.train(docs)).where(fold(F.col("doc_id")) == 2)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert got.where("lang <> lang_pred").count() == 0 and got.count() > 10


def test_odd_texts(spark):
    filters = language.train(documents(spark))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "日"), (5, "schlüft " * 20000), (5, "schlüft"), (None, "Привет")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in language.predict(odd, filters).collect())
    assert got == [(0, "cc", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, filters.names[filters.prior], False), (5, "bb", True), (5, "bb", True)]
    assert language.predict(odd.limit(0), filters).collect() == []


def test_nothing_to_learn_from(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    got = language.predict(docs, language.train(docs))
    assert got.where("lang_pred = 'und' and score = 0").count() == docs.count()


def test_held_out_rows_are_not_learnt_from(spark):
    """Changing the lang of held-out rows, or of rows without an id, changes no prediction."""
    docs = documents(spark)
    other = docs.withColumn("lang", F.when(fold(F.col("doc_id")) == 2, "zz").otherwise(F.col("lang"))).unionByName(docs.limit(50).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("yy")))
    a, b = language.train(docs), language.train(other)
    assert a.names == b.names and (a.masks == b.masks).all()


def test_copies_count_once(spark):
    docs = documents(spark)
    copies = docs.limit(1).select(F.explode(F.sequence(F.lit(10_000), F.lit(10_400))).alias("doc_id"), "text", "lang", "score")
    assert (language.train(docs.unionByName(copies)).masks == language.train(docs).masks).all()


def test_query(spark):
    got = entry.queries()["op12_language"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200 and sum(r.lang == r.lang_pred for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)
