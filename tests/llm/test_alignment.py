import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from iotrail.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nnew  line \n x", "it's  we'll 12 345", "\x1c x \x1cy", "é" * 5 + " ß z", "<|endoftext|> <s> a</s>", "x" * 5000, "ab " * 3000, "▁ is a mark", "a▁b", "日本語のテキスト", "ﬁ ① Å x́", "\x00 zero \x00", "nb\xa0sp　x", "🙂🙃 ok", None, "same text", "same text"]


def spans(plain, library, text):
    """Token (id, begin, end) of both sides, by the libraries on whole texts; None if bytes differ."""
    byte = {chr(alignment._SYMBOL.get(b, b)): b for b in range(256)}
    want = (" " + text).encode()
    sides = []
    left = [(k, bytes(byte[c] for c in plain.id_to_token(k))) for k in plain.encode(" " + text, add_special_tokens=False).ids]
    right = [(k, bytes([int(library.id_to_piece(k)[3:5], 16)]) if library.is_byte(k) else library.id_to_piece(k).replace("▁", " ").encode()) for k in library.encode(text)]
    for side in (left, right):
        if not text or b"".join(x for _, x in side) != want:
            return None
        at, out = 0, []
        for k, x in side:
            out.append((k, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return sides


def brute(texts):
    plain, library = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    plain.encode_special_tokens = True
    found, corpus = [], Counter()
    for text in texts:
        both = spans(plain, library, text or "")
        if both is None:
            found.append(None)
            continue
        left, right = both
        links, j = [], 0
        for k, lo, hi in left:
            while right[j][2] <= lo:
                j += 1
            i = j
            while i < len(right) and right[i][1] < hi:
                links.append((k, right[i][0]))
                i += 1
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        group = lambda side, lo, hi: ",".join(str(k) for k, a, b in side if lo <= a and b <= hi)
        if len(left) < 2000:
            said = ";".join(f"{group(left, lo, hi)}|{group(right, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        else:
            said = None
        found.append((len(left), len(right), len(cuts), links, said))
        corpus.update(set(links))
    best = Counter()
    for (a, _), n in corpus.items():
        best[a] = max(best[a], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, said = x
            out.append((n_a, n_b, n_groups, len(links), sum(corpus[p] == best[p[0]] for p in links), sum(corpus[p] for p in links), said and hashlib.sha256(said.encode()).hexdigest()))
    return out


def check(spark, texts, block):
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, block int").repartition(3)
    got = {r.doc_id: tuple(r[1:]) for r in alignment.align(docs, A, B, block).select("doc_id", *alignment.NUMBERS, "n_best", "count_sum", "groups_sha256").collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k][:6] == w[:6], texts[k]
        assert w[6] is None or got[k][6] == w[6]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_texts_equal_brute_force(spark, block):
    check(spark, ODD, block)


def test_documents_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(spark, texts, 2000)


def test_query(spark):
    from iotrail.llm import entry

    got = entry.queries()["op13_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    whole = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_links") != F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("odd"), F.count_if(F.col("n_best") > F.col("n_links")).alias("over")).first()
    assert tuple(whole) == (200, 0, 0)


def test_rows_without_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b")], "doc_id long, text string")
    got = alignment.align(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in got) == [(0, 6), (0, 6), (7, 6)]
    assert alignment.align(docs.limit(0), A, B).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .,\n\té▁日1'"), max_size=40), min_size=1, max_size=6))
def test_pieces_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = alignment.aligner(A, B).b
    assert pieces.apart
    texts = [t for t in texts if t]
    ids, n = pieces.numbers(texts)
    assert n.tolist() == [len(x) for x in library.encode(texts)] and ids.tolist() == sum(library.encode(texts), [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.lists(st.integers(1, 6), min_size=1, max_size=40)), min_size=1, max_size=5))
def test_divide_finds_every_shared_end(pairs):
    """Random lengths: groups end at all common ends and nowhere else."""
    ends, starts, base = ([], []), ([], []), 0
    want = []
    for left, right in pairs:
        short = sum(left) - sum(right)
        left, right = (left, [*right, short]) if short > 0 else ([*left, -short], right) if short < 0 else (left, right)
        both = [np.cumsum(x) + base for x in (left, right)]
        for k in (0, 1):
            starts[k].append(sum(map(len, ends[k])))
            ends[k].append(both[k])
        want += sorted(set(both[0].tolist()) & set(both[1].tolist()))
        base += sum(left)
    a, b = (np.concatenate(x) for x in ends)
    a0, b0 = (np.array(s) for s in starts)
    ga0, ga1, gb0, gb1 = alignment.divide(a, b, a0, np.append(a0[1:], len(a)), b0, np.append(b0[1:], len(b)))
    assert a[ga1 - 1].tolist() == want and b[gb1 - 1].tolist() == want
    assert ga0.tolist() == [0, *ga1[:-1].tolist()] and gb0.tolist() == [0, *gb1[:-1].tolist()]


def test_long_stretch_without_shared_end():
    """100,000 ends of which none is common, with common ones far to one side."""
    n = 100_000
    a, b = np.arange(2, 2 * n + 2, 2), np.arange(3, 2 * n + 3, 2)
    a, b = np.concatenate([[1], a + 1, [2 * n + 5]]), np.concatenate([[1], b + 1, [2 * n + 5]])
    _, a1, _, _ = alignment.divide(a, b, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]))
    assert a1.tolist() == [1, len(a)]
