import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from iotrail.llm import common, token_output

ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nnew  line \n x", "it's  we'll 12 345", "\x1c x \x1cy", "é" * 5 + " ß z", "<|endoftext|> a", "x" * 5000, "ab " * 3000, " ́a b́ c", "İ Σ ΑΣ Ⅷ", "don't stop.\n\n Yes;   no!\t(a+b) ÉTÉ ª²½ ¿qué? Weiß 12,5", "a.\nB c\n", " ".join("w%d." % i for i in range(3000)), None]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    texts = [t or "" for t in ODD]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    ids, n = common.PieceEncoder(public_tokenizers.path(name)).encode(texts, 0)
    assert n.tolist() == list(map(len, want))
    assert ids.tolist() == sum(want, [])


def test_round_trip(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "again", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(3)
    path = common.work_path(spark, "t")
    token_output.write(token_output.encode(docs, public_tokenizers.path("byte_bpe_50k.json")), path)
    got = token_output.with_crc(token_output.read(spark, path)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = common.work_path(spark, "t")
    token_output.write(token_output.encode(docs, public_tokenizers.path("byte_bpe_50k.json")), path)
    assert token_output.with_crc(token_output.read(spark, path)).count() == 0


def test_forgetting_changes_nothing():
    few = common.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=50, most_ids=200)
    many = common.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"alpha beta{i} gamma{i % 7} delta." for i in range(300)]
    for a in range(0, 300, 20):
        assert few.encode(texts[a : a + 20])[0].tolist() == many.encode(texts[a : a + 20])[0].tolist()
    assert len(few.known) < 200


def test_selective_reads(spark):
    """Encodings, row groups and page indexes are there, and reads reach only what they ask for."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"some words of document {i} " * 40) for i in range(3000)], "doc_id long, text string")
    path = common.work_path(spark, "t")
    token_output.write(token_output.encode(docs, public_tokenizers.path("byte_bpe_50k.json")), path, row_group_mb=1, page_kb=16, page_rows=100)
    files = sorted(glob.glob(path.removeprefix("file:") + "/*.parquet"))
    last = None
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings and columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings or "RLE_DICTIONARY" in columns["local_start"].encodings
            low, high = columns["doc_id"].statistics.min, columns["doc_id"].statistics.max
            assert last is None or low > last
            last = high
    some = token_output.read_tokens(spark, path, 100, 120)
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "LessThanOrEqual(doc_id,120)" in plan
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 121))
    counts = token_output.read_counts(spark, path)
    assert "ids" not in counts._jdf.queryExecution().toString().rsplit("ReadSchema", 1)[-1]
    assert {r.doc_id: r.n_tokens for r in counts.where("doc_id < 5").collect()} == {r.doc_id: len(r.ids) for r in token_output.read_tokens(spark, path, 0, 4).collect()}


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    """A file whose pre-tokenizer isn't known here gives the library's own ids."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import pre_tokenizers

    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    plain.save(str(tmp_path / "t.json"))
    texts = [t or "" for t in ODD]
    ids, n = common.PieceEncoder(str(tmp_path / "t.json")).encode(texts, 0)
    assert ids.tolist() == sum([[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts], [])
