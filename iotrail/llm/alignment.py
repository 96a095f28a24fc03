"""Operator 13: tokens of two tokenizers aligned by the bytes that they cover.

Divide and conquer at shared cuts: in each stretch of a text, an end of an A token near the middle that is also the end
of a B token (found by bisection) cuts it in two, and both halves go on; a stretch without such an end is a group.
All stretches of a batch of texts are divided together, level by level. An A and a B token are linked where their
bytes overlap; each link is one occurrence of a pair of ids.

Counts of pairs need no row for each document and pair in a shuffle: a task writes its documents in blocks of about
`block` pairs with one line that has the block's distinct pairs and in how many of its documents each is. Corpus
counts are sums of these lines, a block asks for each of its pairs once, and its documents are then summed up together.
Blocks are written once, so retried tasks agree.

Texts that are null, empty, or that either tokenizer can't give back byte by byte (with a space before) have no tokens:
zeros and ''. Strings of special tokens in a text are plain text. Repeated rows and rows without a doc_id each
count as a document and get their answer. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SYMBOL, PieceEncoder, list_array, materialise, slices, table, texts_of

BLANK = "▁"


class Entries:
    """The bytes of each id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        till = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - till + n, n) + np.arange(till[-1] if len(till) else 0)]


class ByteLevel:
    """Ids of a tokenizers file for a space and the text."""

    def __init__(self, path: str):
        self.encoder = PieceEncoder(path, plain=True)
        byte = {chr(_SYMBOL.get(b, b)): b for b in range(256)}
        names = {k: name for name, k in self.encoder.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.vocab_size = max(names, default=0) + 1
        self.entries = Entries([bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in (names.get(k, "") for k in range(self.vocab_size))])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        closed, n = self.encoder.encode([" " + t for t in texts])
        keep = np.ones(len(closed), bool)
        keep[np.cumsum(n) - 1] = False
        return closed[keep], n - 1


class Pieces(PieceEncoder):
    """Ids of a sentencepiece file for a text, to which it adds a space. If no piece has a space behind another
    character, no merge goes over the begin of a space after a character; words are then encoded one by one, each distinct
    one once. Otherwise texts go through the library whole."""

    def __init__(self, path: str, most: int = 400_000, most_ids: int = 2_000_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab_size = self.library.get_piece_size()
        names = [self.library.id_to_piece(k) for k in range(self.vocab_size)]
        byte = [self.library.is_byte(k) for k in range(self.vocab_size)]
        self.entries = Entries([bytes([int(s[3:5], 16)]) if b else s.replace(BLANK, " ").encode() for s, b in zip(names, byte)])
        probe = "  a  b éﬁ① \t x  "
        same = self.entries.joined(np.array(self.library.encode(probe), np.int64)).tobytes() == f" {probe}".encode()
        self.blank = self.library.piece_to_id(BLANK)
        self.apart = same and names[self.blank] == BLANK and not any(BLANK in s.lstrip(BLANK) for s, b in zip(names, byte) if not b)
        self.most, self.most_ids = most, most_ids
        self._clear()

    @staticmethod
    def cut(text: str) -> list[str]:
        """Runs of blanks with the word behind, less the first blank, which the library adds."""
        words = text.replace(BLANK, " ").split(" ")
        if "" not in words:
            return words
        if not text:
            return []
        out, blanks = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * blanks + w)
                blanks = 0
            else:
                blanks += 1
        out.append(" " * blanks + words[-1])
        return out

    def _learn(self) -> None:
        new, self.known.fresh = self.known.fresh, []
        if new:
            some = [ids or [self.blank] for ids in self.library.encode(new, num_threads=1)]  # the last of a text may be a blank alone
            self._add(np.array([k for ids in some for k in ids], np.int32), np.fromiter(map(len, some), np.int64, len(some)))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.apart:
            return self._pieced(texts)
        some = self.library.encode(texts, num_threads=1)
        return np.array([k for ids in some for k in ids], np.int32), np.fromiter(map(len, some), np.int64, len(some))


def divide(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [a0, a1) x [b0, b1) of tokens, each ending at one byte for both -> the groups that they consist of, in
    order. ends_a and ends_b ascend over all stretches."""
    done, near = [], np.maximum(len(ends_b) - 1, 0)
    while len(a0):
        middle = (a0 + a1) // 2 - 1
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        live, begun, wide = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1)), 0, 1
        while len(live):  # ends ever farther from the middle, twice as many each time
            off = np.arange(begun, begun + wide)
            at = middle[live][:, None] + np.stack([off, -off], 1).ravel()[None, :]
            inside = (at >= a0[live][:, None]) & (at < a1[live][:, None] - 1)
            at = np.where(inside, at, a0[live][:, None])
            found = np.searchsorted(ends_b, ends_a[at])
            hit = inside & (ends_b[np.minimum(found, near)] == ends_a[at])
            first, some, row = hit.argmax(1), hit.any(1), np.arange(len(live))
            cut_a[live[some]], cut_b[live[some]] = at[row, first][some], found[row, first][some]
            begun, wide = begun + wide, wide * 2
            left = live[~some]
            live = left[np.maximum(middle[left] - a0[left], a1[left] - 2 - middle[left]) >= begun]
        leaf, cut = cut_a < 0, cut_a >= 0
        done.append((a0[leaf], a1[leaf], b0[leaf], b1[leaf]))
        i, j = cut_a[cut] + 1, cut_b[cut] + 1
        a0, a1 = np.concatenate([a0[cut], i]), np.concatenate([i, a1[cut]])
        b0, b1 = np.concatenate([b0[cut], j]), np.concatenate([j, b1[cut]])
    parts = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 4
    order = np.argsort(parts[0], kind="stable")
    return tuple(p[order] for p in parts)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        # What is written for an id: with the next one of its group, and as the last one.
        self.names = [f"{k}{s}".encode() for s in ",|" for k in range(self.a.vocab_size)] + [f"{k}{s}".encode() for s in ",;" for k in range(self.b.vocab_size)]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and B of all texts with tokens, numbers of each text's tokens (0 for the others)."""
        want = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        good = want > 1
        sides = []
        for side in (self.a, self.b):
            ids, n = side.numbers(texts)
            owner = np.repeat(np.arange(len(texts)), n)
            good &= np.bincount(owner, side.entries.lengths[ids], len(texts)).astype(np.int64) == want
            sides.append((side, ids, owner))
        real = np.frombuffer("".join(" " + t for t, g in zip(texts, good) if g).encode(), np.uint8)
        of = np.repeat(np.flatnonzero(good), want[good])
        for side, ids, owner in sides:
            wrong = of[side.entries.joined(ids[good[owner]]) != real]
            good[wrong] = False
            keep = ~np.isin(of, wrong)
            real, of = real[keep], of[keep]
        out = []
        for _, ids, owner in sides:
            keep = good[owner]
            out += [ids[keep].astype(np.int64), np.bincount(owner[keep], minlength=len(texts))]
        return out[0], out[2], out[1], out[3]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, and distinct pairs (a * size of B + b) with how often."""
        ids_a, ids_b, n_a, n_b = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.a.entries.lengths[ids_a]), np.cumsum(self.b.entries.lengths[ids_b])
        till_a, till_b, some = np.cumsum(n_a), np.cumsum(n_b), n_a > 0
        a0, a1, b0, b1 = divide(ends_a, ends_b, (till_a - n_a)[some], till_a[some], (till_b - n_b)[some], till_b[some])
        owner_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(owner_a[a0], minlength=len(texts))

        # Groups as text: the A tokens of a group, then its B tokens.
        group_a, group_b = np.repeat(np.arange(len(a0)), a1 - a0), np.repeat(np.arange(len(a0)), b1 - b0)
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[a1 - 1], last_b[b1 - 1] = True, True
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + b0[group_a]] = ids_a + self.a.vocab_size * last_a
        code[np.arange(len(ids_b)) + a1[group_b]] = 2 * self.a.vocab_size + ids_b + self.b.vocab_size * last_b
        written, digests, at = list(map(self.names.__getitem__, code.tolist())), [], 0
        for n in (n_a + n_b).tolist():
            digests.append(hashlib.sha256(b"".join(written[at : at + n])[:-1]).hexdigest() if n else "")
            at += n

        # Links: the B tokens from the one that holds an A token's first byte to the one that holds its last.
        low = np.searchsorted(ends_b, ends_a - self.a.entries.lengths[ids_a], side="right")
        many = np.searchsorted(ends_b, ends_a, side="left") - low + 1
        till = np.cumsum(many)
        to = np.repeat(low - till + many, many) + np.arange(till[-1] if len(till) else 0)
        owner = np.repeat(owner_a, many)
        top = self.a.vocab_size * self.b.vocab_size
        key = np.sort(owner * top + np.repeat(ids_a, many) * self.b.vocab_size + ids_b[to])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(owner, minlength=len(texts)), "groups_sha256": digests,
            "pairs": key[first] % top, "times": np.diff(np.append(first, len(key))), "n_pairs": np.bincount(key[first] // top, minlength=len(texts)),
        }


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = f"block long, summary boolean, doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, pairs array<long>, times array<int>"


def blocks(docs: DataFrame, path_a: str, path_b: str, block: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> BLOCKS: a row a document, and after each block of them its summary, whose `times` has in how
    many documents of the block each pair is."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def summary() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            one = lambda values, kind: list_array(values, np.array([len(values)]), kind)
            nothing = [pa.nulls(1, pa.int64())] * (1 + len(NUMBERS))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([True]), *nothing, pa.nulls(1, pa.string()), one(pairs, pa.int64()), one(n, pa.int32())], names=names)

        for whole in batches:
            for b in slices(whole, "text") if whole.num_rows else ():
                x = aligner(path_a, path_b).align(b.column("text").to_pylist())
                lists = [list_array(x[c], x["n_pairs"], kind) for c, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
                fixed = [pa.array(np.full(b.num_rows, number)), pa.array(np.zeros(b.num_rows, bool)), b.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x[c].astype(np.int64)) for c in NUMBERS), pa.array(x["groups_sha256"]), *lists], names=names)
                held.append(x["pairs"])
                if sum(map(len, held)) >= block:
                    yield summary()
                    number, held = number + 1, []
        if held:
            yield summary()

    return texts_of(docs).mapInArrow(run, BLOCKS)


OUT = f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a block with the corpus counts of its pairs."""
    known = known.sort_by("pair")
    pair, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
    lists = docs.column("pairs").combine_chunks()
    at = np.searchsorted(pair, lists.flatten().to_numpy())
    times = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    till = np.cumsum(pc.list_value_length(lists).to_numpy())
    per = lambda values: np.diff(np.append(0, np.cumsum(values))[till], prepend=0).astype(np.int64)
    sums = {"n_best": per(times * best[at]), "count_sum": per(times * n[at])}
    return pa.table({c: sums.get(c, docs.column(c) if c not in sums else None) for c in (x.split()[0] for x in OUT.split(", "))})


def align(docs: DataFrame, path_a: str, path_b: str, block: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text) -> OUT, a row a document."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = materialise(blocks(docs, path_a, path_b, block), "aligned", compression="zstd")
    lines = rows.where("summary").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.times").alias("docs"))
    counts = materialise(lines.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / size)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = lines.select(F.col("block").alias("at"), "pair").join(known, "pair")
    return rows.where("not summary").drop("summary").groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(_summed, OUT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
