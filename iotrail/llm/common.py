"""Helpers shared by the operators of this subpackage: Arrow batches, tokenising in tasks."""

from __future__ import annotations

import itertools
import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import forget, materialise, work_path

__all__ = ["forget", "materialise", "work_path", "table", "texts_of", "slices", "list_array", "encoder", "PieceEncoder", "WORD"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of 8 MB at most, as rows of whole texts are large; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB", "64m"):  # the default
        spark.conf.set(key, most)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts as empty ones. Only these two columns are read."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cuts an Arrow batch so that each slice holds about `most` bytes of a string column."""
    sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)[batch.column(column).offset:][: batch.num_rows + 1])
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters are cut into pre-tokens here, by the two vocabularies' own rules.
_LATIN = re.compile("[\t-\r\x20-\x7e\xa1-\xff]*")
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: In other texts, a single space between two characters that no pre-tokeniser counts as white space
#: is always a border between two pre-tokens.
_CUT = re.compile(r"(?<=[^\s\x00-\x20])(?= [^\s\x00-\x20])")
# Byte-level vocabularies write a byte as the character of its number where that is printable, and the others
# in ascending order from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SYMBOL = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _PRINTABLE))}

_SPACE, _WHOLE = chr(_SYMBOL[32]), "\0"


def _as_symbols(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_SYMBOL)


def byte_level_pieces(text: str) -> list[str]:
    """Substrings whose ids, one after another, are those of the text: a vocabulary that keeps white space.

    Those of texts that are not Latin are marked, as they can hold several pre-tokens.
    """
    return _BYTE_LEVEL.findall(text) if _LATIN.fullmatch(text) else [_WHOLE + p for p in _CUT.split(text)]


def word_level_pieces(text: str) -> list[str]:
    """The same for a vocabulary that lower-cases and drops white space."""
    return _WORD_LEVEL.findall(text.lower()) if _LATIN.fullmatch(text) else [_WHOLE + p for p in re.split("[ \n]+", text)]


# The normalizer and pre-tokenizer of tokenizer files whose rules the two functions above follow.
_RULES = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, byte_level_pieces),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        word_level_pieces,
    ),
)


class _Known(dict):
    """Numbers for pieces, given out as they are first asked for; `fresh` has those without ids yet."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces))))
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = n = len(self)
        return n


class PieceEncoder:
    """Encodes whole texts with a tokenizers file, putting repeated pieces through the library once.

    Latin texts are cut into pre-tokens here and each distinct one goes through the library's BPE model; pieces of other
    texts go through its whole pipeline. Gives the ids that encoding the whole text gives, with its settings as they are: strings of its added
    tokens become these tokens (plain=True: they are text like any other). Texts that hold such a string, and all
    texts if the file's normalizer and pre-tokenizer are none of those known here, go through the library whole.
    Memory is bounded: beyond `most` remembered pieces, or `most_ids` ids of them, the less used ones are forgotten.
    """

    def __init__(self, path: str, most: int = 400_000, most_ids: int = 2_000_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        rules = json.loads(Path(path).read_text())
        known = [cut for normalizer, pre, cut in _RULES if rules.get("normalizer") == normalizer and rules.get("pre_tokenizer") == pre]
        added = [re.escape(t["content"]) for t in rules.get("added_tokens", ()) if t["content"] and not (plain and t["special"])]
        self.odd = re.compile("|".join(added) if known else "") if added or not known else None
        self.cut = known[0] if known else None
        self.most, self.most_ids = most, most_ids
        self._clear()

    def _forget(self) -> None:
        used, names = self.used[: self.size], list(self.known)
        least = max(2, int(np.partition(used, -self.most // 2)[-self.most // 2]) + 1 if self.size > self.most // 2 else 2)
        keep = np.flatnonzero(used >= least)
        n, starts = self.lengths[keep], self.starts[keep]
        if n.sum() > self.most_ids // 2:
            keep, n, starts = keep[:0], n[:0], starts[:0]
        till = np.cumsum(n)
        ids = self.ids[np.repeat(starts - till + n, n) + np.arange(till[-1] if len(till) else 0)]
        old = used[keep] // 2
        self._clear([names[k] for k in keep.tolist()])
        self._add(ids, n)
        self.used[: self.size] = old

    def _clear(self, pieces: list[str] = ()) -> None:
        self.known = _Known(pieces)
        self.size = self.filled = 0
        self.ids, self.starts, self.lengths, self.used = (np.zeros(4096, k) for k in (np.int32, np.int64, np.int64, np.int32))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(some), np.int32), np.fromiter(map(len, some), np.int64, len(some))

    def _learn(self) -> None:
        """Ids of the pieces that the last texts brought."""
        new, self.known.fresh = self.known.fresh, []
        if not new:
            return
        whole = [p for p in new if p[:1] == _WHOLE]
        found = dict(zip(whole, (e.ids for e in self.tokenizer.encode_batch_fast([p[1:] for p in whole], add_special_tokens=False)))) if whole else {}
        model, flat, n = self.tokenizer.model.tokenize, [], []
        for p in new:
            if p in found:
                ids = found[p]
            else:
                bare = p[1:] if p[0] == " " else p
                ids = [t.id for t in model((_SPACE + bare if bare is not p else p) if bare.isascii() and bare.isalnum() else _as_symbols(p))]
            flat += ids
            n.append(len(ids))
        self._add(np.array(flat, np.int32), np.array(n, np.int64))

    def _add(self, ids: np.ndarray, n: np.ndarray) -> None:
        base, at = self.size, self.filled
        self.size, self.filled = base + len(n), at + len(ids)
        for name, need in (("starts", self.size), ("lengths", self.size), ("used", self.size), ("ids", self.filled)):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old) // 2, 4096), old.dtype)]))
        self.ids[at : self.filled] = ids
        self.lengths[base : self.size] = n
        self.starts[base : self.size] = at + np.cumsum(n) - n

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.size > self.most or self.filled > self.most_ids:
            self._forget()
        parts = [self.cut(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        index = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(parts)), np.int32, int(sizes.sum()))
        self._learn()
        self.used += np.bincount(index, minlength=len(self.used)).astype(np.int32)
        n = self.lengths[index]
        till = np.cumsum(n)
        flat = self.ids[np.repeat(self.starts[index] - till + n, n) + np.arange(till[-1] if len(till) else 0)]
        return flat, np.diff(np.concatenate([[0], till])[np.cumsum(sizes)], prepend=0)

    def encode(self, texts: list[str], end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text closed by end_id, and the number of ids of each text."""
        odd = [k for k, t in enumerate(texts) if self.odd.search(t)] if self.odd else []
        if not odd:
            flat, n = self._pieced(texts)
        elif len(odd) == len(texts):
            flat, n = self._whole(texts)
        else:
            rest = sorted({*range(len(texts))}.difference(odd))
            (fo, no), (fr, nr) = self._whole([texts[k] for k in odd]), self._pieced([texts[k] for k in rest])
            both = dict(zip(odd + rest, np.split(fo, np.cumsum(no)[:-1]) + np.split(fr, np.cumsum(nr)[:-1])))
            flat, n = np.concatenate([both[k] for k in range(len(texts))]), np.array([len(both[k]) for k in range(len(texts))], np.int64)
        counts = n + 1
        out = np.full(int(counts.sum()), end_id, np.int32)
        closed = np.ones(len(out), bool)
        closed[np.cumsum(counts) - 1] = False
        out[closed] = flat
        return out, counts


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
