"""Token ids of whole texts by a public byte-level BPE vocabulary.

Long texts are cut into pieces that are encoded in parallel, wherever the cuts fall, and put together pairwise, as a tree.
At each join the text around it is encoded anew in a growing window until it agrees with both sides exactly:

* The pattern that splits text before the merges remembers nothing and looks ahead by one character, so of a text's parts
  only the last can change when text is added, and two scans that meet at a boundary go on alike. The window starts at a
  part of the left side before its last; it agrees with the right side at the first boundary that both have.
* Where one unsplit part reaches from side to side and is long, its halves' tokens are joined likewise: a window of
  tokens around the join is encoded anew and grows until its first token is the one the left side had there, and its
  last the one the right side had. A token sequence is the encoding of its bytes exactly if every two adjacent tokens
  are the encoding of their own bytes; agreement leaves no new pair at the window's edges.

Ordinary texts need no piece: their parts are found by a pattern over the characters of which each engine agrees what
they are, and encoded from a cache; a text with any other character goes to the library whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.plans.shared import Stage

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a piece; longer texts are cut.
PIECE = 16_384
#: Bytes above which an unsplit part is joined by token windows instead of being encoded anew.
LONG_PART = 2_048
#: Neighbouring pieces that one task joins at a level of the tree.
FAN_IN = 16
CACHE = 400_000

#: Fixed value: the public pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for plain text: up to U+017F the classes are spelled out, the other blocks hold only marks and symbols.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \x85\xa0"
_PLAIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_PLAIN = re.compile("[^\x00-\u017f\u0300-\u036f\u200b-\u200d\u2010-\u2027\u2030-\u203a\u20ac\u2500-\u2775\u2794-\u27bf\ufe00-\ufe0f\ufeff]")


class _Parts(dict):
    """Token ids of an unsplit part, as bytes of 32-bit numbers, encoded at first use."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[part] = _packed(self.encode(part))
        return ids


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _ids(packed: bytes) -> list[int]:
    return array("i", packed).tolist()


Parts = list[tuple[str, bytes]]


class Encoder:
    """Encoder for one vocabulary file of ranks."""

    def __init__(self, folder: str, vocabulary: str):
        import regex
        import tiktoken

        lines = Path(folder, f"{vocabulary}.tiktoken").read_bytes().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.library = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.parts = _Parts(self.library.encode_ordinary)

    def encode(self, text: str) -> bytes:
        if _NOT_PLAIN.search(text):
            return _packed(self.library.encode_ordinary(text))
        return b"".join(map(self.parts.__getitem__, _PLAIN.findall(text)))

    def _part(self, data: bytes) -> list[int]:
        return self.library._encode_single_piece(data)

    def _bytes(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)

    def join_part(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one unsplit part from those of its halves."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            ids = self._part(self._bytes(a) + self._bytes(b))
            start = len(a) == len(left) or ids[0] == a[0]
            end = len(b) == len(right) or ids[-1] == b[-1]
            if start and end:
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            k *= 2

    def split(self, text: str) -> Parts:
        """The parts of a text, each with its ids."""
        return [(x, self.parts[x]) for x in self.pattern.findall(text)]

    def join(self, left: Parts, right: Parts) -> Parts:
        """Parts of the concatenation of two texts, from the parts of each."""
        reach = 2
        while left and right:
            a, b = left[-reach:], right[:reach]
            cut = sum(len(x) for x, _ in a)
            starts, at = {}, cut
            for j, (x, _) in enumerate(b):
                starts[at] = j
                at += len(x)
            window = "".join(x for x, _ in chain(a, b))
            spans = [m.span() for m in self.pattern.finditer(window)]
            agree = next((s for s, _ in spans if s in starts), None)
            if agree is None and reach >= len(right):
                agree, starts = len(window), {len(window): len(right)}
            if agree is not None:
                middle = [(window[s:e], self._joined(window[s:e], s, e, cut, a, b)) for s, e in spans if s < agree]
                return left[: len(left) - len(a)] + middle + right[starts[agree] :]
            reach *= 4
        return left + right

    def _joined(self, part: str, start: int, end: int, cut: int, a: Parts, b: Parts) -> bytes:
        """Ids of a part of the window; a long one made of one part from each side is joined from their ids."""
        halves = start < cut < end and start == cut - len(a[-1][0]) and end == cut + len(b[0][0])
        return _packed(self.join_part(_ids(a[-1][1]), _ids(b[0][1]))) if halves and len(part) > LONG_PART else self.parts[part]

    def tree(self, pieces: list[Parts]) -> Parts:
        """Neighbours are joined pairwise until one piece is left."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else []


@lru_cache(maxsize=2)
def encoder(folder: str, vocabulary: str) -> Encoder:
    return Encoder(folder, vocabulary)


def _list_array(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]))


def _encode_short(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode
        for batch in batches:
            # slices bound the memory of a batch of long texts
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = _list_array([encode(x) if x else b"" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return run


def _cut(size: int):
    """Pieces of long texts; each is cut out once, in time that does not hang on where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                for k in range(0, len(text), 64 * size):  # slices bound what is sent at once
                    parts = [text[i : i + size] for i in range(k, min(len(text), k + 64 * size), size)]
                    numbers = pa.array(range(k // size, k // size + len(parts)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at].as_py()] * len(parts), pa.string()), numbers, pa.array(parts, pa.string())], ["row", "piece", "text"])

    return run


def _encode_pieces(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                parts = enc.split(row.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, *_columns(parts)], PIECE_COLUMNS)

    return run


PIECE_COLUMNS = ["row", "piece", "text", "chars", "n_bytes", "ids"]
_PIECE_SCHEMA = "row string, piece int, text string, chars array<int>, n_bytes array<int>, ids binary"


def _columns(parts: Parts) -> list[pa.Array]:
    chars, n_bytes = [len(x) for x, _ in parts], [len(i) for _, i in parts]
    return [_list_array([_packed(chars)]), _list_array([_packed(n_bytes)]), pa.array([b"".join(i for _, i in parts)], pa.binary())]


def _join_pieces(folder: str, vocabulary: str):
    """Neighbouring pieces, put together as a tree; what comes out is a piece of the next level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, pieces = encoder(folder, vocabulary), []
        for text, chars, n_bytes, ids in pdf.sort_values("piece")[["text", "chars", "n_bytes", "ids"]].itertuples(index=False):
            ends = zip(np.cumsum(chars).tolist(), chars.tolist(), np.cumsum(n_bytes).tolist(), n_bytes.tolist())
            pieces.append([(text[e - c : e], ids[k - n : k]) for e, c, k, n in ends])
        parts = enc.tree(pieces)
        held = {"row": pdf["row"].iloc[:1], "piece": pdf["piece"].iloc[:1] // FAN_IN, "text": ["".join(x for x, _ in parts)]}
        return pd.DataFrame(held | {"chars": [np.array([len(x) for x, _ in parts], np.int32)], "n_bytes": [np.array([len(i) for _, i in parts], np.int32)], "ids": [b"".join(i for _, i in parts)]})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _list_array([x.as_py() for x in batch.column(1)])], ["row", "ids"])


def token_ids(docs: DataFrame, doc_id: str, text: str, folder: str | None = None, vocabulary: str = VOCABULARY, piece: int = PIECE) -> DataFrame:
    """``(doc_id, ids)``: the ids of each text without special tokens; strings of special tokens are ordinary text.

    An empty or null text has an empty list. One row comes out per row of ``docs``, repeated ids included. Extra columns
    are ignored. ``folder`` holds the vocabulary files; without it, what ``spark.kelpwork.tokenizers`` names or TOKENIZERS.

    Long texts are written first, under names of their own, as pieces; the levels of the tree that joins them are grouped by text and
    FAN_IN neighbours, so the pieces of one text are spread over many tasks.
    """
    folder = folder or docs.sparkSession.conf.get("spark.kelpwork.tokenizers", TOKENIZERS)
    stage = Stage(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    short = rows.where(F.col("text").isNull() | (F.char_length("text") <= piece)).mapInArrow(_encode_short(folder, vocabulary), "doc_id long, ids array<int>")
    long, n_long = stage.counted(rows.where(F.char_length("text") > piece).withColumn("row", F.uuid()), "long")
    if n_long == 0:
        return short
    pieces = long.select("row", "text").mapInArrow(_cut(piece), "row string, piece int, text string").repartition("row", "piece")
    level, most = stage.counted(pieces.mapInArrow(_encode_pieces(folder, vocabulary), _PIECE_SCHEMA), "level0", F.max("piece"))
    turn = 0
    while most > 0:
        turn, most = turn + 1, most // FAN_IN
        joined = level.groupBy("row", F.floor(F.col("piece") / FAN_IN).alias("next")).applyInPandas(_join_pieces(folder, vocabulary), _PIECE_SCHEMA)
        level = stage.write(joined, f"level{turn}")
        stage.drop(f"level{turn - 1}")
    whole = level.select("row", "ids").mapInArrow(_unpacked, "row string, ids array<int>")
    return short.unionByName(long.select("row", "doc_id").join(whole, "row").select("doc_id", "ids"))
