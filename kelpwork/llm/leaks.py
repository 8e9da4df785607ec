"""Passages of held-out evaluation items that occur, exactly or altered, in a corpus.

Latent semantic retrieval. Every word of the corpus has a place in a hashed vocabulary, with frequencies from all documents;
passages of PASSAGE words, weighted by TF-IDF, give the latent space by a distributed randomised SVD (the index is fitted on
a bounded sample of FIT_PASSAGES; every passage is searched). Corpus texts are searched in that space at two grains:

* Windows of SPAN words, one every STEP words of the text and one at every word of an item. Their latent vectors are sums
  in whole numbers, so equal windows have equal vectors and the same signature of signs against random planes, by which they are
  looked up. Any WINDOW words that a text shares with an item hold such a window whole, so they are always met.
* Passages of PASSAGE words, overlapping by half, against those of the items, by cosine: item passages stand in cells around
  centres, and a corpus passage is compared with those of the PROBES nearest cells. They find what was altered.

Documents and items that met are verified: whether they share WINDOW words in a row; else where they agree best, by the longest
common subsequence of two windows, and by the words that single the item out. A word that n different passages of items
have counts 1 / n, however often texts repeat it: a stock sentence with other names is no copy.

The corpus is read and cut into words once, whatever the number of items; no word of it travels. Items go to the tasks in blocks of
bounded size, and each block is one pass over the words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.llm.characters import codes_of, hashes, mixed, pieces
from kelpwork.llm.partials import summed
from kelpwork.plans.shared import Stage

WINDOW = 13
SPAN, STEP = 8, 6  # SPAN + STEP - 1 <= WINDOW
PASSAGE, HALF = 26, 13
#: Words between passages of an item.
ITEM_STEP = 9
RANK, OVERSAMPLED = 64, 8
#: Random planes of a signature.
SIGNS = 32
#: Places of the hashed vocabulary; a power of two.
PLACES = 1 << 15
#: Passages that the latent space is fitted on, about; those of the items come on top.
FIT_PASSAGES, FIT_TASKS = 50_000, 8
#: Item passages of a cell, about, and cells that a corpus passage looks into.
CELL, PROBES = 64, 6
COSINE = 0.65
#: An altered passage shares so many words in order with the item's window, and of the weight of the words around it this
#: part, and at least as much as one word that no other item has.
MIN_COMMON = 9
MIN_WEIGHT, LEAST_WEIGHT = 0.4, 1.0
#: Cells in which words of items are counted by hash.
ITEM_CELLS = 1 << 20
#: Most item rows and words of a block. Tasks are sent about 70 bytes a word and 50 MB besides.
ITEM_BLOCK, ITEM_WORDS = 4_000, 400_000
#: Words that are searched at once; longer texts are cut, with an overlap. A multiple of STEP and HALF.
CHUNK_WORDS = 78 * 1_300
OVERLAP = PASSAGE + HALF
#: Most pairs of a text and an item that are looked at at once.
TABLE = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_ODD = 0xD1342543DE82EF95


def words(text: str) -> list[str]:
    """Longest runs of letters and digits after NFKC normalisation and lower-casing."""
    return _WORD.findall(_plain(text))


def _plain(text: str) -> str:
    return (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)], bool)


def word_ids(text: str) -> np.ndarray:
    """64-bit ids of the words of a text."""
    out = []
    for part in pieces(_plain(text)):
        codes = codes_of(part)
        inside = _in_words()[codes]
        start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
        out.append(mixed(hashes(codes, start, end)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _places(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(PLACES - 1)).astype(np.int32)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, words)``; the last one of a task has the document frequencies, documents and passages of its part."""
    totals = np.zeros(PLACES + 2, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = [word_ids(t) if t else np.zeros(0, np.uint64) for t in part.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids])
            flat = np.concatenate(ids)
            seen = np.unique(np.repeat(np.arange(len(ids)), sizes) * PLACES + _places(flat))
            totals[:PLACES] += np.bincount(seen & (PLACES - 1), minlength=PLACES)
            totals[PLACES:] += np.array([(sizes > 0).sum(), (sizes // PASSAGE).sum()])
            held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), held, pa.nulls(len(part), pa.binary())], ["doc_id", "words", "totals"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([totals.tobytes()], pa.binary())], ["doc_id", "words", "totals"])


def _sampled(share: float):
    """Every passage of the corpus whose hash is below ``share``, as packed places of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _flat(batch.column(0))
            sizes = np.diff(offsets) // PASSAGE
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * PASSAGE
            draw = mixed(flat[start] ^ mixed(flat[start + 1]) if len(start) else flat[:0]).astype(float) / 2.0**64
            start = start[draw < share]
            held = _places(flat[start[:, None] + np.arange(PASSAGE)]) if len(start) else np.zeros((0, PASSAGE), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in held], pa.binary())], ["passage"])

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of lists, and where each list starts and ends."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def _gram_times(passages: np.ndarray, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(A^T A) q for the TF-IDF matrix A of the passages, its rows scaled to length one."""
    out = np.zeros_like(q)
    for at in range(0, len(passages), 512):
        p = passages[at : at + 512]
        weight = idf[p]
        # repeated words of a passage add up, so its length is that of the summed counts
        same = (p[:, :, None] == p[:, None, :]).sum(2)
        weight = weight / np.maximum(np.sqrt((weight**2 * same).sum(1, keepdims=True)), 1e-12)
        image = np.einsum("nw,nwk->nk", weight, q[p])
        flat = p.ravel()
        order = np.argsort(flat, kind="stable")
        rows = (weight[:, :, None] * image[:, None, :]).reshape(-1, q.shape[1])[order]
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        out[flat[order][first]] += np.add.reduceat(rows, first, axis=0)
    return out


class Space:
    """TF-IDF weights and latent vectors of the places of the vocabulary, and whole numbers for signatures."""

    def __init__(self, idf: np.ndarray, latent: np.ndarray, seed: int = 0):
        self.idf = idf.astype(np.float32)
        self.latent = (latent * idf[:, None]).astype(np.float32)
        planes = np.random.default_rng(seed).standard_normal((latent.shape[1], SIGNS))
        turned = (latent * idf[:, None]) @ planes
        self.turned = np.round(turned * (2**20 / max(1e-12, np.abs(turned).max()))).astype(np.int32)

    def signatures(self, places: np.ndarray, start: np.ndarray) -> np.ndarray:
        """SIGNS signs of each window of SPAN words; sums of whole numbers, so order and batch do not matter."""
        total = self.turned[places[start]]
        for j in range(1, SPAN):
            total += self.turned[places[start + j]]
        return np.packbits(total > 0, axis=1).view(np.uint32).ravel().astype(np.uint64)

    def halves(self, places: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums of up to HALF words; two neighbours are a passage. A sum over word positions is the product of counts, IDF and latent vectors."""
        out = self.latent[places[start]]
        for j in range(1, HALF):
            use = np.flatnonzero(length > j)
            if len(use) == len(start):
                out += self.latent[places[start + j]]
            else:
                out[use] += self.latent[places[start[use] + j]]
        return out

    def vectors(self, places: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unit vectors of passages."""
        out = self.halves(places, start, np.minimum(length, HALF))
        more = np.flatnonzero(length > HALF)
        out[more] += self.halves(places, start[more] + HALF, length[more] - HALF)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _fitted(fit: DataFrame, items: np.ndarray, idf: np.ndarray, seed: int = 0) -> Space:
    """Randomised SVD of the TF-IDF rows of the sampled passages and those of the items: two passes over the sample."""

    def product(q: np.ndarray) -> np.ndarray:
        part = lambda pdf: _gram_times(np.frombuffer(b"".join(pdf["passage"]), np.int32).reshape(-1, PASSAGE), idf, q)
        return summed(fit, part, q.shape, fan_in=8) + _gram_times(items, idf, q)

    q = np.random.default_rng(seed).standard_normal((PLACES, RANK + OVERSAMPLED))
    q, _ = np.linalg.qr(product(q))
    image = product(q)
    values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    return Space(idf, q @ turn[:, np.argsort(-values)[:RANK]], seed)


def _grams(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of WINDOW words in a row."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(start), np.uint64)
        for j in range(WINDOW):
            out = out * np.uint64(_ODD) + ids[start + j]
        return out


class Postings:
    """Owners by key, each once."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        pairs = np.unique(np.column_stack([keys, owners.astype(np.uint64)]), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
        self.keys, self.first, self.count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.owners = pairs[:, 1].astype(np.int64)

    def pairs(self, keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(of, owner)`` of every key that is known, each pair once."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        met = np.unique(of[hit] * len(self.keys) + at[hit])
        of, at = met // len(self.keys), met % len(self.keys)
        n = self.count[at]
        place = np.repeat(self.first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        out = np.unique(np.repeat(of, n) * (self.owners.max() + 1) + self.owners[place])
        return out // (self.owners.max() + 1), out % (self.owners.max() + 1)


class ItemIndex:
    """One block of items: their words one after another, looked up by windows and by passages."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], space: Space, held_by: np.ndarray):
        self.space = space
        self.item_id = np.array([i for i, _ in rows])
        self.ids = np.concatenate([x for _, x in rows])
        self.weight = (1 / np.maximum(1, held_by[self.ids & np.uint64(ITEM_CELLS - 1)])).astype(np.float32)
        size = np.array([len(x) for _, x in rows])
        begin = np.r_[0, np.cumsum(size)[:-1]]
        owner = np.repeat(np.arange(len(rows)), size)
        left = (begin + size)[owner] - np.arange(len(self.ids))  # words up to the item's end
        places = _places(self.ids)
        self.vocabulary, at = np.unique(self.ids, return_index=True)
        self.vocabulary_weight = self.weight[at]
        at = np.flatnonzero(left >= SPAN)
        self.windows = Postings(space.signatures(places, at), owner[at])
        at = np.flatnonzero(left >= WINDOW)
        self.grams = Postings(_grams(self.ids, at), owner[at])
        offset = np.arange(len(self.ids)) - begin[owner]
        self.at = np.flatnonzero((left >= WINDOW) & ((offset % ITEM_STEP == 0) & (left >= PASSAGE) | (left == PASSAGE) | (offset == 0)))
        # passages of stock sentences alone weigh too little to be told from other texts, and are not searched for
        up_to = np.r_[0.0, np.cumsum(self.weight)]
        self.at = self.at[up_to[self.at + np.minimum(left[self.at], PASSAGE)] - up_to[self.at] >= LEAST_WEIGHT - 1e-6]
        self.length, self.owner = np.minimum(left[self.at], PASSAGE), owner[self.at]
        self.vectors = space.vectors(places, self.at, self.length)
        self._cells()

    def _cells(self) -> None:
        """Cells of item passages around centres: a few turns of k-means from passages drawn at random."""
        n = len(self.vectors)
        k = max(1, n // CELL)
        centres = self.vectors[np.random.default_rng(0).permutation(n)[:k]]
        for _ in range(5 if n else 0):
            cell = (self.vectors @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, cell, self.vectors)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
        cell = (self.vectors @ centres.T).argmax(1) if n else np.zeros(0, int)
        self.centres = centres
        self.members = [np.flatnonzero(cell == c) for c in range(k)]

    def weights(self, ids: np.ndarray) -> np.ndarray:
        """What each word weighs as a word of an item; 0 for words that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == ids, self.vocabulary_weight[at], 0)

    def near(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, item passage, cosine)`` of those at least COSINE near, among the cells that are nearest to the row."""
        if not len(self.vectors) or not len(vectors):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        to = vectors @ self.centres.T
        probes = min(PROBES, to.shape[1])
        nearest = np.argpartition(-to, probes - 1, axis=1)[:, :probes]
        looked = np.zeros(to.shape, bool)
        np.put_along_axis(looked, nearest, True, axis=1)
        found = []
        for c, members in enumerate(self.members):
            rows = np.flatnonzero(looked[:, c])
            if len(rows) and len(members):
                cosine = vectors[rows] @ self.vectors[members].T
                i, j = np.nonzero(cosine >= COSINE)
                found.append((rows[i], members[j], cosine[i, j]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found))


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` with the same row of ``b``; -1 equals nothing."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int8)
    for i in range(a.shape[1]):
        before = best
        best = before.copy()
        hit = (b == a[:, i : i + 1]) & (b >= 0)
        for j in range(b.shape[1]):
            best[:, j + 1] = np.maximum(np.maximum(before[:, j + 1], best[:, j]), before[:, j] + hit[:, j])
    return best[:, -1]


def _around(ids: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` words from ``at`` of the text that spans ``low`` to ``high``; 0 beyond it."""
    where = at[:, None] + np.arange(n)
    return np.where((where >= low[:, None]) & (where < high[:, None]), ids[np.clip(where, 0, len(ids) - 1)], np.uint64(0))


def _held(doc: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of the words of an item passage that the text around has too, as a sum and as a part."""
    short = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    hit = (short(doc)[:, :, None] == short(item)[:, None, :]).any(1) & (item != 0)
    held = (weight * hit).sum(1)
    return held, held / np.maximum((weight * (item != 0)).sum(1), 1e-9)


def _in_order(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Words in order that two windows of WINDOW words share, where passage and surroundings agree best."""
    same = (doc[:, :, None] == item[:, None, :]) & (item != 0)[:, None, :]
    n_rows, width = len(doc), doc.shape[1]
    reach = width - PASSAGE + 1
    diagonals = np.stack([same[:, np.arange(PASSAGE) + d, np.arange(PASSAGE)] for d in range(reach)], 1)
    # a word more or less moves the rest by one, so neighbouring diagonals count as well, for less
    near = 2 * diagonals.astype(np.int16)
    near[:, 1:] += diagonals[:, :-1]
    near[:, :-1] += diagonals[:, 1:]
    up_to = np.concatenate([np.zeros((n_rows, reach, 1), np.int16), np.cumsum(near, axis=2, dtype=np.int16)], 2)
    in_window = up_to[:, :, WINDOW:] - up_to[:, :, :-WINDOW]
    best = in_window.reshape(n_rows, -1).argmax(1)
    d, s = best // in_window.shape[2], best % in_window.shape[2]
    rows = np.arange(n_rows)[:, None]
    b = item[rows, s[:, None] + np.arange(WINDOW)]
    a = doc[rows, np.minimum((s + d)[:, None] + np.arange(WINDOW), width - 1)]
    signed = lambda x: np.where(x == 0, -1, (x >> np.uint64(1)).astype(np.int64))
    return common_length(signed(a), signed(b)).astype(int)


_FOUND = "doc_id long, item_id long, exact boolean, common int, weight double, cosine double"


def _search(index: ItemIndex, ids: np.ndarray, row: np.ndarray, offset: np.ndarray, left: np.ndarray) -> pd.DataFrame:
    """Rows of texts (given as words with their row, place and words up to the end) and items that match."""
    space, places, n_items = index.space, _places(ids), len(index.item_id)
    at = np.flatnonzero((offset % STEP == 0) & (left >= SPAN))
    met = np.column_stack(index.windows.pairs(space.signatures(places, at), row[at]))
    at = np.flatnonzero(offset % HALF == 0)
    vectors = space.halves(places, at, np.minimum(left[at], HALF))
    more = np.flatnonzero(left[at] > HALF)
    vectors[more] += vectors[more + 1]
    # words around a passage that weigh less than LEAST_WEIGHT together can hold no altered passage of any item
    up_to = np.r_[0.0, np.cumsum(index.weights(ids))]
    around = up_to[np.minimum(at + PASSAGE + WINDOW, at + left[at])] - up_to[np.maximum(at - WINDOW, at - offset[at])]
    use = ((left[at] >= WINDOW) | (offset[at] == 0)) & (around >= LEAST_WEIGHT - 1e-6)
    at, vectors = at[use], vectors[use]
    i, j, cosine = index.near(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))
    # of each text and item the nearest passages; a table of both is small, see TABLE
    key = row[at[i]] * n_items + index.owner[j]
    best = np.zeros((int(row[-1]) + 1) * n_items, np.float32)
    np.maximum.at(best, key, cosine)
    first = np.flatnonzero(cosine == best[key])
    key, at_first = np.unique(key[first], return_index=True)
    first = first[at_first]
    i, j, cosine = i[first], j[first], cosine[first]
    candidates = np.unique(np.r_[met[:, 0] * n_items + met[:, 1], key])
    # verification: the same words in a row, else the best agreement around the nearest passages
    at_gram = np.flatnonzero(left >= WINDOW)
    shared = np.column_stack(index.grams.pairs(_grams(ids, at_gram), row[at_gram]))
    exact = np.intersect1d(candidates, shared[:, 0] * n_items + shared[:, 1])
    out = [pd.DataFrame({"key": exact, "exact": True, "common": WINDOW, "weight": 1.0, "cosine": 1.0})]
    rest = ~np.isin(key, exact)
    key, i, j, cosine = key[rest], at[i[rest]], j[rest], cosine[rest]
    for k in range(0, len(key), 2_048):
        part = slice(k, k + 2_048)
        begin, p = i[part], index.at[j[part]]
        doc = _around(ids, begin - offset[begin], begin + left[begin], begin - WINDOW, PASSAGE + 2 * WINDOW)
        item = _around(index.ids, p, p + index.length[j[part]], p, PASSAGE)
        held, weight = _held(doc, item, index.weight[np.minimum(p[:, None] + np.arange(PASSAGE), len(index.ids) - 1)])
        good = np.flatnonzero((weight >= MIN_WEIGHT) & (held >= LEAST_WEIGHT))
        if len(good):
            common = _in_order(doc[good], item[good])
            good, common = good[common >= MIN_COMMON], common[common >= MIN_COMMON]
            out.append(pd.DataFrame({"key": key[part][good], "exact": False, "common": common, "weight": weight[good], "cosine": cosine[part][good].astype(float)}))
    found = pd.concat(out, ignore_index=True)
    return found.assign(row=found["key"] // n_items, item_id=index.item_id[found["key"] % n_items]).drop(columns="key")


def _searched(index: ItemIndex, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact", pa.bool_()), ("common", pa.int32()), ("weight", pa.float64()), ("cosine", pa.float64())])
        for batch in batches:
            doc_id, (flat, offsets) = batch.column(0).to_numpy(), _flat(batch.column(1))
            # chunks of whole texts, and of parts of longer ones that overlap
            parts = [(r, a, min(b, a + chunk + OVERLAP)) for r, (start, b) in enumerate(zip(offsets[:-1], offsets[1:])) for a in range(start, max(start + 1, b), chunk) if a < b]
            while parts:
                n, size = 0, 0
                most = max(1, TABLE // len(index.item_id))
                while n < min(len(parts), most) and (n == 0 or size + parts[n][2] - parts[n][1] <= chunk):
                    size += parts[n][2] - parts[n][1]
                    n += 1
                sizes = np.array([b - a for _, a, b in parts[:n]])
                part = np.repeat(np.arange(n), sizes)
                offset = np.arange(size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ids = flat[np.array([a for _, a, _ in parts[:n]])[part] + offset]
                found = _search(index, ids, part, offset, sizes[part] - offset)
                found["doc_id"] = doc_id[np.array([r for r, _, _ in parts[:n]])[found["row"]]]
                yield pa.RecordBatch.from_pandas(found[schema.names], schema, preserve_index=False)
                parts = parts[n:]

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as words, in blocks. Longer ones than a block are cut, with an overlap; ones shorter than WINDOW match nothing."""
    block, size = [], 0
    for r in items.toLocalIterator():
        ids = word_ids(r.passage)
        for a in range(0, max(1, len(ids) - WINDOW + 1), ITEM_WORDS - PASSAGE):
            part = ids[a : a + ITEM_WORDS]
            if len(part) < WINDOW:
                continue
            if block and (len(block) >= ITEM_BLOCK or size + len(part) > ITEM_WORDS):
                yield block
                block, size = [], 0
            block.append((r.item_id, part))
            size += len(part)
    if block:
        yield block


def _held_by(items: DataFrame) -> np.ndarray:
    """How many different passages have each word, by hash: of all items, in memory that does not grow."""
    out = np.zeros(ITEM_CELLS, np.int32)
    for r in items.select("passage").distinct().toLocalIterator():
        out[np.unique(word_ids(r.passage) & np.uint64(ITEM_CELLS - 1))] += 1
    return out


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``(doc_id, item_id, exact, common, weight, cosine)``: documents that hold a passage of an item, and how closely.

    ``exact``: they share WINDOW consecutive words; else the best window shares ``common`` words in order, and the text holds the
    part ``weight`` of the words around it, weighted by how few items have them. Texts and passages that are null, empty or shorter than WINDOW words match nothing.
    Repeated documents match each under its own id; rows with a null id are left out. Empty tables give empty results.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "leaks")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    scanned = stage.write(rows.mapInArrow(_tokenised, "doc_id long, words array<long>, totals binary"), "scanned")
    totals = summed(scanned.where("totals IS NOT NULL").select("totals"), lambda pdf: sum(np.frombuffer(x, np.int64).astype(float) for x in pdf["totals"]), (PLACES + 2,))
    n_docs, n_passages = totals[PLACES:]
    idf = np.log((1 + n_docs) / (1 + totals[:PLACES])) + 1
    corpus = scanned.where("words IS NOT NULL")
    sample = corpus.select("words").mapInArrow(_sampled(FIT_PASSAGES / max(1.0, n_passages)), "passage binary").repartition(FIT_TASKS)
    fit, space, found, held_by = stage.write(sample, "fit"), None, None, _held_by(wanted)
    for k, block in enumerate(_blocks(wanted)):
        if space is None:  # passages of the first block, at every word, shape the space as well
            at = [x[a : a + PASSAGE] for _, x in block for a in range(0, len(x) - PASSAGE + 1, ITEM_STEP)]
            space = _fitted(fit, _places(np.array(at, np.uint64).reshape(-1, PASSAGE)), idf)
        matches = stage.write(corpus.select("doc_id", "words").mapInArrow(_searched(ItemIndex(block, space, held_by), CHUNK_WORDS), _FOUND), f"matches{k}")
        found = matches if found is None else found.unionByName(matches)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    # an item's texts repeated under other ids, and parts of long texts, meet here; the rows are matches, not documents
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("exact", "common", "weight", "cosine")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")
