"""Text statistics per document, and how far each is from running prose.

Texts are measured in windows of about WINDOW characters, several sentences of prose each. Of every window come four
statistics: words per sentence end, characters per word and the share of characters that are neither letter nor white
space (each as logarithm), and the share of common words of the language that has most of them there (as arcsine of its
root, of which the variance does not hang on the share). Per language, mean and
covariance of prose are estimated robustly from the windows of all documents: start at median and median deviation, then
moments of the windows within a quantile of the chi-square distribution, made consistent for the part cut off, again and
again, and shrunk towards the pooled covariance as far as the data ask for. Nothing else is set by hand.

A document's distance is the median, by characters, of the squared Mahalanobis distances of its windows: less than half
of its characters stand in windows of prose exactly where that median is above the chi-square quantile that windows of
prose stay below. What each statistic contributes is told for the window at the median, the one that decides.

Characters are looked at as numpy arrays over many texts at once: no Python runs per word or line.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwork.llm import characters
from kelpwork.llm.characters import codes_of, hashes, pieces
from kelpwork.llm.partials import summed
from kelpwork.plans.shared import Stage

#: Characters of a window, about: a text is cut into equal windows, as many as come nearest to this size.
WINDOW = 300
#: Part of the prose that shapes its mean and covariance in the first turns and in the last ones, and part of its
#: windows that stays below the cut.
CORE, FINAL, PROSE = 0.75, 0.975, 0.99999
TURNS = (4, 2)

STATISTICS = ("words_per_end", "chars_per_word", "marks", "common")
#: Range of the histogram that gives the first median of each statistic. Values beyond count at its ends.
_RANGES = np.array([(-4.0, 10.0), (0.0, 14.0), (-14.0, 0.1), (0.0, 1.5709)])
_BINS = 4_000
_FIELDS = 2 + len(STATISTICS)  # language, characters, statistics

_ENDS, _CLOSING = ".!?:;…", "\"'»”’)]“"
_OTHER, _LETTER, _DIGIT, _SPACE, _FORMAT = range(5)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, small letter, whether it ends a sentence, whether it may follow such an end."""
    kind, small = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    of = {"L": _LETTER, "M": _LETTER, "Z": _SPACE}
    for i in range(0x110000):
        c = chr(i)
        category = unicodedata.category(c)
        kind[i] = _DIGIT if category == "Nd" else _FORMAT if category == "Cf" else of.get(category[0], _OTHER)
        if category[0] == "L" and len(low := c.lower()) == 1:
            small[i] = ord(low)
    kind[[*range(9, 14), *range(28, 32), 0x85]] = _SPACE
    ends, closing = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    ends[[ord(c) for c in _ENDS]] = True
    closing[[ord(c) for c in _CLOSING]] = True
    return kind, small, ends, closing


def _small(codes: np.ndarray) -> np.ndarray:
    return _tables()[1][codes]


def normal(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class CommonWords:
    """Hashes of the common words of any number of languages, and which languages have each."""

    def __init__(self, words: Sequence[tuple[str, str]]):
        self.languages = sorted({x for x, _ in words}) or [""]
        held: dict[int, set[int]] = {}
        for lang, word in words:
            codes = codes_of(word)
            held.setdefault(int(hashes(_small(codes), np.array([0]), np.array([len(codes)]))[0]), set()).add(self.languages.index(lang))
        self.known = np.array(sorted(held), np.uint64)
        self.member = np.zeros((len(held), len(self.languages)))
        for i, h in enumerate(self.known.tolist()):
            self.member[i, list(held[h])] = 1

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        if not len(self.known):
            return np.zeros(len(wanted), bool), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        hit = self.known[at] == wanted
        return hit, at[hit]


def _count(at: np.ndarray, n: int, of: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at if of is None else at[of], minlength=n).astype(float)


def measure(texts: list[str], common: CommonWords) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Statistics of each text, and windows with the text that each belongs to.

    A word is a run of letters and marks, a symbol neither of them nor digit nor white space, a line ends in punctuation
    if it does so before closing quotes and brackets. Format characters (soft hyphens, joiners) do not count at all.
    """
    kinds, _, ends_at, closes = _tables()
    n_lang, totals, windows, owners = len(common.languages), [], [], []
    waiting: list[tuple[int, str]] = []

    def flush() -> None:
        """Measures the pieces that wait, each followed by a line end."""
        if not waiting:
            return
        of = np.array([i for i, _ in waiting])
        codes = codes_of("\n".join([*(p for _, p in waiting), ""]))
        piece = np.repeat(np.arange(len(waiting)), [len(p) + 1 for _, p in waiting])
        keep = kinds[codes] != _FORMAT
        codes, piece = codes[keep], piece[keep]
        kind, n, n_pieces = kinds[codes], len(codes), len(waiting)
        size = np.bincount(piece, minlength=n_pieces)  # with the line end
        first = np.r_[0, np.cumsum(size)[:-1]]
        last = np.zeros(n, bool)
        last[first + size - 1] = True
        parts = np.maximum(1, np.round((size - 1) / WINDOW)).astype(int)
        place = ((np.arange(n) - first[piece]) * parts[piece]) // np.maximum(1, size - 1)[piece]
        n_windows = int(parts.sum())
        window = np.r_[0, np.cumsum(parts)[:-1]][piece] + np.minimum(place, parts[piece] - 1)
        letter = kind == _LETTER
        start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        stop = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
        hit, which = common.found(hashes(_small(codes), start, stop))
        in_window = window[start]
        hits = np.column_stack([np.bincount(in_window[hit], common.member[which, k] if len(which) else None, minlength=n_windows) for k in range(n_lang)])
        space, sentence = kind == _SPACE, ends_at[codes]
        sentence_end = sentence & np.r_[space[1:], True] & ~np.r_[True, space[:-1]]
        real = ~last
        chars, words = _count(window, n_windows, real), _count(in_window, n_windows)
        letters, marks, ends = _count(window, n_windows, letter), _count(window, n_windows, (kind == _OTHER) | (kind == _DIGIT)), _count(window, n_windows, sentence_end)
        owner = of[np.repeat(np.arange(n_pieces), parts)]
        by_text = np.zeros((len(texts), n_lang))
        np.add.at(by_text, owner, hits)
        lang = np.where(hits.max(1) > 0, hits.argmax(1), by_text.argmax(1)[owner])
        share = hits[np.arange(n_windows), lang] / np.maximum(1, words)
        # the added constants keep windows without any word or mark finite; a mark more or less is what they can be off by
        x = [np.log((words + 1) / (ends + 1)), np.log((chars + 1) / (words + 1)), np.log((marks + 1) / (chars + 20)), np.arcsin(np.sqrt(np.minimum(1, share)))]
        windows.append(np.column_stack([lang, chars, *x]).astype(np.float32))
        owners.append(owner)
        # lines: the last character before blanks and closing ones decides
        new_line = (codes == 10) | (codes == 13)
        line = np.r_[0, np.cumsum(new_line)[:-1]]
        filled = np.bincount(line, ~space) > 0
        told = np.maximum.accumulate(np.where(space | closes[codes], -1, np.arange(n)))
        close = np.flatnonzero(new_line)
        begin = np.r_[0, close[:-1] + 1]
        punctuated = (told[close] >= begin) & sentence[told[close]]
        line_of = of[piece[close]]
        add = lambda at, w=None: np.bincount(at, w, minlength=len(texts))
        totals.append(np.column_stack([add(owner, words), add(owner, letters), add(of[piece], (kind == _OTHER).astype(float)), add(owner, chars), add(line_of, filled[: len(close)].astype(float)), add(line_of, punctuated.astype(float)), by_text]))
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        for p in pieces(normal(text)):
            waiting.append((i, p))
            held += len(p)
            if held >= characters.CHUNK:
                flush()
                held = 0
    flush()
    sums = sum(totals)
    words, letters, symbols, chars, lines, punctuated = sums[:, :6].T
    lang = sums[:, 6:].argmax(1)
    ratio = lambda a, b: a / np.maximum(1, b)
    out = pd.DataFrame({"k": lang, "n_words": words.astype(int), "mean_word_length": ratio(letters, words), "symbol_share": ratio(symbols, chars), "punctuated_lines": ratio(punctuated, lines), "common_share": ratio(sums[np.arange(len(texts)), 6 + lang], words)})
    return out, np.vstack(windows), np.concatenate(owners)


_MEASURED = ["k", "n_words", "mean_word_length", "symbol_share", "punctuated_lines", "common_share"]
_SCHEMA = "doc_id long, k int, n_words long, mean_word_length double, symbol_share double, punctuated_lines double, common_share double, windows binary"


def _measured(common: CommonWords):
    """Rows of documents: own statistics and the packed windows. Blank texts have no windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            filled = np.array([bool(t) and not t.isspace() for t in pdf["text"]], bool)
            held = {c: np.full(len(pdf), None, object) for c in [*_MEASURED, "windows"]}
            held["n_words"][:] = 0
            if filled.any():
                stats, windows, owner = measure(pdf["text"][filled].tolist(), common)
                windows = windows[np.argsort(owner, kind="stable")]
                cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(stats)))]
                for c in _MEASURED:
                    held[c][filled] = stats[c].to_numpy(object)
                held["windows"][filled] = [windows[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), **held})
            yield out

    return run


def _unpacked(packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, characters and statistics of the windows of a batch."""
    raw = np.frombuffer(b"".join(packed), np.float32).reshape(-1, _FIELDS).astype(float)
    return raw[:, 0].astype(int), raw[:, 1], raw[:, 2:]


def chi_square(x: float, p: int) -> float:
    """Distribution function with ``p`` degrees of freedom: the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return total * exp(a * log(half) - half - lgamma(a))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1_000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, p) < q else (low, middle)
    return low


def consistency(q: float, p: int) -> float:
    """What the covariance of Gaussian points within their quantile ``q`` falls short by."""
    return q / chi_square(chi_square_quantile(q, p), p + 2)


class Prose:
    """Mean and covariance per language."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray):
        self.mean, self.covariance = mean, covariance
        self.inverse = np.linalg.inv(covariance)

    def parts(self, lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Contribution of each statistic to the squared distance, which is their sum."""
        off = x - self.mean[lang]
        return off * np.einsum("njk,nk->nj", self.inverse[lang], off)


def _start(windows: DataFrame, n_lang: int) -> Prose:
    """Medians and median absolute deviations from histograms; a language without windows has those of all."""
    low, high = _RANGES.T
    p = len(STATISTICS)
    width = (high - low) / _BINS

    def part(pdf: pd.DataFrame) -> np.ndarray:
        lang, _, x = _unpacked(pdf["windows"])
        bins = np.clip((x - low) / width, 0, _BINS - 1).astype(int)
        at = (lang[:, None] * p + np.arange(p)) * _BINS + bins
        return np.bincount(at.ravel(), minlength=n_lang * p * _BINS).reshape(n_lang, p, _BINS).astype(float)

    counts = summed(windows, part, (n_lang, p, _BINS))
    counts = np.where(counts.sum(2, keepdims=True) > 0, counts, counts.sum(0, keepdims=True))
    mean, spread = np.zeros((n_lang, p)), np.ones((n_lang, p))
    for k in range(n_lang):
        for j in range(p):
            centre, held = low[j] + (np.arange(_BINS) + 0.5) * width[j], counts[k, j]
            half = held.sum() / 2
            if half:
                mean[k, j] = centre[np.searchsorted(np.cumsum(held), half)]
                off = np.abs(centre - mean[k, j])
                order = np.argsort(off, kind="stable")
                spread[k, j] = 1.4826 * off[order][np.searchsorted(np.cumsum(held[order]), half)]
                if spread[k, j] < width[j]:  # more than half of the windows have one value
                    spread[k, j] = max(np.sqrt((held * off**2).sum() / held.sum()), width[j])
    return Prose(mean, np.array([np.diag(s**2) for s in spread]))


def _shrunk(n: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> Prose:
    """Each language drawn towards the pooled covariance, by as much as its own is uncertain against what sets it apart."""
    pooled_mean = (n[:, None] * mean).sum(0) / max(1.0, n.sum())
    pooled = (n[:, None, None] * covariance).sum(0) / max(1.0, n.sum())
    pooled = pooled + np.diag(((_RANGES[:, 1] - _RANGES[:, 0]) / _BINS) ** 2)  # no finer than the first histogram
    scale = 1 / np.sqrt(np.diag(pooled))
    out_mean, out = mean.copy(), covariance.copy()
    for k in range(len(n)):
        s = covariance[k] * np.outer(scale, scale)
        unsure = (np.outer(np.diag(s), np.diag(s)) + s**2).sum() / max(n[k], 1.0)
        apart = ((s - pooled * np.outer(scale, scale)) ** 2).sum()
        weight = min(1.0, unsure / max(apart, 1e-12)) if n[k] > len(STATISTICS) else 1.0
        out[k] = (1 - weight) * covariance[k] + weight * pooled
        out_mean[k] = (n[k] * mean[k] + pooled_mean) / (n[k] + 1) if n[k] else pooled_mean
    return Prose(out_mean, out)


def fit_prose(windows: DataFrame, n_lang: int) -> Prose:
    """Robust mean and covariance per language over the windows of all documents."""
    prose, p = _start(windows, n_lang), len(STATISTICS)
    for share in [CORE] * TURNS[0] + [FINAL] * TURNS[1]:
        within = chi_square_quantile(share, p)

        def part(pdf: pd.DataFrame, prose: Prose = prose, within: float = within) -> np.ndarray:
            lang, _, x = _unpacked(pdf["windows"])
            use = prose.parts(lang, x).sum(1) <= within
            y = np.column_stack([np.ones(use.sum()), x[use]])
            out = np.zeros((n_lang, p + 1, p + 1))
            for k in np.unique(lang[use]):
                z = y[lang[use] == k]
                out[k] = z.T @ z
            return out

        moments = summed(windows, part, (n_lang, p + 1, p + 1))
        n = moments[:, 0, 0]
        if not n.sum():
            break
        mean = moments[:, 0, 1:] / np.maximum(1, n)[:, None]
        covariance = moments[:, 1:, 1:] / np.maximum(1, n)[:, None, None] - mean[:, :, None] * mean[:, None, :]
        prose = _shrunk(n, mean, consistency(share, p) * covariance)
    return prose


def _judged(prose: Prose):
    """Adds the distance of each document, its parts, and the share of its characters in windows of prose."""
    cut = chi_square_quantile(PROSE, len(STATISTICS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            has = pdf["windows"].notna().to_numpy()
            told = np.full((len(pdf), 2 + len(STATISTICS)), np.nan)
            if has.any():
                packed = pdf["windows"][has]
                lang, chars, x = _unpacked(packed)
                doc = np.repeat(np.arange(len(packed)), packed.map(len).to_numpy() // (4 * _FIELDS))
                parts = prose.parts(lang, x)
                squared = parts.sum(1)
                total = np.maximum(np.bincount(doc, chars, len(packed)), 1e-9)
                share = np.bincount(doc, chars * (squared <= cut), len(packed)) / total
                order = np.lexsort((squared, doc))
                up_to = np.cumsum(chars[order])
                before = np.r_[0, up_to[np.flatnonzero(np.diff(doc[order]))]]
                reached = np.flatnonzero(up_to - before[doc[order]] >= total[doc[order]] / 2 - 1e-6)
                _, at = np.unique(doc[order][reached], return_index=True)
                middle = order[reached[at]]
                told[has] = np.column_stack([squared[middle], share, parts[middle]])
            out = pdf.drop(columns="windows")
            for i, c in enumerate(["squared", "prose_share", *[f"from_{s}" for s in STATISTICS]]):
                out[c] = pd.Series(told[:, i], pdf.index).astype(object).where(has, None)
            yield out

    return run


def _common_words(words: DataFrame) -> CommonWords:
    """The word list, which is sent to every task: a list of frequent words per language, not a table that grows with
    the corpus. Words of more than one run of letters can stand in no text and are left out."""
    held = words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").distinct().collect()
    read = {(r.lang.strip().lower(), normal(r.word).strip()) for r in held}
    kinds = _tables()[0]
    return CommonWords(sorted((a, b) for a, b in read if b and (kinds[codes_of(b)] == _LETTER).all()))


def text_statistics(docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, language, n_words, mean_word_length, symbol_share, punctuated_lines,
    common_share, prose_share, distance`` and ``from_<statistic>``, the parts of the squared ``distance``.

    The language is the one with most common words in the text, of equal ones the first by name. A null, empty or blank text has n_words 0 and
    nulls elsewhere. Documents without ``doc_id`` are kept with a null id; repeated ids give repeated rows. With no
    common words at all there is one nameless language; a language with few or no windows is judged by what is pooled
    from all. A line of more than 2 ** 20 characters counts as several. Extra columns are ignored.
    """
    stage = Stage(docs.sparkSession, "quality")
    common = _common_words(common_words)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = stage.write(rows.mapInPandas(_measured(common), _SCHEMA), "measured")
    prose = fit_prose(measured.where("windows IS NOT NULL").select("windows"), len(common.languages))
    told = ["squared double", "prose_share double", *[f"from_{s} double" for s in STATISTICS]]
    judged = measured.mapInPandas(_judged(prose), _SCHEMA.replace("windows binary", ", ".join(told)))
    names = F.array(*[F.lit(x) for x in common.languages])
    # in a far corner rounding can leave a tiny negative square
    distance = F.sqrt(F.greatest(F.col("squared"), F.lit(0.0)))
    judged = judged.withColumn("language", F.get(names, "k")).withColumn("distance", F.when(F.col("squared").isNotNull(), distance))
    return judged.select("doc_id", "language", "n_words", "mean_word_length", "symbol_share", "punctuated_lines", "common_share", "prose_share", "distance", *[f"from_{s}" for s in STATISTICS])


def not_prose(statistics: DataFrame, quantile: float = PROSE) -> DataFrame:
    """Documents that are not blank and whose median window is farther out than that part of the windows of prose."""
    return statistics.where(F.col("distance") > F.lit(chi_square_quantile(quantile, len(STATISTICS)) ** 0.5))
