"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Each test item's word n-grams are counted over all documents; those no more
frequent than its median one are its seeds.  Where a seed occurs in a document, the passage around
it is aligned with the item word by word; the local alignment's score, as a
share of the item's own score, tells exact, edited and paraphrased copies from
chance.  Of a long item a passage of ``COPIED`` words is a copy too, whatever its
share; it is aligned with dear edits, so that only near-verbatim text counts.

Test items travel to the tasks in blocks of at most ``block_words`` words, one
pass over the documents for each block, so what is broadcast is bounded
whatever the size of the benchmark.

Defined results: null and empty texts match nothing; items with fewer words
than an n-gram are compared by one seed of their whole length; items of under 15
words need a least number of matched words too, of 6 words all, and items
of fewer words are found only in documents that hold nothing else (items without
words match nothing); repeated items and documents are each reported; null ids
are kept; empty tables give no rows; other columns are ignored or, in ``clean``,
passed through.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, unused, written

GRAM = 3
#: items of fewer words are sought by word pairs
SHORT_ITEM = 12
#: least share of an item's own score that counts as a copy
THRESHOLD = 0.5
#: a copy of an item of n words has LEAST + n // SLOPE matched words at least (all of 6), and two edits more than those at most
LEAST, SLOPE = 5, 6
#: items of so many words need no more than the threshold
FULL_ITEM = 15
MATCH, MISMATCH, GAP = 2, -1, -1
#: net matched words (each edit takes EDIT of them) of a stretch that is a copy whatever the item's length
COPIED = 30
EDIT = -4
#: words of test items that go to the tasks at once
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, score double, seeds long, start_word long, end_word long, digest binary"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """A block of test items: word numbers, n-gram table, and where grams occur."""

    def __init__(self, rows: list[tuple[int, str]], gram: int):
        self.gram = gram
        self.number: dict[str, int] = {}
        self.ids, self.tokens = [], []
        for item, text in rows:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")]
            if seq:
                self.ids.append(item)
                self.tokens.append(np.array(seq, np.int64))
        self.lengths = sorted({self.gram_of(t) for t in self.tokens})
        self.places: dict[tuple, list] = defaultdict(list)  # gram -> (item, position)
        for k, t in enumerate(self.tokens):
            n = self.gram_of(t)
            for p in range(len(t) - n + 1):
                self.places[tuple(t[p:p + n])].append((k, p))
        self.grams = list(self.places)
        self.tables = {}  # length -> (sorted hashes, gram number in that order)
        for n in self.lengths:
            own = [i for i, g in enumerate(self.grams) if len(g) == n]
            h = self.hashes(np.array([self.grams[i] for i in own], np.int64).reshape(-1), n)[::n]
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], np.array(own)[order])

    def gram_of(self, tokens: np.ndarray) -> int:
        """Words of the grams of an item."""
        return min(self.gram if len(tokens) >= SHORT_ITEM else 2, len(tokens))

    @staticmethod
    def hashes(tokens: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n-gram that starts at each token."""
        t = tokens.astype(np.uint64)
        h = np.zeros(max(0, len(t) - n + 1), np.uint64)
        for i in range(n):
            h = (h ^ t[i:len(t) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def number_words(self, text: str) -> np.ndarray:
        """Word numbers of a text; words of no item are 0."""
        found = words(text)
        get = self.number.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def occurrences(self, tokens: np.ndarray, kept: np.ndarray | None = None):
        """(position, gram number) of the grams in a numbered text, of those
        flagged in ``kept`` if given."""
        at, which = [], []
        for n, (table, numbers) in self.tables.items():
            if len(tokens) < n or not len(table):
                continue
            full = tokens[:len(tokens) - n + 1] != 0
            for i in range(1, n):
                full &= tokens[i:len(tokens) - n + 1 + i] != 0
            where = np.flatnonzero(full)
            if not len(where):
                continue
            h = self.hashes(tokens, n)[where]
            slot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[slot] == h
            where, found = where[hit], numbers[slot[hit]]
            if kept is not None:
                where, found = where[kept[found]], found[kept[found]]
            at.append(where)
            which.append(found)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(which)


def align(item: np.ndarray, passages: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH,
          gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item against rows of ``passages`` (0 = no word):
    best score, and the row of the item and the column where it ends."""
    n, width = passages.shape
    ramp = np.arange(1, width + 1) * -gap
    above = np.zeros((n, width + 1), np.int64)
    best = np.zeros(n, np.int64)
    end, end_item = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, w in enumerate(item):
        step = above[:, :-1] + np.where(passages == w, match, mismatch)
        here = np.maximum(np.maximum(step, above[:, 1:] + gap), 0)
        # a gap in the item: the best of all cells to the left, less a gap for each step
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        column = here.argmax(axis=1)
        value = here[np.arange(n), column]
        better = value > best
        best[better], end[better], end_item[better] = value[better], column[better], i
        above = np.concatenate([np.zeros((n, 1), np.int64), here], axis=1)
    return best, end_item, end


def needed(n: int, threshold: float) -> tuple[float, int]:
    """Least score and matched words of a copy of an item of ``n`` words."""
    if n >= FULL_ITEM:
        return threshold * MATCH * n, 0
    matched = LEAST + n // SLOPE
    return max(threshold * MATCH * n, MATCH * matched + 2 * GAP), matched


def matches(items: Items, seeds: np.ndarray, rows: list[tuple[int, str]], threshold: float) -> list[tuple]:
    """(row, item, score, seeds, start, end) of each row and item at or above the
    threshold or with a stretch of ``COPIED`` net words; words from start to end
    (exclusive) are the copy."""
    texts, candidates = {}, defaultdict(lambda: defaultdict(list))  # item -> (row, window) -> diagonals
    for r, (_, text) in enumerate(rows):
        tokens = items.number_words(text)
        at, which = items.occurrences(tokens, seeds)
        for p, g in zip(at.tolist(), which.tolist()):
            for k, q in items.places[items.grams[g]]:
                candidates[k][r].append(p - q)
        if len(at):
            texts[r] = tokens
    out = []
    for k, of_row in candidates.items():
        item = items.tokens[k]
        slack = len(item) // 2 + 2
        own = MATCH * len(item)
        least, matched = needed(len(item), threshold)
        if matched > len(item):  # only documents that hold nothing else
            out.extend((r, items.ids[k], 1.0, len(d), 0, len(item)) for r, d in of_row.items() if np.array_equal(texts[r], item))
            continue
        windows = []  # (row, first word, seeds): diagonals within the slack share a window
        for r, diagonals in of_row.items():
            diagonals.sort()
            first, n = diagonals[0], 0
            for x in diagonals:
                if x - first > slack:
                    windows.append((r, first, n))
                    first, n = x, 0
                n += 1
            windows.append((r, first, n))
        width = len(item) + 3 * slack
        top: dict[int, tuple] = {}
        block = max(1, 2_000_000 // width)
        for b in range(0, len(windows), block):
            part = windows[b:b + block]
            passages = np.zeros((len(part), width), np.int64)
            for j, (r, first, _) in enumerate(part):
                lo = max(0, first - slack)
                cut = texts[r][lo:first - slack + width]
                passages[j, :len(cut)] = cut
            score, end_item, end = align(item, passages)
            whole = score >= least
            passage = np.zeros(len(part), bool)
            # a stretch of COPIED net words scores MATCH for each of them at least
            long = np.flatnonzero(~whole & (score >= MATCH * COPIED))
            if len(long):
                strict, strict_item, strict_end = align(item, passages[long], 1, EDIT, EDIT)
                passage[long] = strict >= COPIED
                end_item[long], end[long] = strict_item, strict_end
            for j in np.flatnonzero(whole | passage):
                rules = (MATCH, MISMATCH, GAP) if whole[j] else (1, EDIT, EDIT)
                r, first, n = part[j]
                _, _, length = align(item[:end_item[j] + 1][::-1], passages[j:j + 1, :end[j] + 1][:, ::-1], *rules)
                if matched and align(item, passages[j:j + 1, end[j] - length[0]:end[j] + 1], 1, 0, 0)[0][0] < matched:
                    continue
                lo = max(0, first - slack)
                found = (score[j] / own, n, int(lo + end[j] - length[0]), int(lo + end[j] + 1))
                if r not in top or found[0] > top[r][0]:
                    top[r] = found
        out.extend((r, items.ids[k], *found) for r, found in top.items())
    return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_words: int):
    """Lists of (id, text) of the benchmark with about ``block_words`` words each."""
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    held, n = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        n += len(words(r["t"] or ""))
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def seed_flags(docs: DataFrame, items: Items) -> np.ndarray:
    """Which grams of a block are seeds: for each item those whose document
    frequency over all of ``docs`` is its median or less; in items of over twice
    ``COPIED`` words also those up to the median of their stretch, as a copied
    passage may hold the item's more frequent grams only."""
    def count(batches):
        total = np.zeros(len(items.grams), np.int64)
        for rows in text_slices(batches):
            for _, text in rows:
                _, which = items.occurrences(items.number_words(text))
                total[np.unique(which)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["g", "n"])

    df = np.zeros(len(items.grams), np.int64)
    # one row for each gram of the block: bounded by its words
    for r in docs.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        df[r["g"]] = r["n"]
    number = {g: i for i, g in enumerate(items.grams)}
    flags = np.zeros(len(items.grams), bool)
    for t in items.tokens:
        n = items.gram_of(t)
        own = np.array(sorted({number[tuple(t[p:p + n])] for p in range(len(t) - n + 1)}))
        flags[own[df[own] <= np.median(df[own])]] = True
        if len(t) > 2 * COPIED:
            along = np.array([number[tuple(t[p:p + n])] for p in range(len(t) - n + 1)])
            step = max(1, (COPIED - n + 1) // 2)  # every passage of COPIED words holds a whole stretch
            for a in range(0, len(along), step):
                part = along[a:a + step]
                flags[part[df[part] <= np.median(df[part])]] = True
    return flags


def contaminated(docs: DataFrame, bench: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, score, seeds, start_word, end_word, digest`` of each
    document and test item whose alignment reaches ``threshold`` or holds ``COPIED``
    net words; ``digest`` is the MD5 of the document's text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in _blocks(bench, item_col, item_text_col, block_words):
        items = Items(block, gram)
        seeds = seed_flags(source, items)

        def search(batches, items=items, seeds=seeds):
            from hashlib import md5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for rows in text_slices(batches):
                got = [(rows[r][0], *rest, md5(rows[r][1].encode("utf-8"), usedforsecurity=False).digest())
                       for r, *rest in matches(items, seeds, rows, threshold)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)],
                                                     names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

        part = source.mapInArrow(search, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return found


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` without a copy of a test item."""
    bad_id, bad_digest = unused(docs, "_bad_id", "_bad_digest")
    bad = written(contaminated(docs, bench, id_col=id_col, text_col=text_col, **parameters)
                  .select(F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_digest)).distinct(), "leaks")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))) == F.col(bad_digest))
    return docs.join(bad, same, "left_anti")
