"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal) that holds at least ``POWERS`` periods and ``MIN_WORDS`` words
and that no neighbouring word extends.  The words of a slice of documents are
numbered (equal words of unlike documents apart) and sorted into a suffix array
by doubling, which gives for every dyadic length ``b`` the suffix-array range of
each aligned block of ``b`` words.  A run of period ``b <= q < 2 b`` holds a
whole aligned block among its first words, and that block occurs again ``q``
words on: the next occurrences in the window of ``2 b`` words come from range
successor queries on a wavelet tree over the suffix array.  Occurrences that
overlap by half or more form a progression and are passed over as one, so a
block costs four queries however periodic it is; the distance of the last
occurrences of two progressions is a candidate period.  Candidates are extended
word by word to both sides, so only true runs are reported.

Defined results: null and empty text has no words, no runs and an empty
collapsed text; texts are taken whole whatever their length (about 150 bytes of
memory for each word of the longest text); of equal intervals the smallest
period counts; runs come by start, then period; repeated rows each get the same
result; a null id passes through; an empty table gives no rows; other columns
pass through unchanged (columns named like the outputs are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

MIN_WORDS = 6
POWERS = 4
#: bytes of text that are sorted together
SLICE = 3_000_000
#: stands for an occurrence that does not exist
NONE = 1 << 62

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class WaveletTree:
    """Ranks over the bits of a permutation of ``0 .. n-1``, one packed level for
    each bit: the least value of a range that is at least some bound."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = []
        for bit in range(max(1, int(self.n - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            zeros = values[~ones]
            self.levels.append((bit, words, counts, len(zeros)))
            values = np.concatenate([zeros, values[ones]])

    @staticmethod
    def _ones(words, counts, i):
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return counts[at] + np.bitwise_count(words[at] & below)

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each query the least value of ``values[lo:hi]`` that is ``>= bound``, or ``NONE``."""
        smaller, l, r = np.zeros(len(lo), np.int64), lo, hi
        for bit, words, counts, zeros in self.levels:  # how many values are below the bound
            l1, r1 = self._ones(words, counts, l), self._ones(words, counts, r)
            one = (bound >> bit & 1).astype(bool)
            smaller += np.where(one, (r - r1) - (l - l1), 0)
            l, r = np.where(one, zeros + l1, l - l1), np.where(one, zeros + r1, r - r1)
        found = (smaller < hi - lo) & (bound < self.n)
        k, l, r, out = smaller[found], lo[found], hi[found], np.zeros(int(found.sum()), np.int64)
        for bit, words, counts, zeros in self.levels:  # the next one in order
            l1, r1 = self._ones(words, counts, l), self._ones(words, counts, r)
            before = (r - r1) - (l - l1)
            one = k >= before
            k = np.where(one, k - before, k)
            out |= one.astype(np.int64) << bit
            l, r = np.where(one, zeros + l1, l - l1), np.where(one, zeros + r1, r - r1)
        result = np.full(len(lo), NONE, np.int64)
        result[found] = out
        return result


def dyadic_blocks(codes: np.ndarray, longest: int):
    """The suffix array of ``codes`` and, for b = 1, 2, 4, ... up to ``longest``,
    the aligned blocks of b codes that occur three times or more:
    ``(b, positions, lo, hi)`` with their ranges of the suffix array."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, codes[order[1:]] != codes[order[:-1]])
    rank, levels, b = np.empty(n, np.int64), [], 1
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.empty(n, np.int64)
    live = np.arange(n)  # places of the order whose group is not settled
    while True:
        heads = np.flatnonzero(new[live])
        sizes = np.diff(np.append(heads, len(live)))
        size[live] = np.repeat(sizes, sizes)
        rank[order[live]] = first[live]
        places = live[size[live] >= 3]
        p, at = order[places], first[places]
        aligned = p % b == 0
        p, at = p[aligned], at[aligned]
        by_place = np.argsort(p)
        levels.append((b, p[by_place], at[by_place], (at + size[at])[by_place]))
        live = live[size[live] > 1]
        if 2 * b > longest or not len(live) or not len(places):
            return order, levels
        there = order[live]
        follow = there + b
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1) + 1
        key += first[live] * (n + 1)
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        order[live] = there[by_key]
        new[live] = np.append(True, key[1:] != key[:-1])
        first[live] = np.maximum.accumulate(np.where(new[live], live, 0))
        b *= 2


def _equal(codes, i: int, j: int, back: bool) -> int:
    """How many codes agree from places i < j on, forwards or backwards."""
    total, step = 0, 32
    while True:
        m = min(step, i - total + 1 if back else len(codes) - j - total)
        if m <= 0:
            return total
        if back:
            a, b = codes[i - total - m + 1:i - total + 1][::-1], codes[j - total - m + 1:j - total + 1][::-1]
        else:
            a, b = codes[i + total:i + total + m], codes[j + total:j + total + m]
        unlike = a != b
        if unlike.any():
            return total + int(unlike.argmax())
        total, step = total + m, min(step * 4, 1 << 20)


def stretches(codes: np.ndarray, places: np.ndarray, periods: np.ndarray):
    """For each place p and period q with ``codes[p] == codes[p + q]`` the
    largest ``[start, stop)`` around p whose codes equal those q further on."""
    start, stop = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    seen_q, s, e = -1, 0, 0
    for i in np.lexsort((places, periods)).tolist():
        p, q = int(places[i]), int(periods[i])
        if q != seen_q or p >= e:
            s, e, seen_q = p - _equal(codes, p - 1, p - 1 + q, True), p + _equal(codes, p, p + q, False), q
        start[i], stop[i] = s, e
    return start, stop


def find_runs(codes: np.ndarray, longest: int, min_words: int = MIN_WORDS, powers: int = POWERS):
    """``(start, length, period)`` arrays of all runs in ``codes``, by start;
    no stretch of equal periods is longer than ``longest``.  ``powers`` is 4 or more."""
    if powers < 4:
        raise ValueError("a run must hold four periods or more")
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    order, levels = dyadic_blocks(codes, max(1, longest // powers))
    tree, found = WaveletTree(order), {}

    def last(p, nxt, b):
        """Last occurrence of each block's progression from p on (p itself
        where the next occurrence overlaps by less than half)."""
        out, d = p.copy(), nxt - p
        many = d <= b // 2
        if many.any():
            _, stop = stretches(codes, p[many], d[many])
            out[many] += (stop + d[many] - b - p[many]) // d[many] * d[many]
        return out

    for b, p, lo, hi in levels:
        # an occurrence past the window is as good as none
        nxt = tree.successor(lo, hi, p + 1)
        near = nxt < p + 2 * b
        base = last(p[near], nxt[near], b)
        lo, hi, now = lo[near], hi[near], base.copy()
        while len(now):
            x = tree.successor(lo, hi, now + 1)
            near = x < base + 2 * b
            base, lo, hi, x = base[near], lo[near], hi[near], x[near]
            now = last(x, tree.successor(lo, hi, x + 1), b)
            q = now - base
            short = q < 2 * b
            starts, stops = stretches(codes, base[short], q[short])
            q = q[short]
            whole = stops + q - starts >= np.maximum(min_words, powers * q)
            for s, e, period in zip(starts[whole].tolist(), (stops + q)[whole].tolist(), q[whole].tolist()):
                found[s, e] = min(period, found.get((s, e), period))
    runs = sorted((s, period, e - s) for (s, e), period in found.items())
    return tuple(np.array([r[i] for r in runs], np.int64) for i in (0, 2, 1))


def _numbered(texts: list[bytes]):
    """Word lists, codes and first places of a slice: a word has one code in one
    document, and a code of its own closes each document."""
    words, parts, firsts, base, at = [], [], [], 0, 0
    for text in texts:
        mine = text.split()  # bytes: space and 09-0D
        table: dict[bytes, int] = {}
        codes = [table.setdefault(w, len(table)) for w in mine]
        codes.append(len(table))
        parts.append(np.array(codes, np.int64) + base)
        words.append(mine)
        firsts.append(at)
        base += len(table) + 1
        at += len(codes)
    return words, np.concatenate(parts), np.array(firsts, np.int64)


def _slice_runs(texts: list[bytes]):
    """Per text: word count, runs, and the text without the words that runs repeat."""
    words, codes, firsts = _numbered(texts)
    start, length, period = find_runs(codes, max(map(len, words)))
    doc = np.searchsorted(firsts, start, side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, mine in enumerate(words):
        own = slice(bounds[i], bounds[i + 1])
        s, n, q = start[own] - firsts[i], length[own], period[own]
        kept = mine
        if len(s):
            change = np.zeros(len(mine) + 1, np.int64)
            np.add.at(change, s + q, 1)
            np.add.at(change, s + n, -1)
            kept = [w for w, drop in zip(mine, np.cumsum(change)[:-1].tolist()) if not drop]
        runs = [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), q.tolist())]
        yield len(mine), runs, b" ".join(kept).decode("utf-8")


def with_runs(docs: DataFrame, text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period in
    words) and ``collapsed``: the words that no run repeats, joined by spaces."""
    out = ["n_words", "runs", "collapsed"]
    rest = docs.drop(*out)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    at = rest.columns.index(text_col)

    def run(batches):
        for batch in batches:
            begin, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text = (batch.column(at)[i].as_py() or "").encode("utf-8")
                held.append(text)
                size += len(text)
                if size >= slice_bytes or i + 1 == batch.num_rows:
                    counts, runs, kept = zip(*_slice_runs(held))
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(counts, pa.int64()), pa.array(runs, _RUN), pa.array(kept, pa.string())],
                        names=[*part.schema.names, *out])
                    begin, held, size = i + 1, [], 0

    return rest.mapInArrow(run, schema)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` collapsed where it holds a run; texts without
    one stay as they are."""
    found = with_runs(docs.select("*"), text_col)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*docs.columns)


def strongest(runs: Column) -> Column:
    """The run of the greatest ``length / period``, the earliest of equal ones; null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a repetition written into a tenth of the texts: with
    ``h = crc32(id)``, ``g = h div 10``, where ``h mod 10 = 0`` each word ``i >= a`` of n
    becomes word ``a + (i - a) mod p``; ``a = g mod n``, ``p = 1 + (n - a) div (3 + g mod 8)``.
    A null id leaves the text."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def written(words):
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.element_at(words, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(h.isNotNull() & (F.pmod(h, F.lit(10)) == 0),
                  let(words, lambda w: F.when(F.size(w) > 0, written(w)).otherwise(F.col(text_col)))).otherwise(F.col(text_col))
    return docs.withColumn(text_col, text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_runs``, the strongest run and the SHA-256 of the list of runs
    and of the collapsed text, after ``planted``."""
    found = with_runs(planted(docs.select(id_col, text_col), id_col, text_col), text_col)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    top = strongest(F.col("runs"))
    return (found.withColumn("_top", top).select(
        F.col(id_col).alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"),
        F.col("_top.length").alias("length"), F.col("_top.period").alias("period"),
        F.floor(1000 * F.col("_top.length") / F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
