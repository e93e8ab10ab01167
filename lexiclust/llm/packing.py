"""Packing token sequences into fixed windows by minimum bin slack.

Documents longer than a window are cut into full windows and one remainder.
The remainders are planned by length: a bitset subset-sum dynamic program over
the multiset of remaining lengths finds the filling closest to capacity beside
the longest remaining piece, its counts are backtracked, and the filling is
repeated as often as the counts allow.  The plan depends only on the histogram
of lengths (at most ``capacity`` rows), never on the number of documents;
pieces find their place by their rank within their length.

Defined results: null text counts as empty; an empty document is one piece with
the end id alone; repeated rows (also repeated ids) are packed separately; an
empty table gives no rows; columns of the input other than id and text are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import numbered, text_slices, written

END_ID = 1
CAPACITY = 2048
#: words, and other chunks, whose ids a task keeps; beyond it begins anew
KEPT = 400_000
#: bytes up to which strings are told apart by the rolling sum of their bytes
SHORT = 64
#: words that are encoded in one call
CALL_WORDS = 500
#: classes of bytes: blanks, letters (of ASCII, and all bytes of other characters), ASCII punctuation, the rest
BLANK, LETTER, PUNCTUATION, REST = range(4)


class Bytes:
    """Rolling sums of a byte buffer: the key of any stretch in constant time."""

    _rng = np.random.default_rng(11)
    _values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    _base = 0x9E3779B97F4A7C15
    _powers: list[np.ndarray] = []

    def __init__(self, data: bytes):
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        if not self._powers or len(self._powers[0]) <= len(buf):
            for factor in (self._base, pow(self._base, -1, 1 << 64)):
                steps = np.full(len(buf) + 1, factor, np.uint64)
                steps[0] = 1
                self._powers.append(np.cumprod(steps, dtype=np.uint64))
            del self._powers[:-2]
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self._values[buf] * self._powers[0][:len(buf)], out=self.sums[1:])

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray]:
        """Keys and bytes of the distinct stretches, and the number of each."""
        lengths = ends - starts
        key = (self.sums[ends] - self.sums[starts]) * self._powers[1][starts] + lengths.astype(np.uint64)
        for i in np.flatnonzero(lengths > SHORT).tolist():
            key[i] = xxh64_intdigest(self.data[starts[i]:ends[i]])
        number, keys = pd.factorize(key)
        first = np.empty(len(keys), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        return keys.tolist(), [self.data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], number


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, REST, np.uint8)
    kind[[32, 10]] = BLANK
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    kind[[ord(c) for c in string.punctuation]] = PUNCTUATION
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


KIND, LOWER = _byte_classes()


class Coder:
    """Token ids of texts, packed as unsigned 32-bit integers.

    A tokenizer that drops white space, lower-cases, and encodes runs of letters
    on their own gives a blank-separated chunk of letters and closing ASCII
    punctuation the ids of its lower-cased letters followed by those of the
    punctuation.  Words are therefore encoded once, many to a call, and told
    apart by the tokens that end a word; every other chunk is encoded as it
    stands.  Only distinct strings are handled one by one.
    """

    def __init__(self, rules: str, word_end: str = "</w>"):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.coder = Tokenizer.from_str(rules)
        # for lower-cased runs of letters: only composition and the split at blanks are left to do
        self.word_coder = Tokenizer(self.coder.model)
        self.word_coder.normalizer = normalizers.NFC()
        self.word_coder.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True
        self.words: dict[int, bytes] = {}
        self.others: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _runs(self, words: list[str]) -> list[bytes]:
        """Packed ids of lower-cased runs of letters."""
        out = []
        for i in range(0, len(words), CALL_WORDS):
            part = words[i:i + CALL_WORDS]
            ids = np.array(self.word_coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) == len(part):
                packed = ids.tobytes()
                out.extend([packed[a:b] for a, b in zip([0, *stops], stops)])
            else:  # letters that the tokenizer does not take for one run
                out.extend(map(self._whole, part))
        return out

    def _words(self, keys: list[int], words: list[bytes]) -> list[bytes]:
        """Packed ids of runs of letters (ASCII lower-cased); none for those that
        are not letters alone, or whose lower case depends on their place."""
        if len(self.words) > KEPT:
            self.words = {}
        out = list(map(self.words.get, keys))
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            texts = b"\n".join([words[i] for i in new]).decode("utf-8").split("\n")
            lower = list(map(str.lower, texts))
            fit = [x.isalpha() and (t is x or "\u03a3" not in t and x.lower() == x) for t, x in zip(texts, lower)]
            coded = iter(self._runs([x for x, f in zip(lower, fit) if f]))
            for i, f in zip(new, fit):
                out[i] = self.words[keys[i]] = next(coded) if f else b""
        return out

    def _others(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.others) > KEPT:
            self.others = {}
        out = list(map(self.others.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.others[chunks[i]] = self._whole(chunks[i].decode("utf-8"))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        data = "\n".join(texts).encode("utf-8")
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
        buf = np.frombuffer(data, np.uint8)
        kind = KIND[buf]
        solid = np.zeros(len(buf) + 2, np.int8)
        solid[1:-1] = kind != BLANK
        steps = np.diff(solid)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        if not len(starts):
            return [b""] * len(texts)
        breaks = np.append(np.flatnonzero(kind != LETTER), len(buf))
        heads = breaks[np.searchsorted(breaks, starts)]  # where a chunk's letters end
        marks = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(kind == PUNCTUATION, out=marks[1:])
        simple = (heads > starts) & (marks[ends] - marks[heads] == ends - heads)
        at = np.flatnonzero(simple)
        lowered = Bytes(LOWER[buf].tobytes())
        keys, words, number = lowered.distinct(starts[at], heads[at])
        coded = self._words(keys, words)
        fit = np.ones(len(coded), bool)
        fit[[i for i, ids in enumerate(coded) if not ids]] = False
        fit = fit[number]
        simple[at[~fit]] = False
        at, number = at[fit], number[fit]
        _, tails, tail = lowered.distinct(heads[at], ends[at])
        rest = np.flatnonzero(~simple)
        other, chunks = pd.factorize(np.array([data[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist())], object))

        table = coded + self._others(tails) + self._others(list(chunks)) + [b""]
        which = np.full((len(starts), 2), len(table) - 1)
        which[at, 0] = number
        which[at, 1] = len(coded) + tail
        which[rest, 0] = len(coded) + len(tails) + other
        which = which.ravel()
        flat = np.frombuffer(b"".join(table), "<u4")
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        size = lengths[which]
        stop = np.cumsum(size)
        shift = (np.cumsum(lengths) - lengths)[which] - (stop - size)
        ids = flat[np.arange(int(stop[-1])) + np.repeat(shift, size)].tobytes()
        text_of = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
        cuts = np.append(0, stop)[2 * np.searchsorted(text_of, np.arange(len(texts) + 1))] * 4
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them: ``doc_id, doc_tokens, start, length,
    ids`` with ids as packed little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file whose normaliser drops white
    space between words (so blank-separated chunks are encoded independently,
    and each distinct chunk only once per task).
    """
    with open(tokenizer, encoding="utf-8") as f:
        rules = f.read()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, doc_tokens long, start long, length long, ids binary"

    def cut(batches):
        coder = Coder(rules)
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for rows in text_slices(batches, 500_000):
            out = ([], [], [], [], [])
            for (doc, _), ids in zip(rows, coder.encode([t for _, t in rows])):
                ids += end
                for at in range(0, len(ids), width):
                    piece = ids[at:at + width]
                    for column, x in zip(out, (doc, len(ids) // 4, at // 4, len(piece) // 4, piece)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())],
                names=["doc_id", "doc_tokens", "start", "length", "ids"])

    return source.mapInArrow(cut, schema)


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum-bin-slack fillings ``({length: count}, repeats)`` that use up
    every piece of the histogram ``counts``."""
    left = {length: n for length, n in counts.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    plan = []
    while left:
        longest = max(left)
        room = capacity - longest
        held = {length: n - (length == longest) for length, n in left.items() if length <= room}
        # commonest lengths first: the sooner the window is full, the oftener its filling can repeat
        order = sorted((length for length, n in held.items() if n > 0), key=lambda x: (-held[x], -x))
        mask = (1 << (room + 1)) - 1
        reach, stages = 1, []
        for length in order:
            before, most = reach, min(held[length], room // length)
            step = 1
            while most > 0:  # copies in powers of two: every count from 0 to most is covered
                take = min(step, most)
                reach |= (reach << (take * length)) & mask
                most -= take
                step *= 2
            stages.append((length, before))
            if reach >> room:
                break
        at = reach.bit_length() - 1
        use = {longest: 1}
        for length, before in reversed(stages):
            n = 0
            while not before >> at & 1:
                at -= length
                n += 1
            if n:
                use[length] = use.get(length, 0) + n
        repeats = min(left[length] // n for length, n in use.items())
        plan.append((use, repeats))
        for length, n in use.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, start, length``
    and any other columns).  Sequence ids are gapless from 0; the pieces of a
    sequence lie gapless from offset 0."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries = []  # (length, first rank, copies in a window, first sequence, offset)
    used: dict[int, int] = {}
    sequence = 0
    for use, repeats in plan_windows(histogram, capacity):
        offset = 0
        for length in sorted(use, reverse=True):
            entries.append((length, used.get(length, 0), use[length], sequence, offset))
            used[length] = used.get(length, 0) + use[length] * repeats
            offset += length * use[length]
        sequence += repeats
    entries.sort()
    table = np.array(entries, dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    ranked = numbered(cut, ["length"], ["doc_id", "start"], "_rank")
    fields = [f for f in ranked.schema if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            window, copy = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(row[:, 3] + window), pa.array(row[:, 4] + copy * length)],
                names=[*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``keep_ids``, the packed ``ids``."""
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    return place(written(cut if keep_ids else cut.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Training windows ``sequence_id, n_tokens, ids`` of ``pack(keep_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), parts.alias("_p"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
