"""Document fingerprints by one-permutation MinHash.

The hashes of a text's five-word shingles are binned once by their high bits
and each bin keeps its least hash.  Bins that stay empty take the value of the
first filled bin in a random order of their own (optimal densification,
Shrivastava 2017), so equal bins of two texts are filled alike.  Of each value
the low-order bits are stored, packed; the likeness of two fingerprints is the
share of equal bins, corrected for chance agreement (Li and Koenig, 2010).

``with_edits`` also builds each document's edited text from the next document
in the order of ids.  Documents are dealt over ranges of ids, and the first of
each range also travels to the range before, so a task needs its rows only
once, in order.

Defined results: null text counts as empty; texts without words have the
fingerprint zero, fully alike among each other; a text of fewer words than a
shingle is one shingle; rows with null ids come last, in the order of a hash of
their texts, as do rows that repeat an id among themselves; a single row is its
own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BINS = 512
LOW_BITS = 4
#: documents of one range of ids, and the most ranges (more documents make them longer)
RANGE_ROWS = 500
MOST_RANGES = 100_000
SEED = 7

_rng = np.random.default_rng(SEED)
#: place of each bin in the order that an empty bin tries
TRIES = np.argsort(np.argsort(_rng.random((BINS, BINS)), axis=1), axis=1).astype(np.uint16)
#: odd multipliers that mix borrowed values
MIX = _rng.integers(1, 1 << 63, BINS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest
    words = np.array(list(map(xxh64_intdigest, text.lower().encode("utf-8").split())), np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        h = (h ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str) -> np.ndarray:
    """Low-order bits of each bin."""
    hashes = np.sort(shingle_hashes(text))
    if not len(hashes):
        return np.zeros(BINS, np.uint8)
    of = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    filled = of[first]
    out = np.empty(BINS, np.uint8)
    out[filled] = (hashes[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        lent = hashes[first][TRIES[np.ix_(empty, filled)].argmin(axis=1)]
        # mixed anew for each borrower: bins that borrow unlike values then agree by chance independently
        out[empty] = ((lent * MIX[empty]) >> np.uint64(64 - LOW_BITS)).astype(np.uint8)
    return out


def packed(bins: np.ndarray) -> str:
    """Hex string of a fingerprint, two bins a byte."""
    return (bins[0::2] << 4 | bins[1::2]).astype(np.uint8).tobytes().hex()


def unpacked(hexed: str) -> np.ndarray:
    data = np.frombuffer(bytes.fromhex(hexed), np.uint8)
    return np.column_stack([data >> 4, data & 15]).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the shingle sets."""
    chance = 2.0 ** -LOW_BITS
    return float(min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1.0 - chance))))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def run(batches):
        for batch in batches:
            prints = [packed(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return source.mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``range, guest, doc_id, mark, text``, each range within one partition and
    sorted; after a range's own rows comes the first row of the next range (of
    the first, after the last) as guest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    ranges = min(MOST_RANGES, -(-rows.count() // range_rows))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, max(10_000, 4 * ranges)).alias("c")).first()["c"] if steps else None
    cuts = sorted(set(cuts or []))
    last = len(cuts) + 1  # the range of null ids

    # ids without nulls: pandas would turn a column with nulls into floats
    named, known = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull()

    def own(ids: pd.Series, known: pd.Series) -> np.ndarray:
        home = np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(np.int64), side="right")
        return np.where(known.to_numpy(bool), home, last)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(own(ids, known))

    # one row for each range: MOST_RANGES + 1 at most
    heads = (rows.select("doc_id", "mark").withColumn("range", range_of(named, known))
             .groupBy("range").agg(F.min(F.struct("doc_id", "mark")).alias("head")).orderBy("range").collect())
    host = {(r["head"]["doc_id"], r["head"]["mark"]): heads[i - 1]["range"] for i, r in enumerate(heads)}

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series, known: pd.Series, marks: pd.Series) -> pd.Series:
        named = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        guests = [host.get(x) for x in zip(named, marks.tolist())]
        return pd.Series([[h] if g is None else [h, g] for h, g in zip(own(ids, known).tolist(), guests)])

    return (rows.select("*", F.posexplode(places(named, known, F.col("mark"))).alias("guest", "range"))
            .repartition("range")
            .sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_last(), "mark"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``: a document's edited text has its last
    ``n_chars // 2`` characters replaced by the first as many of the next."""
    ordered = in_order(docs, id_col, text_col, range_rows)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches):
        held, out = None, []  # the row that waits for its next: range, id, text, fingerprint
        for batch in batches:
            columns = [batch.column(c) for c in ("range", "guest", "doc_id", "text")]
            for place, guest, doc, text in zip(*columns):
                place, guest, text = place.as_py(), guest.as_py(), text.as_py()
                if guest and (held is None or held[0] != place):
                    continue  # a repeated guest
                print_ = fingerprint(text)
                if held is not None and held[0] == place:
                    _, own_id, own_text, own_print = held
                    n = len(own_text)
                    edited = own_text[:n - n // 2] + text[:n // 2]
                    edited_print = fingerprint(edited)
                    out.append((own_id, n, sha256(edited.encode("utf-8")).hexdigest(), packed(own_print),
                                packed(edited_print), likeness(own_print, edited_print), likeness(own_print, print_)))
                held = None if guest else (place, doc.as_py(), text, print_)
                if len(out) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
