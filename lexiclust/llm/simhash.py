"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint is cut into ``k // 2 + 1`` segments, so two fingerprints within
``k`` bits have a segment that differs by one bit at most.  Each segment is
indexed once per bit with that bit as a wildcard; equal variants meet in an
equality join, where the whole distance is verified and each pair passes at one
variant only.  Segment values shared by very many fingerprints are split again
by the rest of the fingerprint.

Defined results: null text counts as empty, and texts without words have
fingerprint zero and are linked like any other; null ids take part, and a
component's id is its smallest non-null id (null if there is none); repeated
rows share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, unused, written
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BITS = 64
#: fingerprints that share a segment value before their buckets are split
HOT_SEGMENT = 2000


def shingle_hashes(text: str, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle: words between ASCII white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    return [xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]


def majority_bits(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bits set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        counts = np.empty((len(some), BITS), np.int64)
        block = 64  # runs at a time: bounds the unpacked bits
        for i in range(0, len(some), block):
            runs = some[i:i + block]
            lo, hi = starts[runs[0]], starts[runs[-1]] + sizes[runs[-1]]
            counts[i:i + block] = _bit_counts(hashes[lo:hi], starts[runs] - lo)
        bits = (2 * counts > sizes[some][:, None]).astype(np.uint64)
        out[some] = (bits << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _bit_counts(hashes: np.ndarray, starts: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    totals = np.zeros((len(starts), BITS), np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at:at + block]
        first = max(0, int(np.searchsorted(starts, at, side="right")) - 1)
        last = int(np.searchsorted(starts, at + len(part), side="left"))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.maximum(starts[first:last] - at, 0)
        totals[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return totals


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, digest``: the fingerprint as a signed 64-bit integer and the
    text's MD5."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for rows in text_slices(batches):
            hashes = [shingle_hashes(t, shingle) for _, t in rows]
            sizes = np.fromiter(map(len, hashes), np.int64, len(rows))
            flat = np.array([h for x in hashes for h in x], np.uint64)
            fp = majority_bits(flat, np.cumsum(sizes) - sizes, sizes)
            digests = [md5(t.encode("utf-8"), usedforsecurity=False).digest() for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array(fp.view(np.int64)), pa.array(digests, pa.binary())],
                names=["doc_id", "fp", "digest"])

    return source.mapInArrow(run, "doc_id long, fp long, digest binary")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _ones(width: int) -> int:
    return (1 << width) - 1


def _mask(bits: int) -> Column:
    """The low 64 bits of an integer as a signed literal."""
    bits &= _ones(BITS)
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(_mask(_ones(width)))


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos.cast("int"))


def _meet(variants: DataFrame, max_bits: int, extra: list[str]) -> DataFrame:
    """Pairs ``a < b`` of fingerprints within ``max_bits`` that share a variant
    (and the ``extra`` columns); each pair passes at its first possible one.

    Spark sizes a table of variants by its columns, not by the 64 rows that each
    fingerprint becomes, so the join is named: never broadcast."""
    segments = _segments(max_bits)
    left = variants.select(*[F.col(c).alias("l_" + c) for c in variants.columns])
    right = variants.select(*[F.col(c).alias("r_" + c) for c in variants.columns])
    differing = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    cond = F.bit_count(differing) <= max_bits
    cond = cond & (F.col("l_fp") < F.col("r_fp"))
    for c in ["seg", "pos", "rest", *extra]:
        cond = cond & (F.col("l_" + c) == F.col("r_" + c))
    here = F.lit(False)
    for s, (shift, width) in enumerate(segments):
        own = _part(differing, shift, width)
        at = (own == _bit(F.col("l_pos"))) | ((own == 0) & (F.col("l_pos") == 0))
        for before in segments[:s]:
            at = at & (F.bit_count(_part(differing, *before)) > 1)
        here = here | ((F.col("l_seg") == s) & at)
    return left.join(right.hint("merge"), cond & here).select(F.col("l_fp").alias("a"), F.col("r_fp").alias("b"),
                                                *[F.col("l_" + c).alias(c) for c in extra])


def outside_pieces(max_bits: int = MAX_BITS) -> Column:
    """``(piece, same)`` of the bits of ``fp`` outside the segment ``seg``: they
    differ by ``max_bits`` at most, so of one piece more, about equally wide, one is equal."""
    fp, pieces = F.col("fp"), max_bits + 1
    split = F.lit(None).cast("array<struct<piece:int,same:bigint>>")
    for s, (shift, w) in enumerate(_segments(max_bits)):
        outside = fp.bitwiseAND(_mask(_ones(shift)))
        if shift + w < BITS:
            outside = outside.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift + w), shift))
        edges = [(BITS - w) * i // pieces for i in range(pieces + 1)]
        split = F.when(F.col("seg") == s, F.array(*[
            F.struct(F.lit(i).alias("piece"), _part(outside, x, y - x).alias("same"))
            for i, (x, y) in enumerate(zip(edges, edges[1:]))])).otherwise(split)
    return split


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Pairs ``a, b`` of the distinct fingerprints ``fp`` within ``max_bits``."""
    segments = _segments(max_bits)
    fp = F.col("fp")
    values = F.array(*[F.struct(F.lit(s).alias("seg"), _part(fp, *cut).alias("value")) for s, cut in enumerate(segments)])
    by_segment = fps.select("fp", F.inline(values))
    wild = [F.struct(F.lit(s).alias("seg"), F.lit(p).alias("pos"),
                     _part(fp, shift, width).bitwiseAND(_mask(~(1 << p))).alias("rest"))
            for s, (shift, width) in enumerate(segments) for p in range(width)]
    variants = fps.select("fp", F.inline(F.array(*wild)))

    crowded = written(by_segment.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > hot_segment), "crowded")
    if crowded.isEmpty():
        return _meet(variants, max_bits, [])
    # buckets that a crowded segment value falls into: one for each wildcard
    width = F.create_map(*[F.lit(x) for s, (_, w) in enumerate(segments) for x in (s, w)])[F.col("seg")]
    pos = F.explode(F.sequence(F.lit(0), width - 1)).alias("pos")
    hot = written(crowded.select("seg", "value", pos)
                  .select("seg", "pos", F.col("value").bitwiseAND(F.bitwise_not(_bit(F.col("pos"))))
                          .alias("rest")).distinct(), "hot")  # its own size decides how it is joined
    key = ["seg", "pos", "rest"]
    cold_pairs = _meet(variants.join(hot, key, "left_anti"), max_bits, [])
    fine = variants.join(hot, key, "left_semi").select("fp", *key, F.inline(outside_pieces(max_bits)))
    hot_pairs = _meet(fine, max_bits, ["piece", "same"]).select("a", "b").distinct()
    return cold_pairs.union(hot_pairs)


def rooted(prints: DataFrame, max_bits: int = MAX_BITS, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Add ``root``, the least fingerprint of the component, to rows with ``fp``."""
    fps = written(prints.select("fp").distinct(), "fps")
    linked = written(components(links(fps, max_bits, hot_segment)), "roots")
    return (prints.join(linked, prints["fp"] == linked["node"], "left")
            .withColumn("root", F.coalesce("root", "fp")).drop("node"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id``."""
    rows = rooted(written(fingerprints(docs, shingle, id_col, text_col), "prints").drop("digest"), max_bits)
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "_root")
    return rows.join(ids, F.col("root") == F.col("_root")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the
    smallest id (null ids last, equal ids by the text's MD5), once."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    own, keep_id, keep_digest = unused(docs, "_own_digest", "_keep_id", "_keep_digest")
    keep = rooted(prints, max_bits).groupBy("root").agg(first.alias("k")).select(
        F.col("k.doc_id").alias(keep_id), F.col("k.digest").alias(keep_digest))
    rows = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    kept = rows.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(keep_id))
                     & (F.col(own) == F.col(keep_digest)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)
