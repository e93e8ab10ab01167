"""Removal of long repeated byte strings by suffix-array intervals.

A window is a string of ``min_bytes`` bytes; a window that starts anywhere else
as well is removed from every place, within and across documents.

1. Every window has a key, the least hash of the grams inside it; equal windows
   have equal keys.  Neighbouring windows with one key form a segment, so the
   corpus is a narrow table of segments ``(key, digest, document, start)``.
2. Segments that are equal as a whole are settled by counting.  Of the other
   segments that share a key one of each kind is fetched and keys are dealt
   over tasks, whole keys together.
3. A task builds the suffix array and the Burrows-Wheeler transform of a block
   of segments and expands intervals breadth-first by backward extension: the
   intervals of all strings of one length give the next length's, and the right
   border of a new interval is known from then on.  The first intervals are those
   of an early round of the sort.  Expansion stops at ``min_bytes``; borders not
   known by then lie between suffixes that share a window.
4. Keys whose segments exceed a block are cut again with longer grams (halving
   the distance to the window's length), which parts what only touches a common
   passage from what holds it, until they fit; at the full length a key is the
   window's own hash and all is settled by counting.

Defined results: null text counts as empty; texts shorter than a window lose
nothing; rows that repeat id and text match each other; null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

MIN_BYTES = 400
GRAM = 64
#: the most bytes of segments that one key may have in a task
BLOCK_BYTES = 1_000_000
#: bytes of segments (of whole keys) that a task sorts at once: its arrays stay in the processor's cache
SORT_BYTES = 400_000
#: intervals are expanded from strings of one round of sorting, at most this part of a window
START = 4
#: windows of one segment at most; longer runs are cut
SEGMENT_WINDOWS = 4096
#: bytes of text hashed at once
SLICE_BYTES = 400_000
OCCURRENCE = "key long, digest binary, doc long, mark long, start long, windows int, inner boolean"

_rng = np.random.default_rng(20240613)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position, built from doubled lengths."""
    level, width, total, done = _BYTES[data], 1, None, 0
    rest, k = gram, 0
    while rest:
        if rest & 1:
            n = len(data) - done - width + 1
            part = level[done:done + n]
            total = part.copy() if total is None else total[:n] * _ODD[32 + k] + part
            done += width
        rest >>= 1
        if rest:
            level = level[:-width] * _ODD[k] + level[width:]
            width *= 2
            k += 1
    total ^= total >> np.uint64(32)
    total *= np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    return total


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by block prefixes and suffixes."""
    if width == 1:
        return values
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def segments(texts: list[bytes], gram: int, min_bytes: int = MIN_BYTES):
    """(text number, start, windows, key, inner) of all segments, as arrays;
    ``inner`` tells whether the least gram occurs twice, without which no two
    windows of a segment can be equal."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= min_bytes).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    grams = gram_hashes(data, gram)
    key = sliding_min(grams, min_bytes - gram + 1)
    # windows that begin a segment or follow the last of a text
    edge = np.ones(len(data) + 1, bool)
    edge[1:len(key)] = key[1:] != key[:-1]
    edge[len(key):] = False
    edge[starts[starts < len(data)]] = True
    inside = np.zeros(len(data) + 1, np.int32)
    some = sizes >= min_bytes
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - min_bytes + 1, -1)
    inside = np.cumsum(inside) > 0
    edge[ends[some] - min_bytes + 1] = True
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], len(data))
    real = inside[begin]
    begin, stop = begin[real], stop[real]
    windows = stop - begin
    if len(windows) and windows.max() > SEGMENT_WINDOWS:
        parts = -(-windows // SEGMENT_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + nth * SEGMENT_WINDOWS
        windows = np.minimum(np.repeat(stop, parts) - begin, SEGMENT_WINDOWS)
    text = np.searchsorted(ends, begin, side="right")
    own = key[begin]
    inner = np.zeros(len(begin), bool)
    for a in range(0, len(begin), 1000):
        sizes_ = windows[a:a + 1000] + (min_bytes - gram)
        first = np.cumsum(sizes_) - sizes_
        at = np.arange(sizes_.sum()) + np.repeat(begin[a:a + 1000] - first, sizes_)
        least = grams[at] == np.repeat(own[a:a + 1000], sizes_)
        inner[a:a + 1000] = np.add.reduceat(least, first, dtype=np.int32) > 1
    return text, begin - starts[text], windows, own.view(np.int64), inner


def suffix_ranks(codes: np.ndarray, rest: np.ndarray, limit: int):
    """Rank of each suffix by its first ``limit`` letters (at least), and the ranks
    by the first ``depth`` letters from which intervals are expanded.

    ``codes`` is 0 for separators, ``rest`` counts the letters before the next one.
    No two separators are equal: a suffix that reaches its own is settled.  Several
    letters make the first key, each further round triples the depth (doubles it in
    very large blocks) and sorts ties only."""
    n = len(codes)
    base = int(codes.max()) + 1
    most = max(1, min(int(62 / np.log2(max(base, 2))), limit, n))
    depth, key = 1, codes.astype(np.int64)
    while 2 * depth <= most:  # of the letters before the separator
        tail = key[depth:] * (rest[:n - depth] > depth)
        key *= base ** depth
        key[:n - depth] += tail
        depth *= 2
    rank = np.empty(n, np.int32)
    parts = 3 if (n + 2) ** 3 < 1 << 63 else 2
    open_ = place = np.arange(n, dtype=np.int32)  # suffixes, and the ranks they share out
    start = None
    while True:
        o = np.argsort(key)
        open_, key = open_[o], key[o]
        edge = np.ones(len(o) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=edge[1:-1])
        first = np.flatnonzero(edge)
        group = np.repeat(place[first[:-1]], np.diff(first))
        left = rest[open_]
        settled = left < depth
        tied = ~(edge[1:] & edge[:-1])
        if start is None:  # equal up to the separator: in the order of the separators
            alike = np.flatnonzero(settled & tied)
            open_[alike] = open_[alike][np.lexsort((open_[alike], group[alike]))]
        tied &= ~settled
        rank[open_] = np.where(settled, place, group)
        if start is None or depth * START <= limit:
            start = depth, rank.copy()
        open_, place, head, left = open_[tied], place[tied], group[tied], left[tied]
        if not len(open_):
            break
        if depth >= limit:
            rank[open_] = place
            break
        key = head.astype(np.int64)
        for i in range(1, parts):
            key *= n + 1
            there = left >= i * depth
            key += np.where(there, rank[np.where(there, open_ + i * depth, 0)] + 1, 0)
        depth *= parts
    return rank, *start


def repeated_windows(texts: list[bytes], min_bytes: int = MIN_BYTES) -> list[np.ndarray]:
    """For each text the sorted starts of windows that start anywhere else too."""
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    n = int(sizes.sum()) + m
    ends = np.cumsum(sizes + 1) - 1  # places of the separators
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    present = np.zeros(256, bool)
    present[data] = True
    codes = np.cumsum(present, dtype=np.int32)[data]
    codes[ends] = 0
    rest = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.int32)
    rank, depth, head = suffix_ranks(codes, rest, min_bytes)
    suffix = np.empty(n, np.int32)
    suffix[rank] = np.arange(n, dtype=np.int32)
    first = codes[suffix].astype(np.int16)
    # step back from the suffix at each rank: the rank of the longer suffix
    longer = rank[suffix - 1].astype(np.int64)
    longer[(suffix == 0) | (codes[suffix - 1] == 0)] = -1

    # strings of ``depth`` letters, and of fewer with a separator at the end; a border is
    # known once a shorter string has ended there
    head = head[suffix]
    known = np.ones(n + 1, bool)
    known[1:n] = head[1:] != head[:-1]
    lb = np.flatnonzero(known[:n])
    rb = np.append(lb[1:], n) - 1
    whole = rest[suffix[lb]] >= depth - 1
    lb, rb = lb[whole], rb[whole]
    scratch = np.full(n, -1, np.int32)
    for _ in range(depth, min_bytes):
        if not len(lb):
            break
        sizes_ = rb - lb + 1
        upto = np.cumsum(sizes_)
        parent = np.repeat(np.arange(len(lb)), sizes_)
        to = longer[np.arange(upto[-1]) + (lb - upto + sizes_)[parent]]
        if 8 * len(to) > n:
            real = to >= 0
            scratch[to[real]] = parent[real]
            to = np.flatnonzero(scratch >= 0)
            parent = scratch[to]
            scratch[to] = -1
        else:
            both = np.sort((to << 32) | parent)
            both = both[np.searchsorted(both, 0):]
            to, parent = both >> 32, both & 0xFFFFFFFF
        if not len(to):
            break
        letter = first[to]
        cut = np.ones(len(to) + 1, bool)
        cut[1:-1] = (to[1:] != to[:-1] + 1) | (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
        lb, rb = to[cut[:-1]], to[cut[1:]]
        new = ~known[rb + 1]
        lb, rb = lb[new], rb[new]
        known[rb + 1] = True
    open_ = ~known  # shared prefixes of min_bytes or more
    hit = np.sort(suffix[open_[:-1] | open_[1:]])
    text = np.searchsorted(ends, hit)
    starts = ends - sizes
    cuts = np.searchsorted(text, np.arange(m + 1))
    return [hit[cuts[i]:cuts[i + 1]] - starts[i] for i in range(m)]


def _occurrences(docs: DataFrame, gram: int, min_bytes: int) -> DataFrame:
    """Narrow table of the segments of ``doc, mark, text``."""
    def run(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            done = 0
            texts_only = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["doc", "text"])
            for rows in text_slices([texts_only], SLICE_BYTES):
                texts = [t.encode("utf-8") for _, t in rows]
                ids = np.array([i for i, _ in rows], np.int64)
                text, start, windows, key, inner = segments(texts, gram, min_bytes)
                own = marks[done:done + len(rows)]
                done += len(rows)
                digests = [xxh3_128_digest(texts[t][a:a + w + min_bytes - 1])
                           for t, a, w in zip(text.tolist(), start.tolist(), windows.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(digests, pa.binary()), pa.array(ids[text], pa.int64()), pa.array(own[text], pa.int64()), pa.array(start, pa.int64()), pa.array(windows.astype(np.int32)),
                     pa.array(inner)], names=["key", "digest", "doc", "mark", "start", "windows", "inner"])

    return docs.mapInArrow(run, OCCURRENCE)


def _cut_again(hot: DataFrame, gram: int, min_bytes: int) -> DataFrame:
    """Occurrences, with their bytes, of the segments of segments."""
    def run(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column("bytes").to_pylist()
                text, start, windows, key, inner = segments(texts, gram, min_bytes)
                cut = [texts[t][s:s + w + min_bytes - 1] for t, s, w in zip(text.tolist(), start.tolist(), windows.tolist())]
                base = part.column("start").to_numpy(zero_copy_only=False)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(map(xxh3_128_digest, cut), pa.binary()), part.column("doc").take(at),
                     part.column("mark").take(at), pa.array(base[text] + start), pa.array(windows.astype(np.int32)),
                     pa.array(inner), pa.array(cut, pa.binary())],
                    names=["key", "digest", "doc", "mark", "start", "windows", "inner", "bytes"])

    return hot.select("doc", "mark", "start", "bytes").mapInArrow(run, OCCURRENCE + ", bytes binary")


def _expanded(need: DataFrame, min_bytes: int) -> DataFrame:
    """``doc, mark, start, windows`` of the repeated runs inside the segments of
    ``need`` that occur once; whole keys come to a task, which works on blocks."""
    def work(held):
        texts, *known = zip(*held)
        doc, mark, start, n = (np.array(x, np.int64) for x in known)
        found = repeated_windows(list(texts), min_bytes)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        hits = np.concatenate(found)
        once = n[text] == 1
        text, hits = text[once], hits[once]
        cut = np.ones(len(hits) + 1, bool)
        cut[1:-1] = (hits[1:] != hits[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(cut)
        text, first = text[begin[:-1]], hits[begin[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[text], mark[text], start[text] + first, np.diff(begin))],
                                          names=["doc", "mark", "start", "windows"])

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("key", "bytes", "doc", "mark", "start", "n")]
            for row in zip(*(c.to_pylist() for c in columns)):
                if size >= SORT_BYTES and row[0] != key:
                    yield work(held)
                    held, size = [], 0
                key = row[0]
                held.append(row[1:])
                size += len(row[1])
        if held:
            yield work(held)

    dealt = need.select("key", "bytes", "doc", "mark", "start", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc long, mark long, start long, windows long")


def _fetched(need: DataFrame, docs: DataFrame, min_bytes: int) -> DataFrame:
    """Add the segments' bytes, cut out of the documents."""
    wanted = need.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "start", "windows", "n", "key_bytes")).alias("_cuts"))
    joined = docs.join(wanted, ["doc", "mark"]).dropDuplicates(["doc", "mark"]).select("doc", "mark", "text", "_cuts")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("doc", "mark", "text", "_cuts")))
            out, held = [], 0
            for doc, mark, text, cuts in rows:
                data = text.as_py().encode("utf-8")
                for c in cuts.as_py():
                    piece = data[c["start"]:c["start"] + c["windows"] + min_bytes - 1]
                    out.append((c["key"], piece, doc.as_py(), mark.as_py(), c["start"], c["windows"], c["n"],
                                c["key_bytes"]))
                    held += len(piece)
                if held > 4_000_000:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    def pack(out):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          names=["key", "bytes", "doc", "mark", "start", "windows", "n", "key_bytes"])

    return joined.mapInArrow(
        run, "key long, bytes binary, doc long, mark long, start long, windows int, n long, key_bytes long")


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc, mark, start, windows``: runs of windows of ``doc, mark, text`` that
    start anywhere else as well (a run may come in parts)."""
    spans = None
    gram = max(1, min(gram, (min_bytes + 1) // 2))
    found = written(_occurrences(docs, gram, min_bytes), "segments")
    with_bytes = False
    while True:
        if gram == min_bytes:  # a key is one window
            # the windows of a segment are equal here: the first one's SHA-256 stands for its bytes beside the key
            window = F.sha2(F.substring("bytes", 1, min_bytes), 256) if with_bytes else F.lit("")
            found = found.withColumn("_window", window)
            shared = found.groupBy("key", "_window").agg(F.sum("windows").alias("_n")).where("_n > 1").select("key", "_window")
            last = found.join(shared, ["key", "_window"], "left_semi").select("doc", "mark", "start", F.col("windows").cast("long"))
            return last if spans is None else spans.unionByName(last)
        keys = (found.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("inner").alias("_inner"))
                .where("_n > 1 OR _inner").select("key"))
        found = written(found.join(keys, "key", "left_semi"), "shared")
        place = F.struct("doc", "mark", "start", "windows", *(["bytes"] if with_bytes else []))
        kinds = written(found.groupBy("key", "digest").agg(
            F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"),
            F.min_by(place, F.struct("doc", "mark", "start")).alias("place"))
            .select("key", "digest", "n", "inner", "place.*"), "kinds")
        equal = found.join(kinds.where("n > 1").select("key", "digest"), ["key", "digest"], "left_semi").select(
            "doc", "mark", "start", F.col("windows").cast("long").alias("windows"))
        sizes = (kinds.groupBy("key").agg(F.count(F.lit(1)).alias("_kinds"), F.max("inner").alias("_inner"),
                                          F.sum(F.col("windows") + min_bytes).alias("key_bytes"))
                 .where("_kinds > 1 OR _inner").select("key", "key_bytes"))
        need = kinds.join(sizes, "key")
        if not with_bytes:
            need = _fetched(need, docs, min_bytes)
        need = written(need, "need")
        inside = _expanded(need.where(F.col("key_bytes") <= block_bytes), min_bytes)
        both = written(equal.unionByName(inside), "spans")
        spans = both if spans is None else spans.unionByName(both)
        hot = need.where(F.col("key_bytes") > block_bytes)
        if hot.isEmpty():
            return spans
        gram = (gram + min_bytes + 1) // 2
        found = written(_cut_again(hot, gram, min_bytes), "segments")
        with_bytes = True


def deduplicate(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text",
                keep_bytes: bool = False, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with
    ``keep_bytes``, the remaining bytes as ``kept``, with ``keep_text`` as ``text``
    (a character that a cut goes through becomes U+FFFD)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    source = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0)).alias("doc"),
                         F.xxhash64(doc.isNull(), text).alias("mark"), text.alias("text"))
    spans = repeated_spans(source.drop("doc_id"), min_bytes)
    cuts = (spans.groupBy("doc", "mark").agg(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("windows") + (min_bytes - 1)).alias("stop"))).alias("_cuts")))
    joined = source.join(cuts, ["doc", "mark"], "left")

    def run(batches):
        from hashlib import sha256
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for doc, text, cuts in zip(*(batch.column(c) for c in ("doc_id", "text", "_cuts"))):
                data, kept, at, spans, removed = text.as_py().encode("utf-8"), [], 0, 0, 0
                for c in sorted((c["start"], c["stop"]) for c in cuts.as_py() or ()):
                    if c[0] > at or not spans:
                        kept.append(data[at:c[0]])
                        spans += 1
                        at = c[0]
                    removed += max(0, c[1] - at)
                    at = max(at, c[1])
                kept = b"".join([*kept, data[at:]])
                for column, x in zip(out, (doc.as_py(), len(data), removed, spans, sha256(kept).hexdigest(), kept if keep_bytes else None,
                                       kept.decode("utf-8", "replace") if keep_text else None)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()),
                 *([pa.array(out[5], pa.binary())] if keep_bytes else []), *([pa.array(out[6], pa.string())] if keep_text else [])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                       *(["kept"] if keep_bytes else []), *(["text"] if keep_text else [])])

    return joined.select("doc_id", "text", "_cuts").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if keep_bytes else "") + (", text string" if keep_text else ""))
