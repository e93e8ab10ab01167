"""Ranked lexical search with pair-bound MaxScore over an index in shards.

One pass over the texts writes a narrow forward table: per document its length
and the counts of the terms that any query holds.  Corpus statistics come from
all rows of it.  A shard is a run of its documents; its index holds each term's
postings with their parts of the impact and the largest impact, and, for pairs of
terms that stand next to each other in a query's order of rarity, the intersection
list with its largest joint impact.  The index is one row a shard, written to the
shared folder.

A query is answered in every shard and the best rows of all shards are merged.
Its terms are matched to disjoint pairs, those first whose bound
``max(joint, first alone, second alone)`` saves most against the sum of the two
term maxima.  Pairs and single terms in falling order of bound are essential
until the bounds left cannot reach the threshold; only documents of essential
lists are candidates.  For the rest a candidate in a pair's intersection list is
held against the joint maximum, any other against the larger of the two term
maxima, and those whose bound falls below the threshold go before the single
postings are looked up.  The threshold starts at the k-th largest
impact that any list of the query has in any one shard: k documents reach it, so
it holds in every shard.  All skipping is safe: results equal an exhaustive scoring.

Scores are whole numbers.  With N documents that hold a term, L terms in all, n
in the document, and df documents with the term: ``w = floor(1000 * ln((2 N + 2)
/ (2 df + 1)))``, ``m = 100 - 90 + ((90 n N) div L)``, and a term adds
``w * ((10^9 tf) div (1000 tf + 8 m))``.

Defined results: null and empty texts are no documents and no hits; a query
without terms (or null) has no rows; texts are read whole whatever their length;
equal scores rank by id, a null id first; repeated documents each count and rank
on their own; repeated query rows (same id and text) count once; empty tables
give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written

#: terms of queries that are held in memory at once; more queries go block by block
BLOCK_TERMS = 200_000
#: documents of a shard, 65,536 at most
SHARD_DOCS = 2048
SHARDS_PER_TASK = 4
#: postings of a shard, beyond which it is closed early
SHARD_POSTINGS = 1_500_000
#: each term is paired with so many that follow it in a query's order of rarity
NEIGHBOURS = 2

# Every byte that no term holds becomes a space, A-Z become a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8 bytes."""
    return (text or "").encode("utf-8").translate(_TERM).split()


def forward_table(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, term, tf`` of every document with a term: its number of terms,
    and the numbers and counts of those in the vocabulary (arrays, by number)."""
    def run(batches):
        for held in text_slices(batches, 1_000_000):
            ids, lengths, bounds, found, counts = [], [], [0], [], []
            for i, text in held:
                words = terms(text)
                if not words:
                    continue
                hits = np.array([vocabulary[w] for w in words if w in vocabulary], np.int32)
                number, tf = np.unique(hits, return_counts=True)
                ids.append(i)
                lengths.append(len(words))
                found.append(number)
                counts.append(tf)
                bounds.append(bounds[-1] + len(number))
            if ids:
                at = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(np.concatenate(found), pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(np.concatenate(counts).astype(np.int64), pa.int64()))],
                    names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n long, term array<int>, tf array<long>")


def statistics(forward: DataFrame, n_terms: int):
    """``N, L`` and the array of document frequencies of all vocabulary terms."""
    n, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for r in forward.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # one row a vocabulary term
        df[r["t"]] = r["count"]
    return n, total, df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000.0 * np.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def term_pairs(queries: list[np.ndarray], df: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Distinct pairs (smaller number first, as rows) of terms that follow one
    another at most ``neighbours`` places apart in a query's order of rarity."""
    pairs = set()
    for q in queries:
        rare = q[np.lexsort((q, df[q]))].tolist()
        for gap in range(1, neighbours + 1):
            pairs.update((min(a, b), max(a, b)) for a, b in zip(rare, rare[gap:]))
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


class Shard:
    """Lists of some documents by ``cut``: ``doc`` holds the documents of all terms
    and then of all pairs, ``part`` for the terms the impact without the weight;
    ``top`` is the largest impact of each list, ``kth`` the k-th largest (0 of
    shorter lists)."""

    def __init__(self, doc, part, cut, top, kth, weight):
        self.doc, self.part, self.cut, self.top, self.kth, self.weight = doc, part, cut, top, kth, weight

    def docs(self, unit: int):
        return self.doc[self.cut[unit]:self.cut[unit + 1]].astype(np.int64)

    def impacts(self, term: int):
        return self.weight[term] * self.part[self.cut[term]:self.cut[term + 1]].astype(np.int64)


def build_shard(lengths, term, tf, bounds, pairs, weight, n: int, total: int, k: int):
    """The index of the documents whose terms lie between ``bounds``."""
    doc = np.repeat(np.arange(len(lengths)), np.diff(bounds))
    m = 10 + 90 * lengths * n // total
    part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])  # under 10^6
    order = np.lexsort((doc, term))
    doc, part = doc[order].astype(np.uint16), part[order].astype(np.int32)
    cut = np.searchsorted(term[order], np.arange(len(weight) + 1))
    n_terms = len(weight)
    docs, sizes = [doc], np.zeros(len(pairs), np.int64)
    top, kth = np.zeros(n_terms + len(pairs), np.int64), np.zeros(n_terms + len(pairs), np.int64)
    single = Shard(doc, part, cut, top, kth, weight)

    def bounded(unit, impacts):
        top[unit] = impacts.max()
        if len(impacts) >= k:
            kth[unit] = np.partition(impacts, len(impacts) - k)[-k]

    for t in np.flatnonzero(np.diff(cut)).tolist():
        bounded(t, single.impacts(t))
    for i, (a, b) in enumerate(pairs.tolist()):
        if not top[a] or not top[b]:
            continue
        shared, at_a, at_b = np.intersect1d(doc[cut[a]:cut[a + 1]], doc[cut[b]:cut[b + 1]], assume_unique=True, return_indices=True)
        if len(shared):
            sizes[i] = len(shared)
            docs.append(shared)
            bounded(n_terms + i, single.impacts(a)[at_a] + single.impacts(b)[at_b])
    cut = np.concatenate([cut, cut[-1] + np.cumsum(sizes)])
    return Shard(np.concatenate(docs), part, cut.astype(np.int32), top, kth, weight)


def build_index(forward: DataFrame, pairs: np.ndarray, weight: np.ndarray, n: int, total: int, k: int,
                shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row a shard: ``ids`` of its documents and its lists as packed numbers."""
    def pack(rows):
        ids, lengths, found, counts = zip(*rows)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        s = build_shard(np.array(lengths, np.int64), np.concatenate(found).astype(np.int64),
                        np.concatenate(counts).astype(np.int64), bounds, pairs, weight, n, total, k)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())),
             *(pa.array([x.tobytes()], pa.binary()) for x in (s.doc, s.part, s.cut, s.top, s.kth))],
            names=["ids", "doc", "part", "cut", "top", "kth"])

    def run(batches):
        held, postings = [], 0
        for batch in batches:
            term, tf = batch.column(2), batch.column(3)
            terms_, t_at = term.values.to_numpy(zero_copy_only=False), term.offsets.to_numpy()
            counts, c_at = tf.values.to_numpy(zero_copy_only=False), tf.offsets.to_numpy()
            for i, (doc, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = terms_[t_at[i]:t_at[i + 1]]
                if not len(found):
                    continue  # counts in the statistics only
                held.append((doc, length, found, counts[c_at[i]:c_at[i + 1]]))
                postings += len(found)
                if len(held) >= shard_docs or postings >= shard_postings:
                    yield pack(held)
                    held, postings = [], 0
        if held:
            yield pack(held)

    return forward.mapInArrow(run, "ids array<long>, doc binary, part binary, cut binary, top binary, kth binary")


def floors(index: DataFrame, units: int) -> np.ndarray:
    """For every list the largest ``kth`` of all shards."""
    def run(batches):
        most = np.zeros(units, np.int64)
        for batch in batches:
            for x in batch.column(0):
                most = np.maximum(most, np.frombuffer(x.as_py(), np.int64))
        some = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(most[some])], names=["unit", "kth"])

    out = np.zeros(units, np.int64)
    for r in index.select("kth").mapInArrow(run, "unit long, kth long").groupBy("unit").agg(F.max("kth").alias("kth")).collect():
        out[r["unit"]] = r["kth"]  # one row a list of this block of queries
    return out


def matched_units(query: np.ndarray, s: Shard, pair_of: dict, n_terms: int, df: np.ndarray, neighbours: int = NEIGHBOURS):
    """The query's terms as disjoint units ``(bound, pair unit or -1, terms)``, by falling bound."""
    rare = query[np.lexsort((query, df[query]))].tolist()
    savings = []
    for gap in range(1, neighbours + 1):
        for a, b in zip(rare, rare[gap:]):
            unit = n_terms + pair_of[min(a, b), max(a, b)]
            bound = max(int(s.top[unit]), int(s.top[a]), int(s.top[b]))
            savings.append((int(s.top[a]) + int(s.top[b]) - bound, unit, a, b, bound))
    savings.sort(key=lambda x: (-x[0], x[1]))
    units, free = [], set(rare)
    for saved, unit, a, b, bound in savings:
        if saved > 0 and a in free and b in free:
            free -= {a, b}
            units.append((bound, unit, (a, b)))
    units += [(int(s.top[a]), -1, (a,)) for a in free]
    return sorted((u for u in units if u[0] > 0), key=lambda u: (-u[0], u[2]))


def _found(docs: np.ndarray, listed: np.ndarray):
    """Where ``docs`` stand in the sorted ``listed``, and which of them do."""
    at = np.searchsorted(listed, docs)
    at[at == len(listed)] = 0
    return at, (listed[at] == docs) if len(listed) else np.zeros(len(docs), bool)


def search_shard(s: Shard, n_docs: int, units: list, k: int, threshold: int):
    """``(documents, scores)`` of a shard that may be among the k best of the
    corpus, a superset of the shard's part of them; ``threshold`` is a score that
    k documents of the corpus reach."""
    left = np.append(np.cumsum([u[0] for u in units][::-1])[::-1], 0)  # bound of a unit and all after it
    score, at = np.zeros(n_docs, np.int64), 0

    def raised(now, values):
        return max(now, int(np.partition(values, len(values) - k)[-k])) if len(values) >= k else now

    # essential lists: as long as a document met for the first time could still be among the best
    while at < len(units) and left[at] >= max(threshold, 1):
        for t in units[at][2]:
            score[s.docs(t)] += s.impacts(t)
        at += 1
        threshold = raised(threshold, score)
    docs = np.flatnonzero(score)
    mine = score[docs]
    while at < len(units):
        _, pair, members = units[at]
        after = left[at + 1]
        keep = mine + left[at] >= threshold
        docs, mine = docs[keep], mine[keep]
        if pair >= 0:
            _, both = _found(docs, s.docs(pair))
            most = max(int(s.top[t]) for t in members)
            keep = mine + np.where(both, s.top[pair], most) + after >= threshold
            docs, mine = docs[keep], mine[keep]
        for t in members:
            where, has = _found(docs, s.docs(t))
            mine[has] += s.impacts(t)[where[has]]
        at += 1
        threshold = raised(threshold, mine)
    keep = (mine >= threshold) & (mine > 0)
    return docs[keep], mine[keep]


def _blocks(items, block_terms: int):
    block, size = [], 0
    for row, words in items:
        if block and size + len(words) > block_terms:
            yield block
            block, size = [], 0
        block.append((row, words))
        size += len(words)
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame:
    """``query`` (number), ``doc_id, score``: the k best of every shard."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
    asked = [(row, np.array(sorted(vocabulary[w] for w in words), np.int64)) for row, words in block]
    forward = written(forward_table(docs, vocabulary, id_col, text_col), "forward")
    n, total, df = statistics(forward, len(vocabulary))
    if not n:
        return docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    weight = weights(n, df)
    pairs = term_pairs([q for _, q in asked], df)
    pair_of = {(a, b): i for i, (a, b) in enumerate(pairs.tolist())}
    # a file of the narrow table holds far more shards than a task should build
    dealt = forward.repartition(-(-n // (SHARDS_PER_TASK * shard_docs)), "doc_id")
    index = written(build_index(dealt, pairs, weight, n, total, k, shard_docs), "index")
    floor = floors(index, len(vocabulary) + len(pairs))
    starts = []
    for _, q in asked:
        own = [pair_of[tuple(p)] for p in term_pairs([q], df).tolist()]
        starts.append(int(floor[[*q, *(len(vocabulary) + i for i in own)]].max()))
    n_terms = len(vocabulary)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].as_py()
                s = Shard(*(np.frombuffer(batch.column(c)[i].as_py(), kind)
                            for c, kind in ((1, np.uint16), (2, np.int32), (3, np.int32), (4, np.int64), (5, np.int64))), weight)
                out = ([], [], [])
                for (row, query), start in zip(asked, starts):
                    found, score = search_shard(s, len(ids), matched_units(query, s, pair_of, n_terms, df), k, start)
                    best = sorted(((-v, ids[d] is not None, ids[d] or 0) for d, v in zip(found.tolist(), score.tolist())))[:k]
                    out[0].extend([row] * len(best))
                    out[1].extend(b[2] if b[1] else None for b in best)
                    out[2].extend(-b[0] for b in best)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS,
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every query.
    Queries are read to the driver in blocks of at most ``block_terms`` terms
    (a block's index is written before the next block starts)."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), F.col(query_text).cast("string").alias("text")).distinct()
    asked = written(asked.orderBy("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "queries")
    # row by row, one partition at a time: the driver holds one block of queries
    items = ((r["query"], sorted(set(terms(r["text"])))) for r in asked.select("query", "text").toLocalIterator())
    items = (x for x in items if x[1])
    found = None
    for block in _blocks(items, block_terms):
        part = _search_block(docs, block, k, id_col, text_col, shard_docs)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
known AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM known),
items AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM known)
  WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
impact AS (
  SELECT r, doc_id, tf.term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS v
  FROM tf JOIN df ON tf.term = df.term CROSS JOIN corpus),
scored AS (
  SELECT item_id, text, r, doc_id, sum(v)::BIGINT AS score FROM items JOIN impact ON items.term = impact.term
  GROUP BY item_id, text, r, doc_id HAVING sum(v) > 0),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scored)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
