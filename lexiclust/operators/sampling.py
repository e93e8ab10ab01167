"""Repeatable sampling and training-set preparation.

Randomness is an md5 of ``seed:key`` so a sample is the same on any cluster
size, on re-run after executor loss, and in the SQL oracle.  numpy's
generator stream is not reproduced (documented deviation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import hash_int, hash_key


def sample_exact(df: DataFrame, n: int, key_cols: list[str], seed=1984) -> DataFrame:
    """Exactly ``n`` rows without replacement (all if fewer): the ``n``
    smallest hash keys.  Planned as per-partition top-n + one merge of n rows
    per partition, so n (not the table) bounds the final task."""
    return df.withColumn("_h", hash_key(seed, *key_cols)).orderBy("_h", *key_cols).limit(n).drop("_h")


#: hash prefixes counted at once: 16 to this power
PREFIX = 4
#: hashes of a border bucket that are looked at one by one
BORDER_ROWS = 10_000


def _border_hashes(hashes: DataFrame, ranks: list[int], prefix: int = PREFIX, border_rows: int = BORDER_ROWS) -> list[str | None]:
    """The hash of each rank (from 0) in the order of ``hashes(_h)``, None beyond
    the last row.  A histogram of hash prefixes finds the bucket of every rank;
    buckets of more than ``border_rows`` rows are cut by longer prefixes, and only
    the rows of what remains are sorted."""
    found: dict[int, str | None] = {}
    open_ = {"": [(r, r) for r in sorted(set(ranks))]}  # bucket: (rank in the whole, rank in the bucket)
    depth = 0
    while open_:
        depth += prefix
        start = F.substring("_h", 1, depth - prefix)
        counts = hashes.where(start.isin(list(open_))).groupBy(F.substring("_h", 1, depth).alias("p")).count()
        counts = sorted((r["p"], r["count"]) for r in counts.collect())  # 16 ** prefix rows a border at most
        small, deeper = {}, {}
        for bucket, wanted in open_.items():
            inside = [(p, n) for p, n in counts if p.startswith(bucket)]
            for rank, left in wanted:
                at = iter(inside)
                p, n = next(at, (None, 0))
                while p is not None and left >= n:
                    left -= n
                    p, n = next(at, (None, 0))
                if p is None:
                    found[rank] = None
                elif n <= border_rows or depth >= 32:
                    small.setdefault(p, []).append((rank, left))
                else:
                    deeper.setdefault(p, []).append((rank, left))
        if small:
            border = hashes.where(F.substring("_h", 1, depth).isin(list(small))).select("_h")
            rows = sorted(r["_h"] for r in border.collect())  # border_rows a border at most
            for p, wanted in small.items():
                own = [h for h in rows if h.startswith(p)]
                found.update((rank, own[left]) for rank, left in wanted)
        open_ = deeper
    return [found[r] for r in ranks]


def split_exact(df: DataFrame, sizes: dict[str, int] | None, key_cols: list[str], seed=1984,
                fractions: dict[str, float] | None = None, out_col: str = "split") -> DataFrame:
    """Disjoint splits in hash order of a unique key; order of the dict = order of cuts.

    With ``sizes`` (row counts) the parts have exactly those sizes and rows
    beyond them get no split and are left out.  With ``fractions`` every part
    has ``floor(f * n)`` rows and the last one takes all that remain.

    Nothing is sorted or joined: the cuts are hash values, found on the narrow
    column of hashes (``_border_hashes``), and a row's split follows from its own
    hash by comparison."""
    h = hash_key(seed, *key_cols)
    hashes = cut_lineage(df.select(h.alias("_h")))
    if sizes is None:
        n = hashes.count()
        sizes = {k: int(f * n) for k, f in (fractions or {}).items()}
    ends, total = [], 0
    for size in sizes.values():
        total += int(size)
        ends.append(total)
    cuts = _border_hashes(hashes, ends)
    if fractions:
        cuts[-1] = None
    expr, low, before = None, None, 0
    for name, end, cut in zip(sizes, ends, cuts):
        if end > before or (fractions and name == list(sizes)[-1]):
            test = F.lit(True)
            if low is not None:
                test &= F.col("_h") >= low
            if cut is not None:
                test &= F.col("_h") < cut
            expr = F.when(test, F.lit(name)) if expr is None else expr.when(test, F.lit(name))
        if cut is None:
            break
        low, before = cut, end
    expr = F.lit(None).cast("string") if expr is None else expr
    return df.withColumn("_h", h).withColumn(out_col, expr).drop("_h").where(F.col(out_col).isNotNull())


def split_fractions(df: DataFrame, fractions: dict[str, float], key_cols: list[str], seed=1984,
                    out_col: str = "split") -> DataFrame:
    """As ``split_exact`` with sizes ``floor(f * count)``, the last part with the
    remainder (one count action)."""
    return split_exact(df, None, key_cols, seed, fractions=fractions, out_col=out_col)


def replicate_by_freq(freq: DataFrame, divisor: int = 20, cnt_col: str = "cnt") -> DataFrame:
    """Repeat each row ``max(1, floor(cnt / divisor))`` times (``copy_no`` 1..)."""
    reps = F.greatest(F.lit(1), F.floor(F.col(cnt_col) / divisor)).cast("int")
    return freq.withColumn("copy_no", F.explode(F.sequence(F.lit(1), reps))) \
               .withColumn("copy_no", F.col("copy_no").cast("long"))


def random_crops(docs: DataFrame, batch: int = 16, window: int = 256, seed=0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``batch`` hash-chosen windows of ``window`` characters per text long
    enough; x = window[:-1], y = window[1:] (next-character targets)."""
    n = F.length(text_col)
    eligible = docs.where(n > window)
    crops = eligible.select(id_col, text_col, F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("b"))
    start = F.pmod(hash_int(seed, id_col, "b"), F.length(text_col) - window)
    crops = crops.withColumn("start", start.cast("long"))
    return crops.select(id_col, F.col("b").cast("long").alias("b"), "start",
                        F.expr(f"substring({text_col}, start + 1, {window - 1})").alias("x"),
                        F.expr(f"substring({text_col}, start + 2, {window - 1})").alias("y"))


def mask_tokens(lines: DataFrame, block: int = 16, rate_pct: int = 15, seed=0,
                id_cols: tuple[str, ...] = ("doc_id", "line_no"), text_col: str = "line") -> DataFrame:
    """Line-by-line blocks of at most ``block`` whitespace tokens; a token is a
    prediction target when ``hash % 100 < rate_pct``."""
    from ..functions.text import posexplode_rows, words
    blk = posexplode_rows(lines, F.slice(words(text_col), 1, block), "tok_no", "token", *id_cols)
    target = (F.pmod(hash_int(seed, *id_cols, "tok_no"), 100) < rate_pct).cast("int")
    return blk.withColumn("is_target", target)
