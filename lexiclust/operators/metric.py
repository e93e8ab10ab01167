"""Exact radius joins by metric partitioning.

A bounded set of pivots (rows of least hash) cuts the rows into cells by nearest
pivot, and a cell into blocks of bounded size by distance to its pivot, further
by a hash of the id where many rows are equally far (copies).  A block knows the
range ``[lo, hi]`` of its members' pivot distances.  By the triangle inequality a
row x with radius r can only have partners in a block if

    d(x, pivot) - r <= hi   and   d(x, pivot) + r >= lo,

and in another cell only if ``(d(x, pivot) - d(x, own pivot)) / 2 <= r``.  Rows
are compared in the blocks that pass, and nothing is lost: the bounds are widened
by more than the rounding error.  How many blocks a row visits depends on the data:
a few where rows lie in clusters or few dimensions, all of them where all distances
are alike.  Blocks lie in a bounded number of bins, and a row is sent to a bin once
for all blocks there, so the traffic grows with the rows whatever the data.

Defined results: distances are ``sqrt(sum((x - y)^2))`` in float64; a null or NaN
radius has no partners; a row is not its own partner; ids should be unique (the
radii of an id that repeats ask for all its vectors); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairs import TILE, Near, exact_squares, near_tile

#: rows of a block
BLOCK_ROWS = 2048
#: bins at most, each of which one task holds: a row travels to a bin once
MOST_BINS = 48
#: rows of a bin, at least
BIN_ROWS = 512
#: pivots at most, whatever the number of rows
MOST_PIVOTS = 1024
#: relative widening of the bounds
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _rough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by dot products, and a bound of their error."""
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    size = a[:, None] + b[None, :]
    return size - 2.0 * (x @ y.T), 1e-12 * size * max(1, x.shape[1])


def pivots(rows: DataFrame, n: int, id_col: str = "id", vec_col: str = "v", most: int = MOST_PIVOTS) -> np.ndarray:
    """About ``sqrt(n)`` rows, ``most`` at most, as a matrix: those of least hash of the id."""
    k = max(1, min(most, math.isqrt(n)))
    picked = rows.select(vec_col).orderBy(F.xxhash64(id_col), id_col).limit(k).collect()  # bounded by ``most``
    return np.unique(np.array([r[vec_col] for r in picked], np.float64), axis=0)


def _placed(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """``rows(id, v, ...)`` with ``cell`` and ``far``: the nearest pivot and its distance."""
    at = rows.columns.index("v")

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(at))
            cell = np.zeros(len(m), np.int64)
            for s in range(0, len(m), 4096):
                cell[s:s + 4096] = _rough(m[s:s + 4096], points)[0].argmin(axis=1)
            diff = m - points[cell]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(np.sqrt(np.einsum("ij,ij->i", diff, diff)))],
                names=[*batch.schema.names, "cell", "far"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, cell long, far double")


def _blocks(placed: DataFrame, block_rows: int):
    """The rows with their block (``slice``, ``part`` of a cell), and one row a
    block with the range of its members' distances and least order."""
    cells = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n"),
        F.percentile_approx("far", [i / 64 for i in range(1, 64)], 1000).alias("grid"))
    # n blocks use every (64 / n)-th cut of the grid; beyond 64 the hash below cuts further
    cells = cells.select("cell", F.when(F.col("n") > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.least(F.col("n"), F.lit(64)) - 1),
        lambda i: F.element_at("grid", F.greatest(F.lit(1), F.floor(i * 64 / F.least(F.col("n"), F.lit(64)))).cast("int")))))
        .otherwise(F.array().cast("array<double>")).alias("cuts"))
    sliced = placed.join(cells, "cell").withColumn("slice", F.size(F.filter("cuts", lambda c: F.col("far") > c))).drop("cuts")
    sliced = cut_lineage(sliced)
    parts = sliced.groupBy("cell", "slice").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    dealt = sliced.join(parts, ["cell", "slice"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    bounds = dealt.groupBy("cell", "slice", "part").agg(
        F.min("far").alias("lo"), F.max("far").alias("hi"), F.min("order").alias("first"), F.count(F.lit(1)).alias("members"))
    return dealt, bounds


class _Blocks:
    """The blocks' cells, ranges and bins: one entry a block, about ``n / block_rows`` of them."""

    def __init__(self, bounds: list, points: np.ndarray, bins: int):
        def column(name, kind):
            return np.array([r[name] for r in bounds], kind)
        cells, self.cell = np.unique(column("cell", np.int64), return_inverse=True)
        self.centres = points[cells]
        self.lo, self.hi, self.members = column("lo", np.float64), column("hi", np.float64), column("members", np.int64)
        self.first = np.array([-np.inf if r["first"] is None else r["first"] for r in bounds], np.float64)
        before = np.cumsum(self.members) - self.members
        # blocks of one cell stay together, and bins have about equal numbers of rows
        self.bin = np.unique(before * bins // max(1, int(self.members.sum())), return_inverse=True)[1]
        self.starts = np.flatnonzero(np.append(True, self.bin[1:] != self.bin[:-1]))

    def part(self, bin_no: int) -> "_Blocks":
        """The blocks of one bin, with the pivots of their cells."""
        out, here = object.__new__(_Blocks), np.flatnonzero(self.bin == bin_no)
        cells, out.cell = np.unique(self.cell[here], return_inverse=True)
        out.centres, out.starts = self.centres[cells], np.zeros(1, np.int64)
        out.lo, out.hi, out.members, out.first = (x[here] for x in (self.lo, self.hi, self.members, self.first))
        return out

    def reached(self, x: np.ndarray, radius: np.ndarray, order: np.ndarray, least: np.ndarray | None = None):
        """Which blocks each row must visit, and its distance to the nearest pivot (``least`` where known)."""
        square, error = _rough(x, self.centres)
        d = np.sqrt(np.maximum(square, 0))
        wide = radius[:, None] + np.sqrt(error) + SLACK * (1 + d)  # more than any rounding
        least = d.min(axis=1) if least is None else least
        go = ((d - least[:, None]) / 2 <= wide)[:, self.cell]
        go &= (d - wide)[:, self.cell] <= self.hi
        go &= (d + wide)[:, self.cell] >= self.lo
        go &= (self.first < order[:, None]) | np.isneginf(self.first)
        return go, least


def _orders(column) -> np.ndarray:
    """Orders as numbers; without an order, after all."""
    return column.cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)


def _prepared(rows: DataFrame, block_rows: int, most_pivots: int):
    """Members of the blocks of ``rows``, numbered, and the ``_Blocks``."""
    n = rows.count()
    if not n:
        return None
    points = pivots(rows, n, most=most_pivots)
    members, bounds = _blocks(_placed(rows.select("id", "v", "order", "group"), points), block_rows)
    found = bounds.orderBy("cell", "slice", "part").collect()  # one row a block
    blocks = _Blocks(found, points, min(MOST_BINS, math.ceil(n / BIN_ROWS)))
    names = [(r["cell"], r["slice"], r["part"], i, int(b)) for i, (r, b) in enumerate(zip(found, blocks.bin))]
    numbered = rows.sparkSession.createDataFrame(names, "cell long, slice int, part int, block int, bin int")
    return members.join(F.broadcast(numbered), ["cell", "slice", "part"]).drop("cell", "slice", "part", "far"), blocks


def _rows(df, id_col, vec_col, radius_col=None, order_col=None, group_col=None):
    def taken(col, kind):
        return (F.col(col) if col else F.lit(None)).cast(kind)
    # single numbers travel as such: half the traffic, and the tasks widen them
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    return cut_lineage(df.select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast(kind)).alias("v"),
        taken(radius_col, "double").alias("radius"), taken(order_col, "long").alias("order"), taken(group_col, "long").alias("group")))


def visited_share(df: DataFrame, radius_col: str, order_col: str | None = None, id_col: str = "vec_id",
                  vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS) -> float:
    """Share of all ordered pairs of rows that the join compares."""
    rows = _rows(df, id_col, vec_col, radius_col, order_col)
    ready = _prepared(rows, block_rows, most_pivots)
    if ready is None:
        return 0.0
    blocks = ready[1]

    def run(batches):
        for batch in batches:
            m, r, o = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), _orders(batch.column(2))
            for s in range(0, len(m), 512):
                go, _ = blocks.reached(m[s:s + 512], r[s:s + 512], o[s:s + 512])
                yield pa.RecordBatch.from_arrays([pa.array([int((go @ blocks.members).sum())])], names=["n"])

    asked = rows.where("radius >= 0 and not isnan(radius)").select("v", "radius", "order")
    return (asked.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) / rows.count() ** 2


def radius_join(df: DataFrame, radius_col: str, order_col: str | None = None, id_col: str = "vec_id",
                vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS,
                apart_col: str | None = None) -> DataFrame:
    """``(id, nbr_id, dist)``: for each row the other rows within its own radius,
    with ``order_col`` only those of a smaller order, with ``apart_col`` only those
    of another value."""
    rows = _rows(df, id_col, vec_col, radius_col, order_col, apart_col)
    return _search(rows, rows, id_col, block_rows, most_pivots, others=True, ordered=bool(order_col), apart=bool(apart_col))


def radius_search(queries: DataFrame, points: DataFrame, radius_col: str, id_col: str = "vec_id", vec_col: str = "embedding",
                  point_id: str = "vec_id", point_vec: str = "embedding", apart: tuple[str, str] | None = None,
                  block_rows: int = BLOCK_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``(id, nbr_id, dist)``: for each query row the ``points`` within its radius,
    with ``apart`` (a column of each) only those of another value."""
    own, other = apart or (None, None)
    asked = _rows(queries, id_col, vec_col, radius_col, None, own)
    return _search(asked, _rows(points, point_id, point_vec, group_col=other), id_col, block_rows, most_pivots, apart=bool(apart))


class _Bin:
    """The rows of a bin, by block, and the search through them."""

    def __init__(self, held: list, blocks: _Blocks, others: bool, ordered: bool, apart: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.m = table["id"].to_numpy(), _matrix(table["v"].combine_chunks())
        self.order, self.group = (table[c].fill_null(0).to_numpy() for c in ("order", "group"))
        self.blocks, self.others, self.ordered, self.apart = blocks, others, ordered, apart
        self.ends = np.cumsum(blocks.members)
        self.tiles = [(s, near_tile(self.m[s:s + TILE])) for s in range(0, len(self.m), TILE)]
        self.own = {}

    def block(self, b: int):
        if b not in self.own:
            lo, hi = self.ends[b] - self.blocks.members[b], self.ends[b]
            self.own[b] = [(s, near_tile(self.m[s:min(s + TILE, hi)])) for s in range(lo, hi, TILE)]
        return self.own[b]

    def pairs(self, part):
        """``(id, nbr_id, dist)`` arrays of the rows of a batch."""
        ids, m, radius = part["id"].to_numpy(), _matrix(part["v"]), part["radius"].to_numpy(zero_copy_only=False)
        order, group = (part[c].fill_null(0).to_numpy() for c in ("order", "group"))
        last, least = _orders(part["order"]), part["least"].to_numpy(zero_copy_only=False)
        for s in range(0, len(ids), 4 * TILE):
            piece = slice(s, s + 4 * TILE)
            x, r = m[piece], radius[piece]
            go, _ = self.blocks.reached(x, r, last[piece], least[piece])
            if go.mean() > 0.5:  # nearly all blocks: full tiles are faster
                meetings = [(np.arange(a, min(a + TILE, len(x))), self.tiles) for a in range(0, len(x), TILE)]
            else:
                meetings = [(np.flatnonzero(go[:, b]), self.block(b)) for b in np.flatnonzero(go.any(axis=0)).tolist()]
            for mine, tiles in meetings:
                near = Near(x[mine])
                limit = (r[mine] * (1 + SLACK)) ** 2
                for at, tile in tiles:
                    i, j = near.within(slice(0, len(mine)), tile, limit)
                    i, j = mine[i], j + at
                    keep = np.ones(len(i), bool)
                    if self.others:
                        keep &= ids[piece][i] != self.ids[j]
                    if self.ordered:
                        keep &= self.order[j] < order[piece][i]
                    if self.apart:
                        keep &= self.group[j] != group[piece][i]
                    i, j = i[keep], j[keep]
                    d = np.sqrt(exact_squares(x, self.m, i, j))
                    ok = d <= r[i]
                    if ok.any():
                        yield ids[piece][i[ok]], self.ids[j[ok]], d[ok]


def _asked(queries: DataFrame) -> DataFrame:
    """The queries with an id; where an id repeats, each radius (and order) of it asks
    for each of its vectors."""
    known = queries.where("id is not null")
    again = cut_lineage(known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return known
    twins = known.join(again, "id")
    crossed = twins.select("id", "radius", "order").join(twins.select("id", "v", "group"), "id")
    return known.join(again, "id", "left_anti").unionByName(crossed)


def _search(queries, rows, id_col, block_rows, most_pivots, others=False, ordered=False, apart=False) -> DataFrame:
    """Every row is sent once to each bin that holds a block it must visit, so traffic is at
    most ``MOST_BINS`` times the input; which blocks of the bin it meets is found out there."""
    ready = _prepared(rows, block_rows, most_pivots)
    if ready is None:
        return rows.sparkSession.createDataFrame([], f"{id_col} long, nbr_id long, dist double")
    members, blocks = ready
    n, bins = int(blocks.members.sum()), len(blocks.starts)
    asking = n if queries is rows else queries.count()
    # few rows to search and many that ask: a bin is held several times
    copies = math.ceil(min(MOST_BINS, math.ceil(max(n, asking) / BIN_ROWS)) / bins)
    names = ["task", "role", "block", "id", "v", "radius", "order", "group", "least"]
    kind = "float" if queries.schema["v"] == rows.schema["v"] and "float" in rows.schema["v"].dataType.simpleString() else "double"
    shape = f"task int, role int, block int, id long, v array<{kind}>, radius double, order long, group long, least double"

    def vector(v):
        return F.transform(v, lambda x: x.cast(kind)).alias("v")

    def sent(batches):
        for batch in batches:
            m, r, order = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), _orders(batch.column(3))
            for s in range(0, len(m), 512):
                go, least = blocks.reached(m[s:s + 512], r[s:s + 512], order[s:s + 512])
                i, to = np.nonzero(np.logical_or.reduceat(go, blocks.starts, axis=1))
                mine = batch.slice(s, 512).take(pa.array(i))
                task = to * copies + mine.column(0).to_numpy() % copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task, pa.int32()), pa.array(np.ones(len(i)), pa.int32()), pa.array(np.zeros(len(i)), pa.int32()),
                     *mine.columns, pa.array(least[i])], names=names)

    held = members.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("bin") * copies + F.col("task")).cast("int").alias("task"), F.lit(0).alias("role"), "block", "id", vector("v"),
        F.lit(None).cast("double").alias("radius"), "order", "group", F.lit(None).cast("double").alias("least"))
    asked = _asked(queries).where("radius >= 0 and not isnan(radius)")
    coming = asked.select("id", vector("v"), "radius", "order", "group").mapInArrow(sent, shape)
    met = held.unionByName(coming).repartitionById(bins * copies, F.col("task")).sortWithinPartitions("task", "role", "block")

    def pairs(batches):
        place, mine, state, out, size = None, [], None, [], 0
        for batch in batches:
            tasks, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((tasks[1:] != tasks[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tasks)]):
                if a == b:
                    continue
                if tasks[a] != place:
                    place, mine, state = tasks[a], [], None
                if role[a] == 0:  # a bin may begin in one batch and end in the next
                    mine.append(batch.slice(a, b - a))
                    continue
                if state is None:
                    state, mine = _Bin(mine, blocks.part(int(place) // copies), others, ordered, apart), []
                for found in state.pairs(batch.slice(a, b - a)):
                    out.append(found)
                    size += len(found[0])
                    if size >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=[id_col, "nbr_id", "dist"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=[id_col, "nbr_id", "dist"])

    return met.mapInArrow(pairs, f"{id_col} long, nbr_id long, dist double")


def knn_by_graph(df: DataFrame, graph: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, rank, nbr_id, dist)``, exact: an approximate ``graph`` (rows as of
    ``knn_graph``) bounds each row's k-th distance from above, and the radius join
    finds all rows within that bound.  Rows with fewer than k in the graph search
    everywhere."""
    worst = graph.groupBy(id_col).agg(F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("_r"))
    asked = df.join(worst, id_col, "left").withColumn("_r", F.coalesce("_r", F.lit(float("inf"))))
    near = radius_join(asked, "_r", None, id_col, vec_col, block_rows)
    # about k rows each; the limit is applied before the shuffle as well as after it
    best = Window.partitionBy(id_col).orderBy("dist", "nbr_id")
    return (near.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
            .select(id_col, "rank", "nbr_id", "dist"))
