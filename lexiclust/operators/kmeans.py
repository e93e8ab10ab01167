"""k-means with all starts at once: a step is one scan of the rows, whatever the
number of starts.

Each start is seeded by k-means++ on a bounded sample (rows of least hash).  In a
step every task assigns its rows to the centres of all starts that still move and
returns one row of sums; the driver holds ``starts * k`` centres only.  A centre
that loses all its rows stays where it is.

Defined results: ties go to the centre of the smaller number; rows without a vector
are left out; fewer distinct sample rows than ``k`` give fewer centres; an empty
table gives no centres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blockscan import matrix

#: rows that starts are seeded on at most
SAMPLE_ROWS = 10_000


@dataclass
class Fit:
    centres: np.ndarray
    cost: float          # sum of squared distances to the nearest centre
    sizes: np.ndarray
    steps: int           # scans of the rows, for all starts together
    costs: list[float]   # of every start


def seeded(sample: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++: each next centre is drawn with the squared distance to those before."""
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and near.sum() > 0:
        chosen.append(int(rng.choice(len(sample), p=near / near.sum())))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen].copy()


def _step(rows: DataFrame, starts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per start: sums and counts of the rows of each centre, and the cost."""
    def run(batches):
        total = {}
        for batch in batches:
            m = matrix(batch.column(0))
            square = np.einsum("ij,ij->i", m, m)
            for s, c in starts.items():
                d = np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * (m @ c.T)
                best = d.argmin(axis=1)
                flat = np.zeros((len(c), m.shape[1] + 2))
                np.add.at(flat[:, :-2], best, m)
                flat[:, -2] = np.bincount(best, minlength=len(c))
                flat[0, -1] = np.maximum(square + d[np.arange(len(m)), best], 0).sum()
                total[s] = total[s] + flat if s in total else flat
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([t.ravel().tolist() for t in total.values()], pa.list_(pa.float64()))],
                names=["start", "sums"])

    parts = rows.mapInArrow(run, "start int, sums array<double>")  # one row a start and task
    added = (parts.select("start", F.posexplode("sums").alias("i", "x")).groupBy("start", "i").agg(F.sum("x").alias("x"))
             .groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("sums")))
    out = {}
    for r in added.collect():  # starts * k * dimensions numbers
        flat = np.array([x["x"] for x in r["sums"]]).reshape(len(starts[r["start"]]), -1)
        out[r["start"]] = (flat[:, :-2], flat[:, -2], float(flat[0, -1]))
    return out


def kmeans(df: DataFrame, k: int, starts: int = 10, most_steps: int = 50, tolerance: float = 1e-4, id_col: str = "vec_id",
           vec_col: str = "embedding", seed: int = 0, sample_rows: int = SAMPLE_ROWS) -> Fit:
    """The best of ``starts`` runs by cost.  A start ends when no centre moves by
    more than ``tolerance`` (as a share of the rows' root mean square length)."""
    rows = df.where(F.col(vec_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    rows = cut_lineage(rows)
    sample = np.array([r["v"] for r in rows.orderBy("h", "v").limit(sample_rows).select("v").collect()], np.float64)  # bounded
    if not len(sample):
        return Fit(np.zeros((0, 0)), 0.0, np.zeros(0), 0, [])
    scale = max(float(np.sqrt((sample ** 2).sum(axis=1).mean())), 1e-300)
    centres = {s: seeded(sample, k, np.random.default_rng([seed, s])) for s in range(starts)}
    costs, sizes, moving, steps = {}, {}, set(centres), 0
    while moving:
        last = steps >= most_steps  # only the costs of the centres as they are
        for s, (sums, counts, cost) in _step(rows.select("v"), {s: centres[s] for s in moving}).items():
            costs[s], sizes[s] = cost, counts
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres[s])
            if last or np.sqrt(((new - centres[s]) ** 2).sum(axis=1)).max() <= tolerance * scale:
                moving.discard(s)
            else:
                centres[s] = new
        steps += 1
    best = min(costs, key=lambda s: (costs[s], s))
    return Fit(centres[best], costs[best], sizes[best], steps, [costs[s] for s in sorted(costs)])
