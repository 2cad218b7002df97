"""The best rows of each query, kept while a task reads its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a batch of results.
OUT_ROWS = 1 << 16


class Best:
    """The k nearest of each query that a task has seen: what it holds grows
    with queries times k alone. ``distinct`` counts an id once for a query."""

    def __init__(self, qids: pa.Array, k: int, distinct: bool = False):
        self.qids, self.k, self.distinct = qids, k, distinct
        self.edge = np.full(len(qids), np.finfo(np.float64).max)
        self.rows: list = []
        self.dists: list = []
        self.ids: list = []
        self.held, self.room = 0, max(2 * len(qids) * k, 1 << 16)

    def offer(self, at: np.ndarray, dist: np.ndarray, ids: pa.Array) -> None:
        """Distances of the queries ``at`` to rows in the order of their ids;
        an infinite one is none."""
        most = min(self.k, dist.shape[1])
        edge = self.edge[at]
        near = dist <= edge[:, None]
        if np.count_nonzero(near) > len(at) * self.k:
            edge = np.minimum(edge, np.partition(dist, most - 1, axis=1)[:, most - 1])
            near = dist <= edge[:, None]
            # of ties at the edge the first ids stay
            for r in np.flatnonzero(np.count_nonzero(near, axis=1) > most):
                ties = np.flatnonzero(dist[r] == edge[r])
                near[r, ties[most - np.count_nonzero(dist[r] < edge[r]) :]] = False
        rows, cols = np.nonzero(near)
        if len(rows):
            self.rows.append(at[rows])
            self.dists.append(dist[rows, cols])
            self.ids.append(ids.take(pa.array(cols)))
            self.held += len(rows)
            if self.held > self.room:
                self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        rows, dists, ids = np.concatenate(self.rows), np.concatenate(self.dists), pa.concat_arrays(self.ids)
        place = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        if self.distinct:
            order = np.lexsort((dists, place, rows))
            r, p = rows[order], place[order]
            order = order[np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]))]
            order = order[np.lexsort((place[order], dists[order], rows[order]))]
        else:
            order = np.lexsort((place, dists, rows))
        r = rows[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        order, nth = order[nth < self.k], nth[nth < self.k]
        rows, dists = rows[order], dists[order]
        self.edge[rows[nth == self.k - 1]] = dists[nth == self.k - 1]
        self.rows, self.dists, self.ids = [rows], [dists], [ids.take(pa.array(order))]
        self.held = len(rows)

    def result(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        for i in range(0, self.held, OUT_ROWS):
            to = i + OUT_ROWS
            yield pa.record_batch([self.qids.take(pa.array(self.rows[0][i:to])), self.ids[0][i:to], pa.array(self.dists[0][i:to])], ["qid", "id", "distance"])
