"""The best k of each query while a task goes through its rows, so that only k rows for each query and task are shuffled."""

from __future__ import annotations

import numpy as np


class Best:
    """Scores descending, ties by smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = np.full((n_queries, k), -np.inf)
        self.ids = np.full((n_queries, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of `queries` (their numbers), a column for each id; -inf is no hit."""
        if not len(ids):
            return
        some = scores.max(axis=1) >= self.scores[queries, -1]  # an equal score may have the smaller id
        q = queries[some]
        if not len(q):
            return
        s = np.concatenate([self.scores[q], scores[some]], axis=1)
        i = np.concatenate([self.ids[q], np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
        if s.shape[1] > 4 * self.k:  # only what reaches the k-th score has to be sorted
            edge = np.partition(s, -self.k, axis=1)[:, -self.k]
            width = int((s >= edge[:, None]).sum(axis=1).max())
            near = np.argpartition(-s, width - 1, axis=1)[:, :width] if width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            s, i = np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[q], self.ids[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids, scores."""
        q, at = np.nonzero(np.isfinite(self.scores))
        return q, self.ids[q, at], self.scores[q, at]
