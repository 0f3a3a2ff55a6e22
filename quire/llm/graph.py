"""A robust-pruned directed proximity graph over unit vectors, in batched numpy.

Greedy beam searches over the graph built so far propose neighbours for each new
node; relaxed-distance pruning (``alpha``) then keeps a short, diverse edge list.
Every step works on a batch of nodes at once, so the cost is matrix products and
gathers instead of a Python loop per edge.
"""

from __future__ import annotations

import numpy as np

NONE = -1


class PrunedGraph:
    """``vectors``: float32 rows of unit length. ``degree``: most edges a node keeps.
    ``beam``: width of a search. ``alpha`` >= 1: an edge is dropped only if a kept
    neighbour is ``alpha`` times nearer to its end than the node itself is."""

    def __init__(self, vectors: np.ndarray, degree: int = 24, beam: int = 32, alpha: float = 1.2, seed: int = 7):
        self.n, self.dim = vectors.shape
        self.degree, self.beam, self.alpha = degree, beam, alpha
        # The last row stands for "no edge"; a zero vector is never among the best.
        self.rows = np.vstack([vectors.astype(np.float32, copy=False), np.zeros((1, self.dim), np.float32)])
        self.edges = np.full((self.n + 1, degree), self.n, np.int32)
        self.count = np.zeros(self.n + 1, np.int32)
        order = np.random.default_rng(seed).permutation(self.n)
        # Entry layer: an even share of the nodes, scored by one matrix product.
        self.entry = order[: max(1, min(self.n, 64, self.n))].astype(np.int32)
        self._build(order)
        self.entry = order[: max(1, min(self.n, max(64, self.n // 8)))].astype(np.int32)

    # -- search ---------------------------------------------------------------
    def search(self, queries: np.ndarray, beam: int | None = None, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities, best first, of a beam search for each query row; ids of -1 fill short results."""
        width = beam or self.beam
        b = len(queries)
        if not b:
            return np.empty((0, width), np.int32), np.empty((0, width), np.float32)
        start = min(len(self.entry), max(8, width // 2))
        scores = queries @ self.rows[self.entry].T
        top = np.argpartition(-scores, start - 1, axis=1)[:, :start] if start < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (b, 1))
        ids = np.full((b, width), self.n, np.int32)
        sims = np.full((b, width), -2.0, np.float32)
        ids[:, :start] = self.entry[top]
        sims[:, :start] = np.take_along_axis(scores, top, 1)
        done = ids == self.n
        seen = np.zeros((b, self.n + 1), bool)
        seen[:, self.n] = True
        line = np.arange(b)[:, None]
        seen[line, ids] = True
        active = np.arange(b)
        while len(active):
            a = active[:, None]
            rank = np.where(done[active], -3.0, sims[active])
            pick = np.argpartition(-rank, expand - 1, axis=1)[:, :expand] if expand < width else np.tile(np.arange(width), (len(active), 1))
            fresh = np.take_along_axis(rank, pick, 1) > -2.5
            done[a, pick] = True
            from_ids = np.where(fresh, ids[a, pick], self.n)
            near = self.edges[from_ids].reshape(len(active), -1)
            near = np.where(seen[a, near], self.n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = self.n
            seen[a, near] = True
            # most of the list is repeats: keep as many columns as the fullest row needs
            most = int((near < self.n).sum(1).max())
            if most:
                near = np.sort(near, axis=1)[:, :most]
                got = np.matmul(self.rows[near], queries[active][:, :, None])[:, :, 0]
                got[near == self.n] = -2.0
                all_ids = np.concatenate([ids[active], near], 1)
                all_sims = np.concatenate([sims[active], got], 1)
                all_done = np.concatenate([done[active], near == self.n], 1)
                best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
                ids[active] = np.take_along_axis(all_ids, best, 1)
                sims[active] = np.take_along_axis(all_sims, best, 1)
                done[active] = np.take_along_axis(all_done, best, 1)
            active = active[~done[active].all(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(ids == self.n, NONE, ids), sims

    # -- construction -----------------------------------------------------------
    def _build(self, order: np.ndarray) -> None:
        done = 0
        while done < self.n:
            batch = order[done : done + max(128, min(1024, done))].astype(np.int32)
            own = self.rows[batch]
            mutual = own @ own.T
            np.fill_diagonal(mutual, -2.0)
            k = min(len(batch) - 1, self.beam // 2)
            parts = []
            if k > 0:
                parts.append(batch[np.argpartition(-mutual, k - 1, axis=1)[:, :k]])
            if done:
                found, _ = self.search(own)
                parts.append(np.where(found == NONE, self.n, found))
            done += len(batch)
            if not parts:
                continue
            self.edges[batch] = self._prune(batch, np.concatenate(parts, 1))
            self._back(batch)
            if len(self.entry) * 8 < done:
                self.entry = order[: max(64, done // 8)].astype(np.int32)

    def _prune(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Of each node's candidates (n: none), the diverse ones, at most ``degree``."""
        base = self.rows[nodes]
        far = np.matmul(self.rows[found], base[:, :, None])[:, :, 0]
        far[(found == self.n) | (found == nodes[:, None])] = -2.0
        order = np.argsort(-far, axis=1, kind="stable")
        found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
        rows = self.rows[found]
        # squared Euclidean distances of unit vectors; alpha is squared alike
        between = 2.0 - 2.0 * np.matmul(rows, rows.transpose(0, 2, 1))
        own = 2.0 - 2.0 * far
        alive = far > -1.5
        limit = self.alpha * self.alpha
        kept = np.full((len(nodes), self.degree), self.n, np.int32)
        n = np.zeros(len(nodes), np.int32)
        for i in range(found.shape[1]):
            take = np.nonzero(alive[:, i] & (n < self.degree))[0]
            if not len(take):
                continue
            kept[take, n[take]] = found[take, i]
            n[take] += 1
            alive[take] &= limit * between[take, i] > own[take]
        self.count[nodes] = n
        return kept

    def _back(self, batch: np.ndarray) -> None:
        """Adds the reverse of each new edge; a list that overflows is pruned again."""
        ends = self.edges[batch]
        use = ends < self.n
        to = ends[use]
        frm = np.broadcast_to(batch[:, None], ends.shape)[use]
        near = np.einsum("ij,ij->i", self.rows[to], self.rows[frm])
        order = np.lexsort((-near, to))
        to, frm = to[order], frm[order]
        head = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(head, np.arange(len(to)), 0)) if len(to) else np.zeros(0, int)
        at = np.arange(len(to)) - first
        nodes = to[head]
        slots = int(min(2 * self.degree, at.max() + 1)) if len(at) else 0
        if not slots:
            return
        new = np.full((len(nodes), slots), self.n, np.int32)
        line = np.cumsum(head) - 1
        ok = at < slots
        new[line[ok], at[ok]] = frm[ok]
        old = self.edges[nodes]
        new[(new[:, :, None] == old[:, None, :]).any(2)] = self.n
        size = (new < self.n).sum(1) + (old < self.n).sum(1)
        both = np.concatenate([old, new], 1)
        fits = size <= self.degree
        if fits.any():
            packed = np.sort(both[fits], axis=1)[:, : self.degree]
            self.edges[nodes[fits]] = packed
            self.count[nodes[fits]] = size[fits]
        if (~fits).any():
            full = nodes[~fits]
            for s in range(0, len(full), 1024):
                self.edges[full[s : s + 1024]] = self._prune(full[s : s + 1024], both[~fits][s : s + 1024])
