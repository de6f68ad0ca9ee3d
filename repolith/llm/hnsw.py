"""A hierarchical navigable small-world graph in flat arrays, built and searched in batches.

Layer 0 holds every vector, each layer above about one in FAN of the one below. A layer
is an ``int32`` array (rows, degree) of neighbour rows, -1 where there is none. Points are
inserted in batches that at most double the graph: a batch is searched for on the graph so
far, from the entry points that the layers above lead to, and within itself. Links are
chosen by the usual diversity rule and mirrored.
"""

from __future__ import annotations

import numpy as np

FAN = 16


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, the largest first."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), 1, "stable"), 1)
    return np.argsort(-sims, 1, "stable")


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of a layer for a batch of queries from common ``entry`` rows; (rows, similarities), best first.

    Each query keeps its own beam of ``ef``, but what one of them expands is compared with
    all, as one matrix product: that costs less than single look-ups, and a row is expanded
    once a batch. Fewer than ``ef`` rows leave -1 and minus infinity.
    """
    n, b = len(links), len(q)
    seen, spent = np.zeros(n, bool), np.zeros(n + 1, bool)
    spent[n] = True
    ids, sims = np.full((b, ef), n, "i4"), np.full((b, ef), -np.inf, "f4")
    new = np.unique(entry[entry >= 0])
    while len(new):
        seen[new] = True
        s = q @ x[new].T
        use = np.flatnonzero((s > sims.min(1)[:, None]).any(0))
        if len(use):
            all_s = np.hstack([sims, s[:, use]])
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            all_i = np.hstack([ids, np.broadcast_to(new[use].astype("i4"), (b, len(use)))])
            sims, ids = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
        f = np.where(spent[ids], -np.inf, sims)
        at = np.argpartition(-f, width - 1, axis=1)[:, :width] if ef > width else np.tile(np.arange(ef), (b, 1))
        go = np.unique(np.take_along_axis(ids, at, 1)[np.isfinite(np.take_along_axis(f, at, 1))])
        spent[go] = True
        near = links[go].ravel()
        near = np.unique(near[near >= 0])
        new = near[~seen[near]]
    order = np.argsort(-sims, 1, "stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the point than to any kept one; -1 fills up."""
    ok = np.isfinite(sims)
    v = x[np.where(ok, ids, 0)]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    worst = np.full(ids.shape, -np.inf, "f4")
    count = np.zeros(len(ids), int)
    for j in range(ids.shape[1]):
        take = ok[:, j] & (count < keep) & (worst[:, j] < sims[:, j])
        kept[:, j] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, mutual[:, j]), worst)
    # the nearest of the others fill what is left
    left = ok & ~kept & (np.cumsum(ok & ~kept, 1) <= (keep - count)[:, None])
    use = kept | left
    rank = np.argsort(~use, 1, "stable")[:, :keep]
    return np.where(np.take_along_axis(use, rank, 1), np.take_along_axis(ids, rank, 1), -1).astype("i4")


def _mirror(x: np.ndarray, links: np.ndarray, src: np.ndarray) -> None:
    """Give the neighbours of rows ``src`` links back, each list keeping its most similar."""
    degree = links.shape[1]
    a = np.repeat(src, degree)
    b = links[src].ravel()
    a, b = a[b >= 0], b[b >= 0]
    touched = np.unique(b)
    old = links[touched]
    u = np.r_[np.repeat(touched, degree)[old.ravel() >= 0], b]
    v = np.r_[old.ravel()[old.ravel() >= 0], a]
    pair = np.unique(u.astype("i8") * len(links) + v)
    u, v = (pair // len(links)).astype("i4"), (pair % len(links)).astype("i4")
    s = np.empty(len(u), "f4")
    for i in range(0, len(u), 65536):
        s[i : i + 65536] = np.einsum("ij,ij->i", x[u[i : i + 65536]], x[v[i : i + 65536]])
    order = np.lexsort((-s, u))
    u, v = u[order], v[order]
    first = np.r_[0, np.flatnonzero(np.diff(u)) + 1]
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    fits = place < degree
    links[touched] = -1
    links[u[fits], place[fits]] = v[fits]


class Graph:
    """``order``: vectors in order of their layers; ``layers[0]`` is the bottom."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], degree: int, ef: int):
        self.x, self.layers, self.degree, self.ef = x, layers, degree, ef

    @classmethod
    def build(cls, x: np.ndarray, degree: int = 24, ef: int = 40, batch: int = 1024) -> Graph:
        """Rows of ``x`` (normalised, float32) must come in random order: layer l holds the first len / FAN**l."""
        n = len(x)
        sizes = [n]
        while sizes[-1] > 64 * FAN:
            sizes.append(max(64, sizes[-1] // FAN))
        g = cls(x, [], degree, ef)
        for size in reversed(sizes):
            links = np.full((size, degree), -1, "i4")
            have = len(g.layers[0]) if g.layers else 0
            if not have:
                have = size
                sims = x[:size] @ x[:size].T
                np.fill_diagonal(sims, -np.inf)
                ids = _top(sims, min(2 * degree, size))
                links[:] = -1
                got = diverse(x, ids.astype("i4"), np.take_along_axis(sims, ids, 1), degree // 2)
                links[:, : got.shape[1]] = got
                _mirror(x, links, np.arange(size))
            else:
                links[:have] = g.layers[0]
                while have < size:
                    b = min(batch, have, size - have)
                    q = x[have : have + b]
                    ids, s = beam(x, links[:have], q, g.entry(q, 0), ef)
                    own = q @ q.T
                    np.fill_diagonal(own, -np.inf)
                    at = _top(own, min(degree // 2, b))
                    ids, s = np.hstack([np.maximum(ids, 0), have + at]).astype("i4"), np.hstack([s, np.take_along_axis(own, at, 1)])
                    o = np.argsort(-s, 1, "stable")[:, : 2 * degree]
                    got = diverse(x, np.take_along_axis(ids, o, 1), np.take_along_axis(s, o, 1), degree // 2)
                    links[have : have + b, : got.shape[1]] = got
                    _mirror(x, links, np.arange(have, have + b))
                    have += b
            g.layers.insert(0, links)
        return g

    def entry(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Per query the row that the layers above ``down_to`` lead to."""
        upper = self.layers[down_to:]
        at = np.arange(min(4, len(upper[-1])), dtype="i4")
        for links in reversed(upper):
            at = beam(self.x, links, q, at, 8)[0][:, :2]
        return at

    def search(self, q: np.ndarray, k: int, ef: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar rows of each query; queries with near entries go through together."""
        out_i, out_s = np.full((len(q), k), -1, "i4"), np.full((len(q), k), -np.inf, "f4")
        flat = len(self.layers) == 1
        at = np.zeros((len(q), 1), "i4")
        if not flat:
            for i in range(0, len(q), 4096):
                at[i : i + 4096] = self.entry(q[i : i + 4096], 1)[:, :1]
        top = self.x[: min(64, len(self.x))]
        order = np.lexsort((at[:, 0], np.argmax(self.x[at[:, 0]] @ top.T, 1)))
        for i in range(0, len(q), batch):
            b = order[i : i + batch]
            ids, s = beam(self.x, self.layers[0], q[b], np.r_[at[b].ravel(), 0], max(ef, k))
            out_i[b], out_s[b] = ids[:, :k], s[:, :k]
        return out_i, out_s
