"""A cover tree over integer vectors, searched for largest inner products in windows.

Vectors are lengthened by one component so that all have the norm of the longest.
The squared distance of a query to such a vector is then a constant less twice their
inner product, so a ball around a node bounds the inner products of all below it
from both sides.

Every node covers its rows by balls of half its radius around some of them, its own
centre first, the other centres farther than that from each other.  Nodes end as one
row or as a leaf of few, close rows.  A node's covering radius is the distance of its
farthest row.
"""

from __future__ import annotations

import io

import numpy as np

# Rows of a leaf, and the share of the largest norm that its radius may have.
LEAF_ROWS = 16
LEAF_RADIUS = 0.25
# Queries whose bounds are held at once.
QUERY_ROWS = 256
# Added to radii, in parts of the largest norm: more than rounding can take away.
_SLACK = 1e-7
NONE = -np.iinfo(np.int64).max


class CoverTree:
    """Rows in the order of ties (the first wins) and the nodes over them, level by level."""

    def __init__(self, rows: np.ndarray, nodes: dict[str, np.ndarray]):
        self.rows = rows.astype(np.float64)
        self.nodes = nodes
        self.longest = float((self.rows**2).sum(1).max(initial=0.0))

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        x = rows.astype(np.float64)
        norms = (x**2).sum(1)
        longest = norms.max(initial=0.0)
        x = np.hstack([x, np.sqrt(longest - norms)[:, None]])
        unit = np.sqrt(longest)

        def distances(some: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, 2 * longest - 2 * (x[some] @ x[centre])))

        made: dict[str, list] = {k: [] for k in ("centre", "radius", "start", "end", "level", "parent", "leaf")}
        order: list[np.ndarray] = []
        placed = 0
        # Nodes whose children are still to be found: rows, centre, distances to it, parent.
        level, waiting = 0, [(np.arange(len(rows)), 0, distances(np.arange(len(rows)), 0), -1)] if len(rows) else []
        while waiting:
            following = []
            for some, centre, far, parent in waiting:
                radius = float(far.max())
                close = radius <= LEAF_RADIUS * unit
                leaf = len(some) == 1 or (len(some) <= LEAF_ROWS and close)
                for k, v in zip(made, (centre, radius + _SLACK * unit, 0, 0, level, parent, leaf)):
                    made[k].append(v)
                me = len(made["leaf"]) - 1
                if leaf:
                    made["start"][me], made["end"][me] = placed, placed + len(some)
                    placed += len(some)
                    order.append(np.sort(some))
                elif radius <= 2 * _SLACK * unit:
                    # Equal rows: no ball tells them apart.
                    for part in np.array_split(some, -(-len(some) // LEAF_ROWS)):
                        following.append((part, int(part[0]), distances(part, int(part[0])), me))
                else:
                    while len(some):
                        covered = far <= radius / 2
                        following.append((some[covered], centre, far[covered], me))
                        some = some[~covered]
                        if len(some):
                            centre = int(some[0])
                            far = distances(some, centre)
            level, waiting = level + 1, following
        nodes = {k: np.array(v, dtype=np.float64 if k == "radius" else np.int64) for k, v in made.items()}
        nodes["order"] = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(rows, nodes)

    def written(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows.astype(np.int32), **self.nodes)
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as held:
            nodes = {k: held[k] for k in held.files}
        return cls(nodes.pop("rows"), nodes)

    def search(
        self,
        queries: np.ndarray,
        low: np.ndarray,
        high: np.ndarray,
        labels: np.ndarray,
        own_labels: np.ndarray,
        same_label: bool,
        self_row: np.ndarray,
        k: int,
    ) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` rows of every query and window, by inner product, then by row.

        A window (``low`` to ``high`` of query by window) is empty if its low end is
        above its high end.  Rows count whose label is, or is not, the query's own;
        ``self_row`` is a row that does not count (-1: none).  Returns rows (-1: none)
        and inner products, both by query, window and rank.
        """
        keys = [
            self._search(*(a[i : i + QUERY_ROWS] for a in (queries, low, high)), labels, own_labels[i : i + QUERY_ROWS], same_label, self_row[i : i + QUERY_ROWS], k)
            for i in range(0, len(queries), QUERY_ROWS)
        ]
        found = -np.sort(-np.concatenate(keys), axis=2)
        n = max(1, len(self.rows))
        score = found // n
        row = n - 1 - (found - score * n)
        return np.where(found == NONE, -1, row), np.where(found == NONE, 0, score)

    def _search(self, queries, low, high, labels, own, same_label, self_row, k):
        n, t = len(self.rows), self.nodes
        queries = queries.astype(np.float64)
        norms = (queries**2).sum(1)[:, None]
        best = np.full((*low.shape, k), NONE)
        # Inner products of centres met so far: whatever has k above it need not be opened.
        known = np.full((*low.shape, k), -np.inf)
        if not n:
            return best
        mixed, masks = self._labels(labels)
        own_bit = np.left_shift(np.int64(1), own % 63)[:, None]
        at = {row: [] for row in ("node", "upper", "lower")}
        active = np.ones((len(queries), 1), dtype=bool)
        level = np.flatnonzero(t["level"] == 0)
        while len(level):
            used = active.any(0)
            level, active = level[used], active[:, used]
            if not len(level):
                break
            centre = t["centre"][level]
            products = queries @ self.rows[centre].T
            alike = labels[centre][None, :] == own[:, None]
            counts = active & (alike == same_label) & (centre[None, :] != self_row[:, None])
            parent = t["parent"][level]
            fresh = (parent < 0) | (t["centre"][parent] != centre)
            single = t["end"][level] - t["start"][level] == 1
            for w in range(low.shape[1]):
                inside = counts & (products >= low[:, w, None]) & (products <= high[:, w, None])
                _keep_largest(known, w, np.where(inside[:, fresh], products[:, fresh], -np.inf))
                if single.any():
                    key = products[:, single].astype(np.int64) * n + (n - 1 - centre[single])
                    _keep_largest(best, w, np.where(inside[:, single], key, NONE))
            rest = ~single
            level, active, products = level[rest], active[:, rest], products[:, rest]
            apart = np.sqrt(np.maximum(0.0, norms + self.longest - 2 * products))
            radius = t["radius"][level]
            slack = 1e-9 * (norms + self.longest) + 1e-6
            upper = (norms + self.longest - np.maximum(0.0, apart - radius) ** 2) / 2 + slack
            lower = (norms + self.longest - (apart + radius) ** 2) / 2 - slack
            first = labels[t["centre"][level]][None, :]
            if same_label:
                eligible = np.where(mixed[level], (masks[level] & own_bit) != 0, first == own[:, None])
            else:
                eligible = mixed[level] | (first != own[:, None])
            active = active & eligible & _needed(upper, lower, low, high, known.min(2))
            leaf = t["leaf"][level] == 1
            at["node"].append(level[leaf])
            at["upper"].append(np.where(active, upper, -np.inf)[:, leaf])
            at["lower"].append(lower[:, leaf])
            inner, active = level[~leaf], active[:, ~leaf]
            below = np.isin(t["parent"], inner)
            level = np.flatnonzero(below)
            active = active[:, np.searchsorted(inner, t["parent"][level])]
        leaves = np.concatenate(at["node"])
        upper, lower = np.concatenate(at["upper"], axis=1), np.concatenate(at["lower"], axis=1)
        self._open_leaves(leaves, upper, lower, queries, low, high, labels, own, same_label, self_row, best, known)
        return best

    def _open_leaves(
        self, leaves, upper, lower, queries, low, high, labels, own_labels, same_label, self_row, best, known
    ):
        """Every query opens its leaves from the best bound down, as long as one can still matter."""
        n, t = len(self.rows), self.nodes
        members = np.full((len(leaves), LEAF_ROWS), -1)
        for i, leaf in enumerate(leaves):
            own = t["order"][t["start"][leaf] : t["end"][leaf]]
            members[i, : len(own)] = own
        turns = np.argsort(-upper, axis=1, kind="stable")
        for turn in turns.T:
            which = np.arange(len(queries))
            u, v = upper[which, turn][:, None], lower[which, turn][:, None]
            least = np.maximum(known.min(2), np.where(best.min(2) == NONE, -np.inf, best.min(2) // n))
            if not ((u >= low) & (u >= least)).any():
                break
            a = np.flatnonzero(_needed(u, v, low, high, least)[:, 0])
            if not len(a):
                continue
            rows = members[turn[a]]
            products = np.einsum("ad,ald->al", queries[a], self.rows[rows])
            own = rows != self_row[a][:, None]
            counts = (rows >= 0) & own & ((labels[rows] == own_labels[a][:, None]) == same_label)
            key = products.astype(np.int64) * n + (n - 1 - rows)
            some = best[a]
            for w in range(low.shape[1]):
                inside = counts & (products >= low[a, w, None]) & (products <= high[a, w, None])
                _keep_largest(some, w, np.where(inside, key, NONE))
            best[a] = some

    def _labels(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node: whether its rows have several labels, and a bit for each (some share a bit)."""
        t = self.nodes
        mixed = np.zeros(len(t["leaf"]), dtype=bool)
        masks = np.zeros(len(t["leaf"]), dtype=np.int64)
        bits = np.left_shift(np.int64(1), labels % 63)
        for node in range(len(mixed) - 1, -1, -1):
            if t["leaf"][node]:
                rows = t["order"][t["start"][node] : t["end"][node]]
                masks[node] |= np.bitwise_or.reduce(bits[rows])
                mixed[node] |= bool((labels[rows] != labels[t["centre"][node]]).any())
            parent = t["parent"][node]
            if parent >= 0:
                masks[parent] |= masks[node]
                mixed[parent] |= mixed[node] or labels[t["centre"][node]] != labels[t["centre"][parent]]
        return mixed, masks


def _needed(upper, lower, low, high, least) -> np.ndarray:
    """By query and node: whether a row of the node may belong to the first rows of any window."""
    out = np.zeros(upper.shape, dtype=bool)
    for w in range(low.shape[1]):
        some = low[:, w, None]
        out |= (some <= high[:, w, None]) & (upper >= some) & (lower <= high[:, w, None]) & (upper >= least[:, w, None])
    return out


def _keep_largest(held: np.ndarray, w: int, more: np.ndarray) -> None:
    """The largest values of ``held[:, w]`` and ``more``, as many as are held."""
    k = held.shape[2]
    if more.shape[1]:
        held[:, w] = np.partition(np.concatenate([held[:, w], more], axis=1), -k, axis=1)[:, -k:]
