"""A cover tree over vectors of whole numbers, stored in one file, for inner products within windows.

Every vector gets one more component that brings it to the greatest norm of
the tree, so that near means a large inner product.  A node's children have
half its covering radius and centres further than that from each other; what no
child of some size covers stays in one leaf below the node.  Seen from a query,
a ball of radius r on the sphere bounds the inner products of its members from
both sides: nodes that no window reaches are left out, the others are visited
by their upper bound, and leaves are computed exactly.
"""

from __future__ import annotations

import heapq
import io
import struct
from dataclasses import dataclass, field

import numpy as np

LEAF, SEEDS, LEAST_GROUP = 512, 32, 16
CHUNK = 4096
LOWEST = -(1 << 62)
_EXACT = float(1 << 53)
_ARRAYS = ("ids", "labels", "first", "last", "center", "radius", "children", "child_from")


@dataclass
class Tree:
    """Rows are in leaf order; node i has rows ``first[i]:last[i]`` and ``children[child_from[i]:child_from[i + 1]]``."""

    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray
    last: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    child_from: np.ndarray
    norm: float
    dim: int
    centers: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    rows: object = None


def _groups(points: np.ndarray, rows: np.ndarray, scale: float) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Children of a node: rows within ``scale`` of centres that are further apart; and the rows left."""
    found: list[tuple[np.ndarray, int]] = []
    while len(rows) > LEAF:
        seeds = rows[np.linspace(0, len(rows) - 1, min(SEEDS, len(rows))).astype(int)]
        taken: list[int] = []
        for seed in seeds:
            if not taken or np.sqrt(((points[taken] - points[seed]) ** 2).sum(1)).min() > scale:
                taken.append(int(seed))
        squares = (points[rows] ** 2).sum(1)[:, None] + (points[taken] ** 2).sum(1)[None] - 2 * points[rows] @ points[taken].T
        nearest = squares.argmin(1)
        near = squares[np.arange(len(rows)), nearest] <= scale * scale
        sizes = np.bincount(nearest[near], minlength=len(taken))
        kept = near & (sizes[nearest] >= LEAST_GROUP)
        if 8 * kept.sum() < len(rows):
            break
        found += [(rows[kept & (nearest == k)], taken[k]) for k in np.flatnonzero(sizes >= LEAST_GROUP)]
        rows = rows[~kept]
    return found, rows


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    """The file of a tree over the rows of ``vectors`` (int32)."""
    count, dim = vectors.shape
    points = vectors.astype(np.float64)
    squares = (points**2).sum(1)
    norm = float(np.sqrt(squares.max(initial=0.0)))
    points = np.concatenate([points, np.sqrt(np.maximum(norm * norm - squares, 0))[:, None]], 1)
    nodes: list[list] = []
    order: list[np.ndarray] = []
    placed = 0

    def new(center: int, radius: float) -> int:
        nodes.append([0, 0, center, radius, []])
        return len(nodes) - 1

    def reach(rows: np.ndarray, center: int) -> float:
        return float(np.sqrt(((points[rows] - points[center]) ** 2).sum(1).max(initial=0.0)))

    root = new(0, reach(np.arange(count), 0)) if count else -1
    work: list[tuple] = [("open", root, np.arange(count), False)] if count else []
    while work:
        step, node, rows, leaf = work.pop()
        if step == "close":
            nodes[node][1] = placed
            continue
        nodes[node][0] = placed
        work.append(("close", node, rows, leaf))
        center, radius = nodes[node][2], nodes[node][3]
        groups, rest = ([], rows) if leaf or len(rows) <= LEAF or radius == 0 else _groups(points, rows, radius / 2)
        if not groups:
            order.append(rows)
            placed += len(rows)
            continue
        below = [(members, seed, False) for members, seed in groups] + ([(rest, center, True)] if len(rest) else [])
        for members, seed, last in below:
            child = new(seed, reach(members, seed))
            nodes[node][4].append(child)
            work.append(("open", child, members, last))
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    arrays = {
        "ids": ids[order], "labels": labels[order], "first": np.array([x[0] for x in nodes], np.int64),
        "last": np.array([x[1] for x in nodes], np.int64), "center": np.array([x[2] for x in nodes], np.int64),
        "radius": np.array([x[3] for x in nodes]), "children": np.array([c for x in nodes for c in x[4]], np.int64),
        "child_from": np.concatenate([[0], np.cumsum([len(x[4]) for x in nodes])]).astype(np.int64),
    }
    head = io.BytesIO()
    np.save(head, np.array([norm, dim]))
    for name in _ARRAYS:
        np.save(head, arrays[name])
    np.save(head, vectors[arrays["center"]].astype(np.int32))
    return struct.pack("<q", head.tell()) + head.getvalue() + np.ascontiguousarray(vectors[order], np.int32).tobytes()


def load(handle) -> Tree:
    """The nodes of a file; ``rows(a, b)`` reads the vectors of a range only when asked."""
    handle.seek(0)
    size = struct.unpack("<q", handle.read(8))[0]
    head = io.BytesIO(handle.read(size))
    norm, dim = np.load(head)
    arrays = {name: np.load(head) for name in _ARRAYS}
    centers = np.load(head).astype(np.float64)
    dim = int(dim)

    def rows(low: int, high: int) -> np.ndarray:
        handle.seek(8 + size + 4 * dim * low)
        return np.frombuffer(handle.read(4 * dim * (high - low)), np.int32).reshape(-1, dim)

    return Tree(**arrays, norm=float(norm), dim=dim, centers=centers, rows=rows)


def _width(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components: missing ones are zero, further ones meet nothing."""
    if vectors.shape[1] >= dim:
        return vectors[:, :dim]
    return np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))


class Search:
    """The best ``k`` rows within each window of each query, over any number of trees.

    ``low`` and ``high`` (queries x windows) are whole numbers; rows of the
    query's own id never count, and rows of its label count alone (``same``) or
    never.  Better means a larger inner product, then a smaller id.
    """

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors.astype(np.float64)
        self.low, self.high, self.k, self.same = low, high, k, same
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.least = np.full(low.shape, LOWEST, np.int64)
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.visited = 0

    def _bounds(self, tree: Tree, nodes: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products (nodes x queries) of the rows below the nodes."""
        scale = tree.norm * self.norms[who]
        products = tree.centers[nodes] @ _width(self.vectors[who], tree.dim).T
        angle = np.arccos(np.clip(products / np.where(scale > 0, scale, 1), -1, 1))
        wide = 2 * np.arcsin(np.clip(tree.radius[nodes] / (2 * tree.norm or 1), 0, 1))[:, None]
        slack = 1e-6 * scale + 1e-6
        return scale * np.cos(np.minimum(np.pi, angle + wide)) - slack, scale * np.cos(np.maximum(0, angle - wide)) + slack

    def _reached(self, low: np.ndarray, high: np.ndarray, who: np.ndarray) -> np.ndarray:
        wanted = np.maximum(self.low[who], self.least[who])
        return ((high[..., None] >= wanted) & (low[..., None] <= self.high[who])).any(-1)

    def add(self, tree: Tree) -> None:
        """Searches one tree, best upper bound first."""
        if not len(tree.first) or not len(self.ids):
            return
        heap: list[tuple] = []
        self._push(heap, tree, np.array([0]), np.arange(len(self.ids)))
        while heap:
            _, node, who, low, high = heapq.heappop(heap)
            still = self._reached(low, high, who)
            who = who[still]
            if not len(who):
                continue
            children = tree.children[tree.child_from[node] : tree.child_from[node + 1]]
            if len(children):
                self._push(heap, tree, children, who)
                continue
            for at in range(tree.first[node], tree.last[node], CHUNK):
                self._leaf(tree, at, min(at + CHUNK, tree.last[node]), who)

    def _push(self, heap: list, tree: Tree, nodes: np.ndarray, who: np.ndarray) -> None:
        low, high = self._bounds(tree, nodes, who)
        reached = self._reached(low, high, who)
        for k, node in enumerate(nodes):
            held = reached[k]
            if held.any():
                heapq.heappush(heap, (-high[k, held].max(), int(node), who[held], low[k, held], high[k, held]))

    def _leaf(self, tree: Tree, first: int, last: int, who: np.ndarray) -> None:
        rows, queries = tree.rows(first, last), _width(self.vectors[who], tree.dim)
        self.visited += (last - first) * len(who)
        if tree.norm * self.norms[who].max() * (1 + 1e-9) < _EXACT:
            scores = np.rint(rows.astype(np.float64) @ queries.T).astype(np.int64)
        else:
            scores = rows.astype(np.int64) @ queries.astype(np.int64).T
        ids, labels = tree.ids[first:last], tree.labels[first:last]
        usable = ((labels[:, None] == self.labels[who]) == self.same) & (ids[:, None] != self.ids[who])
        k, windows = self.k, self.low.shape[1]
        for slot in range(windows):
            wanted = np.maximum(self.low[who, slot], self.least[who, slot])
            held = usable & (scores >= wanted) & (scores <= self.high[who, slot])
            if not held.any():
                continue
            if len(ids) > k:
                values = np.where(held, scores, LOWEST)
                kth = np.partition(values, len(ids) - k, axis=0)[len(ids) - k]
                held &= scores >= kth
                self.least[who, slot] = np.maximum(self.least[who, slot], kth)
            row, column = np.nonzero(held)
            self._keep(who[column] * windows + slot, ids[row], scores[row, column])

    def _keep(self, groups: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        groups, ids, scores = (np.concatenate(x) for x in zip(self.found, (groups, ids, scores)))
        order = np.lexsort((ids, -scores, groups))
        groups = groups[order]
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        rank = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
        kept = rank < self.k
        self.found = groups[kept], ids[order][kept], scores[order][kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.least.reshape(-1)[groups[full]] = np.maximum(self.least.reshape(-1)[groups[full]], scores[order][full])
