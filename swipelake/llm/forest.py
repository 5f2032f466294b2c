"""A forest of random-projection trees: fitted on a sample, searched best-first."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Inner nodes with a direction, a threshold and two children; a child below 0 is leaf ``-1 - child``."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int


def _direction(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Between two random points, or any where they are equal."""
    a, b = points[rng.integers(len(points), size=2)]
    step = a - b
    norm = np.linalg.norm(step)
    if norm < 1e-9:
        step = rng.normal(size=points.shape[1])
        norm = np.linalg.norm(step)
    return step / norm


def grow_tree(points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """Split at the median of projections until at most ``leaf_rows`` sample points are left."""
    directions, thresholds, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        for _ in range(4 if len(rows) > leaf_rows else 0):
            direction = _direction(points[rows], rng)
            heights = points[rows] @ direction
            middle = float(np.median(heights))
            low = heights <= middle
            if low.any() and not low.all():
                split = direction, middle, low
                break
        if split is None:
            node = -1 - leaves
            leaves += 1
        else:
            node = len(children)
            directions.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            todo.append((rows[split[2]], node, 0))
            todo.append((rows[~split[2]], node, 1))
        if parent >= 0:
            children[parent][side] = node
    width = points.shape[1]
    return Tree(
        np.array(directions, dtype=np.float32).reshape(-1, width),
        np.array(thresholds, dtype=np.float64),
        np.array(children, dtype=np.int32).reshape(-1, 2),
        leaves,
    )


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.full(len(points), 0 if len(tree.children) else -1, dtype=np.int64)
    inner = np.flatnonzero(node >= 0)
    while len(inner):
        at = node[inner]
        height = np.einsum("ij,ij->i", points[inner], tree.directions[at])
        node[inner] = tree.children[at, (height > tree.thresholds[at]).astype(np.int64)]
        inner = inner[node[inner] >= 0]
    return -1 - node


def search(forest: list[Tree], point: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The ``leaves`` leaves nearest to ``point`` by one priority queue that all trees share.

    Going the wrong way at a split costs the squared margin; what a path costs adds up, which estimates the
    squared distance to the far cell.
    """
    queue = [(0.0, tree, 0 if len(t.children) else -1) for tree, t in enumerate(forest)]
    heapq.heapify(queue)
    found: list[tuple[int, int]] = []
    while queue and len(found) < leaves:
        cost, at, node = heapq.heappop(queue)
        tree = forest[at]
        while node >= 0:
            margin = float(point @ tree.directions[node]) - tree.thresholds[node]
            near, far = (1, 0) if margin > 0 else (0, 1)
            heapq.heappush(queue, (cost + margin * margin, at, int(tree.children[node, far])))
            node = int(tree.children[node, near])
        found.append((at, -1 - node))
    return found


def leaves_needed(
    forest: list[Tree], points: np.ndarray, k: int, recall: float, queries: int = 100
) -> int:
    """So many leaves find ``recall`` of the true ``k`` neighbours, measured on the sample itself."""
    chosen = np.unique(np.linspace(0, len(points) - 1, min(queries, len(points))).astype(np.int64))
    near = points[chosen] @ points.T
    near[np.arange(len(chosen)), chosen] = -np.inf
    width = min(k, len(points) - 1)
    if width < 1:
        return 1
    best = np.argpartition(-near, width - 1, axis=1)[:, :width]
    home = [leaf_of(tree, points) for tree in forest]
    ranks = []
    for at, own in zip(chosen, best, strict=True):
        place = {leaf: rank for rank, leaf in enumerate(search(forest, points[at], 1 << 60))}
        ranks.extend(min(place[(t, int(home[t][j]))] for t in range(len(forest))) for j in own)
    return int(np.quantile(ranks, recall)) + 1
