"""Heavy-path labels of small forests, in numpy."""

from __future__ import annotations

import numpy as np


def depths(parent: np.ndarray) -> np.ndarray:
    """Depth of each node; parent: index of each node's parent, -1 for roots. No cycles. By doubling."""
    depth, up = (parent >= 0).astype(np.int64), parent.copy()
    while (open_ := up >= 0).any():
        depth[open_] += depth[up[open_]]
        up[open_] = up[up[open_]]
    return depth


def heavy_paths(v: np.ndarray, parent: np.ndarray, leaves: np.ndarray) -> dict[str, np.ndarray]:
    """head, pos, depth, first and size of the nodes of a forest.

    v: names, parent: index of each node's parent, -1 for roots, leaves: children that aren't nodes here. size counts a node, all below it and their leaves.
    A node's chain goes on in its child with the largest size, of equal ones the greatest v; head is the v of the chain's first node, pos the place in the chain. first is
    the number in preorder within the tree: after a node come its heavy child's tree, the other children's in order of v, then its leaves.
    """
    n = len(v)
    depth = depths(parent)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = leaves.astype(np.int64) + 1
    for own in reversed(levels[1:]):
        np.add.at(size, parent[own], size[own])
    children = np.flatnonzero(parent >= 0)
    by_size = children[np.lexsort((v[children], size[children], parent[children]))]
    heavy = np.zeros(n, dtype=bool)
    if len(by_size):
        heavy[by_size[np.r_[parent[by_size][1:] != parent[by_size][:-1], True]]] = True
    siblings = children[np.lexsort((v[children], ~heavy[children], parent[children]))]
    offset = np.zeros(n, dtype=np.int64)
    if len(siblings):
        so_far = np.cumsum(size[siblings]) - size[siblings]
        begin = np.r_[True, parent[siblings][1:] != parent[siblings][:-1]]
        base = so_far[begin][np.cumsum(begin) - 1]
        offset[siblings] = 1 + so_far - base
    first, head, pos = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64)
    for own in levels[1:]:
        up = parent[own]
        first[own] = first[up] + offset[own]
        on = heavy[own]
        head[own[on]], pos[own[on]] = head[up[on]], pos[up[on]] + 1
    return {"head": v[head], "pos": pos, "depth": depth, "first": first, "size": size}
