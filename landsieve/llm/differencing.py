"""Multiway number partitioning by largest differencing (Karmarkar and Karp), for one bounded block of pieces."""

from __future__ import annotations

import heapq

import numpy as np


def difference(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Spread ``sizes`` over ``ways`` windows; returns (window of each size, load of each window).

    Every size starts as a partial partition that fills one window. The two partial partitions
    with the largest imbalance are merged again and again, the fullest windows of one meeting the
    emptiest of the other, so that opposing imbalances cancel. A merge costs one sort of ``ways``
    numbers; what a window holds is a tree of merges, so no list is copied.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)  # nodes from n on join two nodes
    made = n
    heap: list[tuple[int, int]] = []
    loads: dict[int, np.ndarray] = {}
    nodes: dict[int, np.ndarray] = {}
    for i in range(n):
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    fresh = n

    def opened(key: int) -> tuple[np.ndarray, np.ndarray]:
        if key in loads:
            return loads.pop(key), nodes.pop(key)
        load, node = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        load[0], node[0] = sizes[key], key
        return load, node

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        load, node = opened(a)
        other_load, other_node = opened(b)
        load = load + other_load[::-1]
        other_node = other_node[::-1]
        both = np.flatnonzero((node >= 0) & (other_node >= 0))
        merged = np.where(node >= 0, node, other_node)
        if len(both):
            new = np.arange(made, made + len(both))
            left[new], right[new] = node[both], other_node[both]
            merged[both] = new
            made += len(both)
        order = np.argsort(-load, kind="stable")
        load, merged = load[order], merged[order]
        loads[fresh], nodes[fresh] = load, merged
        heapq.heappush(heap, (-int(load[0] - load[-1]), fresh))
        fresh += 1

    load, node = opened(heap[0][1])
    window = np.empty(n, np.int64)
    for w in range(ways):
        stack = [int(node[w])] if node[w] >= 0 else []
        while stack:
            top = stack.pop()
            if top < n:
                window[top] = w
            else:
                stack += (int(left[top]), int(right[top]))
    return window, load


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): the fewest windows that differencing fills without passing ``capacity``.

    The count starts at the least that can hold the block and rises by half a percent, one window at
    least, whenever the fullest window passes the capacity. No size may pass the capacity.
    """
    if len(sizes) == 0:
        return np.empty(0, np.int64), 0
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while ways < len(sizes):
        window, load = difference(sizes, ways)
        if load.max() <= capacity:
            used = np.unique(window, return_inverse=True)
            return used[1], len(used[0])
        ways += max(1, ways // 200)
    return np.arange(len(sizes)), len(sizes)
