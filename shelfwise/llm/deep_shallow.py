"""Deep-shallow suffix sorting (Manzini and Ferragina) of the suffixes that share an anchor, and what their neighbours tell.

``deep_shallow`` orders strings by multikey quicksort on 8-byte words down to a shallow depth; groups that still agree there
are ordered by a blind trie, which looks at a few characters only on the way down and compares with one string at the end.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64
_WORD = 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The group in order. A node is [depth, children by next byte (-1: the string ends)]; a leaf is a list of equal strings."""
    root: list | tuple = ([group[0]],)
    for i in group[1:]:
        s = strings[i]
        node = root
        while len(node) == 2:  # blindly: only the bytes at the nodes' depths are looked at
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0][0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node[0].append(i)
            continue
        node, above, key = root, None, None
        while len(node) == 2 and node[0] < same:
            above, key = node, s[node[0]]
            node = node[1][key]
        own = s[same] if same < len(s) else -1
        if len(node) == 2 and node[0] == same:
            node[1][own] = ([i],)
            continue
        split = (same, {own: ([i],), (other[same] if same < len(other) else -1): node})
        if above is None:
            root = split
        else:
            above[1][key] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 1:
            out += node[0]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """The order of the strings, which agree on their first ``depth`` bytes, and each one's common prefix with the one before (0 for the first)."""
    order: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        group, at = stack.pop()
        if len(group) < 2:
            order += group
        elif at >= depth + SHALLOW:
            order += _blind_trie(strings, group)
        else:
            words = [strings[i][at : at + _WORD] for i in group]
            pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
            less, equal, more = [], [], []
            for i, w in zip(group, words, strict=True):
                (less if w < pivot else more if w > pivot else equal).append(i)
            stack.append((more, at))
            stack.append((equal, at + _WORD if len(pivot) == _WORD else depth + SHALLOW))  # shorter: they end here
            stack.append((less, at))
    return order, [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def reaches(lefts: list[bytes], rights: list[bytes], spans: tuple[int, ...], shared: int = 0) -> list[tuple[list[int], list[int]]]:
    """For each of ``spans``: how far a repeated string of so many bytes or more reaches from each anchor to the left and to the right; 0 and 0 if none does.

    ``lefts`` are the bytes before the anchor, backwards; ``rights`` those from the anchor on, which agree on ``shared`` bytes.
    Two anchors repeat a string if their common left and right parts together have its bytes."""
    n = len(rights)
    if n == 2:
        a, b = common(*lefts), common(*rights)
        return [([a, a], [b, b]) if a + b >= span else ([0, 0], [0, 0]) for span in spans]
    order, right = deep_shallow(rights, shared)
    by_left, left = deep_shallow(lefts)
    most = [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for _ in spans]
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    rank, right_of = rank[order], np.array(right)
    right_of[0] = -1
    least = [np.array(left)]  # least[k][i]: of left[i : i + 2**k]
    while 2 ** len(least) <= n:
        last, step = least[-1], 2 ** (len(least) - 1)
        least.append(np.minimum(last[:-step], last[step:]))
    for depth in sorted(set(right[1:]), reverse=True):  # intervals of suffixes that share ``depth`` bytes, the deepest first
        run = np.cumsum(right_of < depth)
        at = np.lexsort((rank, run))
        a, b = at[:-1], at[1:]
        near = np.flatnonzero(run[a] == run[b])
        a, b = a[near], b[near]
        first, after = rank[a] + 1, rank[b] + 1
        k = np.frexp((after - first).astype(np.float64))[1] - 1
        agree = np.empty(len(a), np.int64)
        for level in np.unique(k):
            own = k == level
            agree[own] = np.minimum(least[level][first[own]], least[level][after[own] - 2**level])
        for span, (most_left, most_right) in zip(spans, most, strict=True):
            ok = agree + depth >= span
            for x in (a[ok], b[ok]):
                np.maximum.at(most_left, x, agree[ok])
                most_right[x] = np.maximum(most_right[x], depth)
    out = []
    for most_left, most_right in most:
        to_left, to_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        to_left[order], to_right[order] = most_left, most_right
        out.append((to_left.tolist(), to_right.tolist()))
    return out
