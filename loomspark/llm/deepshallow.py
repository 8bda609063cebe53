"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries below it.

The shallow part is breadth first: in each round every open segment (rows that agree so far) picks a pivot for its
current character, eight bytes wide, and all segments are parted into smaller, equal and larger at once; the equal part
moves on to the next character. Segments that still agree at the shallow depth share a long prefix; there a blind trie
(Ferragina and Grossi, 1999) orders them: it keeps only the positions where strings branch, so a string goes down by
single bytes, is compared once with a leaf, and is hung in where the two part.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first start bytes are known to agree."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Branch:
    __slots__ = ("depth", "leaf", "to")

    def __init__(self, depth: int, leaf: bytes):
        self.depth, self.leaf, self.to = depth, leaf, {}


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Distinct strings in order, with the common prefix of each and the one before it."""

    def __init__(self) -> None:
        self.root: _Branch | bytes | None = None

    def add(self, s: bytes, known: int = 0) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while isinstance(node, _Branch):  # blind: only branching bytes are looked at
            node = node.to.get(_byte(s, node.depth), node.leaf)
        if node == s:
            return
        depth = common_prefix(s, node, known)
        above, key, node = None, 0, self.root
        while isinstance(node, _Branch) and node.depth < depth:
            above, key = node, _byte(s, node.depth)
            node = node.to[key]
        if isinstance(node, _Branch) and node.depth == depth:
            node.to[_byte(s, depth)] = s
            return
        new = _Branch(depth, s)
        new.to[_byte(s, depth)] = s
        new.to[_byte(node.leaf if isinstance(node, _Branch) else node, depth)] = node
        if above is None:
            self.root = new
        else:
            above.to[key] = new

    def ordered(self) -> list[tuple[bytes, int]]:
        out: list[tuple[bytes, int]] = []
        stack = [(self.root, 0)] if self.root is not None else []
        while stack:
            node, shared = stack.pop()
            if not isinstance(node, _Branch):
                out.append((node, shared))
                continue
            keys = sorted(node.to)
            for i in range(len(keys) - 1, -1, -1):
                stack.append((node.to[keys[i]], node.depth if i else shared))
        return out


def _characters(strings: list[bytes], depth: int) -> np.ndarray:
    """The first depth bytes as big-endian words of eight, zeros after the end."""
    raw = b"".join(s[:depth].ljust(depth, b"\0") for s in strings)
    return np.frombuffer(raw, dtype=">u8").reshape(len(strings), depth // 8).astype(np.uint64)


def deep_shallow_sort(bucket: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (bucket, string), and the common prefix of each with the row before it; -1 where a bucket begins."""
    n = len(strings)
    order = np.argsort(bucket, kind="stable")
    lcp = np.full(n, -1, dtype=np.int64)
    if n == 0:
        return order, lcp
    chars = _characters(strings, shallow)
    # segments: rows in order, each with its segment's number and the character that it is at
    seg = np.cumsum(np.diff(bucket[order], prepend=bucket[order[:1]]) != 0)
    at = np.zeros(n, dtype=np.int64)
    wide = shallow // 8
    while True:
        size = np.bincount(seg, minlength=int(seg[-1]) + 1)
        open_ = (size[seg] > 1) & (at < wide)
        if not open_.any():
            break
        rows = np.flatnonzero(open_)
        first = np.zeros(len(size), dtype=np.int64)
        np.cumsum(size[:-1], out=first[1:])
        value = chars[order[rows], at[rows]]
        spread = np.zeros(n, dtype=np.uint64)
        spread[rows] = value
        s = seg[rows]
        low, mid, high = spread[first[s]], spread[first[s] + size[s] // 2], spread[first[s] + size[s] - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))
        side = (value > pivot).astype(np.int64) + (value >= pivot)
        part = np.argsort(s * 3 + side, kind="stable")
        order[rows] = order[rows][part]
        at[rows] = at[rows][part] + (side[part] == 1)
        key = seg * 3
        key[rows] = (s * 3 + side)[part]
        seg = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    _finish(order, seg, bucket, strings, lcp)
    return order, lcp


def _finish(order: np.ndarray, seg: np.ndarray, bucket: np.ndarray, strings: list[bytes], lcp: np.ndarray) -> None:
    """Order each remaining segment by a blind trie, and find all common prefixes."""
    begins = np.append(np.flatnonzero(np.diff(seg, prepend=seg[:1] - 1)), len(seg))
    ordered = order.tolist()
    in_bucket = (np.diff(bucket[order], prepend=bucket[order[:1]]) == 0).tolist()
    in_bucket[0] = False
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if in_bucket[a]:
            lcp[a] = common_prefix(strings[ordered[a - 1]], strings[ordered[a]])
        if b - a == 1:
            continue
        same: dict[bytes, list[int]] = {}
        for row in ordered[a:b]:
            same.setdefault(strings[row], []).append(row)
        if len(same) == 1:
            lcp[a + 1 : b] = len(strings[ordered[a]])
            continue
        trie = BlindTrie()
        for s in same:
            trie.add(s)
        k = a
        for s, shared in trie.ordered():
            rows = same[s]
            if k > a:
                lcp[k] = shared
            lcp[k + 1 : k + len(rows)] = len(s)
            ordered[k : k + len(rows)] = rows
            k += len(rows)
        if in_bucket[a]:  # the first row may be another one now
            lcp[a] = common_prefix(strings[ordered[a - 1]], strings[ordered[a]])
    order[:] = ordered
