"""Deep-shallow sorting of suffixes, as far as a fixed length.

Multikey quicksort orders the suffixes to a shallow depth, eight bytes at a time; every pass splits all open groups
three ways around their pivots at once. Groups that still agree at that depth are ordered by blind tries.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at before tries take over; a multiple of eight.
SHALLOW = 80


def words_of(buffer: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number; zeros follow the end."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(buffer), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(buffer)]
    return word


def multikey(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `depth` bytes, and for each place whether a new group begins there."""
    n = len(starts)
    order, fresh = np.arange(n), np.zeros(n, bool)
    if n:
        fresh[0] = True
    at = np.zeros(n, np.int64)  # bytes that all of a place's group agree on
    open_ = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    while len(open_):
        begins = np.flatnonzero(fresh[open_])
        group = np.cumsum(fresh[open_]) - 1
        sizes = np.diff(np.append(begins, len(open_)))
        word = words[starts[order[open_]] + at[open_]]
        three = np.sort(np.stack([word[begins], word[begins + sizes // 2], word[begins + sizes - 1]]), axis=0)
        pivot = three[1][group]
        side = (word > pivot).astype(np.int64) + (word >= pivot)
        turn = np.argsort(group * 3 + side, kind="stable")
        order[open_] = order[open_][turn]
        key = (group * 3 + side)[turn]
        at[open_] = at[open_] + np.where(side[turn] == 1, 8, 0)
        fresh[open_] = np.append(True, key[1:] != key[:-1])
        # Places in groups of one are settled, and so are groups at the depth.
        last = np.append(fresh[open_][1:], True)
        still = ~(fresh[open_] & last) & (at[open_] < depth)
        open_ = open_[still]
    return order, fresh


class BlindTrie:
    """A trie over strings of one length whose inner nodes know only the place where their branches part.

    A node is [place, {byte: child}], a leaf the list of the equal strings' numbers. A string first goes down
    blindly to some leaf; comparing with that leaf gives the place where it parts, and there it is hung in.
    """

    def __init__(self):
        self.root = None

    def add(self, text: bytes, number: int, of: dict[int, bytes]) -> None:
        if self.root is None:
            self.root = [number]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = of[node[0]]
        if other == text:
            node.append(number)
            return
        apart = _apart(text, other)
        parent, child = None, self.root
        for node in path:
            if node[0] >= apart:
                break
            parent, child = node, node[1].get(text[node[0]])
        if isinstance(child, tuple) and child[0] == apart:
            child[1][text[apart]] = [number]
            return
        new = (apart, {other[apart]: child, text[apart]: [number]})
        if parent is None:
            self.root = new
        else:
            parent[1][text[parent[0]]] = new

    def leaves(self):
        """The lists of equal strings in order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node


def _apart(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def equal_classes(buffer: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in the order of their first `length` bytes, and the number of each one's class there.

    Every start has `length` bytes in the buffer.
    """
    shallow = min(shallow, length // 8 * 8)
    order, fresh = multikey(words_of(buffer), starts, shallow)
    begins = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begins, len(order)))
    # In a group of long common prefixes most suffixes equal the first one; only the others need a trie.
    tail = np.lib.stride_tricks.sliding_window_view(buffer, length - shallow) if len(order) else None
    group = np.repeat(np.arange(len(begins)), sizes)
    multiple = np.flatnonzero(sizes[group] > 1) if len(order) else np.zeros(0, np.int64)
    leader = order[begins[group[multiple]]]
    same = np.ones(len(multiple), bool)
    for i in range(0, len(multiple), 1 << 18):
        part = slice(i, i + (1 << 18))
        same[part] = (tail[starts[order[multiple[part]]] + shallow] == tail[starts[leader[part]] + shallow]).all(1)
    mixed = np.unique(group[multiple[~same]])
    new = fresh.copy()
    place = np.zeros(len(order), bool)
    place[multiple[same]] = True
    for g in mixed:
        a, b = begins[g], begins[g] + sizes[g]
        members, alike = order[a:b].copy(), place[a:b]
        first = int(members[0])
        trie, of = BlindTrie(), {}
        for i in [first, *members[~alike].tolist()]:
            at = int(starts[i]) + shallow
            of[i] = buffer[at : at + length - shallow].tobytes()
            trie.add(of[i], i, of)
        out, at = [], a
        for leaf in trie.leaves():
            if leaf[0] == first:
                leaf = members[alike].tolist() + leaf[1:]
            new[at] = True
            out += leaf
            at += len(leaf)
        order[a:b] = out
    return order, np.cumsum(new) - 1
