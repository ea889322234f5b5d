"""Deep-shallow sorting of suffixes, by their first ``DEPTH`` bytes."""

from __future__ import annotations

import numpy as np

#: Bytes compared, and bytes that the multikey quicksort orders before blind tries take over.
DEPTH, SHALLOW = 50, 32
_SMALL = 4096


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, first byte highest; behind the end stand zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = (padded[:-1].astype(np.uint16) << 8) | padded[1:]
    four = (two[:-2].astype(np.uint32) << 16) | two[2:]
    return ((four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:])[: len(data)]


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """An order by all keys: a segment is split in three around a pivot of one key, and what equals it goes on to the next key."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, level = todo.pop()
        if level == len(keys) or high - low < 2:
            continue
        segment = order[low:high]
        if high - low <= _SMALL:
            order[low:high] = segment[np.lexsort([k[segment] for k in reversed(keys[level:])])]
            continue
        values = keys[level][segment]
        pivot = np.sort(values[:: len(values) // 9])[4]
        less, same = values < pivot, values == pivot
        parts = [segment[less], segment[same], segment[~(less | same)]]
        order[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), low + len(parts[0]) + len(parts[1])
        todo += [(low, a, level), (a, b, level + 1), (b, high, level)]
    return order


class BlindTrie:
    """Orders strings by the bytes where they branch only: a search skips to a leaf, and one comparison with it tells the
    true place."""

    def __init__(self):
        self.root = None  # a leaf (string, members) or a branch [depth, {byte: child}]

    def insert(self, text: bytes, members: list[int]) -> None:
        if self.root is None:
            self.root = (text, members)
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].extend(members)
            return
        apart = int.from_bytes(text) ^ int.from_bytes(other)
        depth = len(text) - (apart.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, members)
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        branch = [depth, {other[depth]: node, text[depth]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """Members of each string, in the strings' order."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node:
                out.append(node[1])
        return out


def suffix_array(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` within their groups, and a class number by place in that order: suffixes of
    one class share their first DEPTH bytes. ``data`` must reach DEPTH bytes behind each start."""
    eight = words(data)
    keys = [group.astype(np.uint64)] + [eight[starts + k] for k in range(0, SHALLOW, 8)]
    order = multikey_quicksort(keys)
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(new)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    differs = np.zeros(len(order), bool)
    place, leader = starts[order], starts[order[first]][run]
    for k in [*range(SHALLOW, DEPTH - 7, 8), DEPTH - 8]:
        differs |= eight[place + k] != eight[leader + k]
    changes = new.copy()
    whole, bounds = data.tobytes(), np.append(first, len(order))
    sorted_places, sorted_members, opened = [], [], []
    for low, high in zip(*(bounds[np.unique(run[differs]) + k].tolist() for k in (0, 1)), strict=True):  # these share a long prefix, but not all of it
        equal: dict[bytes, list[int]] = {}
        for m, start in zip(order[low:high].tolist(), place[low:high].tolist(), strict=True):
            equal.setdefault(whole[start + SHALLOW : start + DEPTH], []).append(m)
        trie = BlindTrie()
        for text, members in equal.items():
            trie.insert(text, members)
        at = low
        for leaf in trie.leaves():
            opened.append(at)
            sorted_members += leaf
            at += len(leaf)
        sorted_places.append(np.arange(low, high))
    if opened:
        order[np.concatenate(sorted_places)] = sorted_members
        changes[opened] = True
    return order, np.cumsum(changes) - 1
