"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and merging by binary search."""

from __future__ import annotations

import numpy as np


def refine(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of the bytes of text. Behind the end stand zeros; a suffix that ends first comes first.

    Suffixes are first sorted by 8 bytes. Then, as Larsson and Sadakane do, each pass doubles the sorted length by
    the ranks of the suffixes that start where the sorted part ends, and sorts groups that are still tied, only.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    sa = n - 1 - np.argsort(key[::-1], kind="stable")  # of equal keys the shorter suffix first
    short = sa > n - 8  # these end within the key, so none of them is tied
    first = np.concatenate(([True], (key[sa][1:] != key[sa][:-1]) | short[1:] | short[:-1])) if n else np.zeros(0, bool)
    start = np.flatnonzero(first)
    size = np.diff(np.concatenate((start, [n])))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(start, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))  # places in sa of tied suffixes
    h = 8
    while len(slots):
        tied = sa[slots]
        ahead = tied + h
        next_rank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[tied]
        order = np.lexsort((next_rank, group))
        tied, group, next_rank = tied[order], group[order], next_rank[order]
        sa[slots] = tied
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate((at, [len(tied)])))
        rank[tied] = np.repeat(slots[at], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank


def kasai(text: np.ndarray, sa: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Longest common prefix, up to `most`, of each suffix in sa with the one before it.

    Kasai's scan: the prefix of suffix i + 1 is shorter than that of suffix i by one at most. The text is cut into
    lanes that scan in step, so that numpy advances all of them at once.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.where(place > 0, sa[place - 1], -1)
    padded = np.concatenate((text, np.zeros(most + 1, np.uint8)))
    at = np.arange(0, n, lane)
    known = np.zeros(len(at), np.int64)
    for _ in range(lane):
        live = at < n
        at, known = at[live], known[live]
        other = before[at]
        known = np.where(other >= 0, np.maximum(known - 1, 0), 0)
        go = np.flatnonzero(other >= 0)
        while len(go):
            i, j, k = at[go], other[go], known[go]
            same = (k < most) & (np.maximum(i, j) + k < n)
            same &= padded[np.minimum(i + k, n + most)] == padded[np.minimum(j + k, n + most)]
            go = go[same]
            known[go] += 1
        out[place[at]] = known
        at = at + 1
    return out


def shared_between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the members of two sorted arrays that the other holds too, by binary search."""

    def held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(y):
            return np.zeros(len(x), bool)
        return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x

    return held(a, b), held(b, a)
