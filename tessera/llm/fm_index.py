"""FM-index of a symbol sequence: suffix array, Burrows-Wheeler transform, wavelet tree, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, a proper prefix first. Only unresolved groups are sorted again as the compared length doubles."""
    n = len(text)
    bits = max(1, int(text.max(initial=0) + 1).bit_length())
    length = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(length):  # the first symbols packed into one number; 0 stands past the end
        key <<= bits
        key[: n - k] |= text[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)  # the first place in order of the suffix's group
    rank[order] = starts[np.cumsum(new) - 1]
    size = np.diff(np.append(starts, n))
    open_rows = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_rows):
        at = order[open_rows]
        after = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((after, group))
        at, after, group = at[by], after[by], group[by]
        order[open_rows] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        starts = np.flatnonzero(new)
        rank[at] = open_rows[starts][np.cumsum(new) - 1]
        size = np.diff(np.append(starts, len(at)))
        open_rows = open_rows[np.repeat(size > 1, size)]
        length *= 2
    return order


class WaveletTree:
    """Ranks of symbols by levels of bits, highest first; each level keeps its prefix counts of zeros."""

    def __init__(self, text: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for level in range(bits - 1, -1, -1):
            ones = (text >> level) & 1 == 1
            count = np.zeros(len(text) + 1, np.int32)
            np.cumsum(~ones, out=count[1:])
            self.zeros.append(count)
            text = np.concatenate([text[~ones], text[ones]])

    def rank(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """For each array of places: how often each symbol stands before its place."""
        at = [np.zeros(len(symbols), np.int64), *places]
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            one = (symbols >> level) & 1 == 1
            at = [np.where(one, zeros[-1] + p - zeros[p], zeros[p]) for p in at]
        return [p - at[0] for p in at[1:]]


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 0. They move up by one, so that the end, 0, is unique and stepping back never mixes it with a symbol."""
        text = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_array(text)
        top = int(text.max())
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.top, self.tree = top, WaveletTree(self.bwt, max(1, top.bit_length()))
        self.marked = order % SAMPLE_EVERY == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of rows of symbols, right-aligned in `patterns`: the suffix interval of each, empty if absent."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            go = lengths[live] > patterns.shape[1] - 1 - column
            rows = live[go]
            if not len(rows):
                break
            c = patterns[rows, column].astype(np.int64) + 1
            known = c <= self.top
            safe = np.where(known, c, 0)
            a, b = self.tree.rank(safe, low[rows], high[rows])
            low[rows] = np.where(known, self.before[safe] + a, 0)
            high[rows] = np.where(known, self.before[safe] + b, 0)
            live = rows[low[rows] < high[rows]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled position."""
        out, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked[rows]
            out[left[hit]] = self.samples[self.mark_rank[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.before[c] + self.tree.rank(c, rows)[0]
            steps += 1
        return out
