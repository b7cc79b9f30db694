"""Suffix sorting by difference cover, on arrays.

The suffixes at places that are not multiples of three are sorted by their first three symbols; where that leaves ties,
the ranks become a text of their own, which is sorted in the same way. The remaining suffixes need one symbol and a
known rank each, and both orders are merged. Every step works on whole arrays.
"""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each row of the columns, from 0, and the number of ranks. Columns hold numbers from 0 on."""
    key, bound = columns[0], int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if bound * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max(initial=0)) + 1
        if bound * size >= 1 << 62:
            raise ValueError("a text is too long to sort in one piece")
        key, bound = key * size + column, bound * size
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, int(new.sum())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order. ``text`` holds numbers from 0 on; a prefix comes first."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    t = np.concatenate([np.asarray(text, np.int64) + 1, np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with one place beyond the end where it is needed
    sample = np.concatenate([ones, twos])
    ranks, count = _names(t[sample], t[sample + 1], t[sample + 2])
    if count < len(sample):
        order = suffix_array(ranks)
    else:
        order = np.empty(len(sample), np.int64)
        order[ranks] = np.arange(len(sample))
    sample_order = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sample_order] = np.arange(1, len(sample) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_names(t[zeros], rank[zeros + 1])[0], kind="stable")]

    # how many of the sample come before each of the others: both kinds compared by symbols up to a known rank
    before = np.zeros(len(zeros), np.int64)
    of_ones, of_twos = sample_order[sample_order % 3 == 1], sample_order[sample_order % 3 == 2]
    for kind, width in ((of_ones, 1), (of_twos, 2)):
        rows = np.concatenate([kind, zeros])
        keys = _names(*(t[rows + i] for i in range(width)), rank[rows + width])[0]
        before += np.searchsorted(keys[: len(kind)], keys[len(kind) :], side="left")
    out = np.empty(len(sample) + len(zeros), np.int64)
    places = before + np.arange(len(zeros))
    out[places] = zeros
    left = np.ones(len(out), bool)
    left[places] = False
    out[left] = sample_order
    return out[out < n]
