"""Winnowed anchors over sequences of item hashes, shared by line and substring dedup.

A window is T = k + w - 1 consecutive items. Its anchor is the k-gram of least
hash among its w k-grams, the rightmost of equals: equal windows, wherever they
are, have equal anchors at equal places. So every repeat of T items or more is
found by joining positions on anchors, and windows around an anchor tell how far
a repeat reaches to both sides of it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .textkit import grams, window_argmin


class Anchors(NamedTuple):
    """Anchors of rows, in order. begin[i]:begin[i + 1] are those windows, by place in start and window, whose anchor is i."""

    row: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    window: np.ndarray


def anchors(h: np.ndarray, ptr: np.ndarray, k: int, w: int) -> Anchors:
    """Anchors of rows of items; start: first item of a window in its row; window: its hash."""
    t = k + w - 1
    n = len(h) - t + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none.astype(np.uint64), np.zeros(1, np.int64), none, none.astype(np.uint64))
    length = np.diff(ptr)
    row = np.repeat(np.arange(len(length)), length)[:n]
    inside = np.repeat(ptr[1:], length)[:n] - np.arange(n) >= t
    g = grams(h, k)
    owner = window_argmin(g, w)[:n]
    at = np.flatnonzero(inside)
    row, owner = row[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return Anchors(row[first], g[owner[first]], np.append(first, len(at)), at - ptr[:-1][row], grams(h, t)[at])
