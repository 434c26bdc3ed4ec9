"""Connection costs summed from feature pairs, for the pairs that are asked."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Pairs of ids whose templates are looked up together.
TOGETHER = 1 << 15


def pair_keys(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number for each pair of a right and a left feature's number."""
    h = (right * _RIGHT) ^ ((left * _LEFT) >> _U(7)) ^ (left * _LEFT)
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def bucket_starts(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(shift, starts): keys of equal leading bits stand together, about two in a bucket, so that a key is found in a few steps."""
    bits = max(1, int(len(keys)).bit_length() - 1)
    shift = 64 - bits
    return shift, np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(shift)).astype(np.int64)


class PairCosts:
    """The sum, over feature templates, of the cost of (right feature, left feature); pairs without a cost add 0.

    ``right`` and ``left`` hold the features' numbers by id and template (0: none), ``keys``
    the sorted numbers of the pairs that cost something.  With ``raw`` templates, the others' sum is
    cut to 16 bits first.
    """

    def __init__(self, right: np.ndarray, left: np.ndarray, keys: np.ndarray, costs: np.ndarray, raw: np.ndarray | None = None):
        self.right, self.left, self.keys, self.costs = right, left, keys, costs
        self.raw = None if raw is None else np.asarray(raw, dtype=bool)
        self.shift, self.starts = bucket_starts(keys)
        self.deepest = int(np.diff(np.append(self.starts, len(keys))).max(initial=0))

    def _found(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int64)
        at = self.starts[(wanted >> _U(self.shift)).astype(np.int64)]
        out = np.zeros(len(wanted), dtype=np.int64)
        open_ = np.arange(len(wanted))
        for _ in range(self.deepest):
            open_ = open_[at[open_] < len(self.keys)]
            key = self.keys[at[open_]]
            hit = key == wanted[open_]
            out[open_[hit]] = self.costs[at[open_[hit]]]
            open_ = open_[key < wanted[open_]]
            if not len(open_):
                break
            at[open_] += 1
        return out

    def conn(self, left_ids: np.ndarray, right_ids: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(right_ids.astype(np.int64) << 32 | left_ids, return_inverse=True)
        out = np.empty(len(pairs), dtype=np.int64)
        for lo in range(0, len(pairs), TOGETHER):
            some = pairs[lo : lo + TOGETHER]
            r, l = self.right[some >> 32], self.left[some & 0xFFFFFFFF]
            both = (r != 0) & (l != 0)
            cost = np.zeros(r.shape, dtype=np.int64)
            cost[both] = self._found(pair_keys(r[both], l[both]))
            if self.raw is None:
                out[lo : lo + len(some)] = cost.sum(axis=1)
            else:
                out[lo : lo + len(some)] = np.clip(cost[:, ~self.raw].sum(axis=1), -32768, 32767) + cost[:, self.raw].sum(axis=1)
        return out[back]
