"""A two-tag linear-chain conditional random field over bounded windows of tokens.

Tag 1 marks a token as part of a toxic span. A token's feature weights add up to its emission
for tag 1 (tag 0 has 0); ``step[i, j]`` scores tag ``j`` after tag ``i``, ``first[j]`` the tag at
the start of a window. All arrays hold windows in rows and positions in columns.
"""

from __future__ import annotations

import numpy as np

WINDOW = 64


def windows(lengths: list[int], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of consecutive tokens in a (rows, size) table: every document starts a new row."""
    rows, cols, row = [], [], 0
    for n in lengths:
        at = np.arange(n)
        rows.append(row + at // size)
        cols.append(at % size)
        row += -(-n // size)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(rows), join(cols)


def marginals(emit: np.ndarray, real: np.ndarray, step: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Forward-backward: the chance of tag 1 at every place, and with ``pairs`` the log
    likelihood's normaliser and the expected number of each transition.

    Messages are scaled at every place, so windows of any length keep full precision.
    """
    n, size = emit.shape
    shift = np.maximum(emit, 0)
    score = np.stack([np.exp(-shift), np.exp(emit - shift)], axis=2)
    move, start = np.exp(step), np.exp(first)
    ahead = np.empty((size, n, 2))
    scale = np.ones((size, n))
    for t in range(size):
        now = (start if t == 0 else ahead[t - 1] @ move) * score[:, t]
        total = now.sum(axis=1)
        live = real[:, t]
        scale[t] = np.where(live, total, 1.0)
        ahead[t] = now / total[:, None]
        if not live.all():
            ahead[t] = np.where(live[:, None], ahead[t], ahead[t - 1] if t else 0.5)
    back = np.ones((n, 2))
    tagged = np.empty((n, size))
    between = np.zeros((2, 2))
    for t in range(size - 1, -1, -1):
        both = ahead[t] * back
        tagged[:, t] = both[:, 1] / both.sum(axis=1)
        if t:
            live = real[:, t]
            onward = score[:, t] * back
            if pairs:
                joint = ahead[t - 1][:, :, None] * move[None] * onward[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                between += joint[live].sum(axis=0)
            before = onward @ move.T
            before /= before.sum(axis=1, keepdims=True)
            back = np.where(live[:, None], before, 1.0)
    if not pairs:
        return tagged
    return tagged, float(np.log(scale).sum() + shift[real].sum()), between


def fit(flat: np.ndarray, owner: np.ndarray, lengths: list[int], gold: np.ndarray, n_features: int,
        rounds: int = 60, l2: float = 1.0, rate: float = 0.5):
    """Weights by AdaGrad steps on the penalised likelihood of the given tags.

    ``flat`` holds feature ids and ``owner`` the token of each; windows are cut from
    ``lengths``. The same input gives the same weights.
    """
    rows, cols = windows(lengths)
    n = int(rows.max()) + 1 if len(rows) else 0
    weight, step, first = np.zeros(n_features), np.zeros((2, 2)), np.zeros(2)
    if not n:
        return weight, step, first
    real = np.zeros((n, WINDOW), bool)
    real[rows, cols] = True
    tags = np.zeros((n, WINDOW), np.int64)
    tags[rows, cols] = gold
    seen = np.zeros((2, 2))
    inner = real[:, 1:]
    np.add.at(seen, (tags[:, :-1][inner], tags[:, 1:][inner]), 1)
    start = np.bincount(tags[:, 0], minlength=2).astype(float)
    sums = [np.full_like(x, 1e-8) for x in (weight, step, first)]
    emit = np.zeros((n, WINDOW))
    for _ in range(rounds):
        emit[rows, cols] = np.bincount(owner, weights=weight[flat], minlength=len(gold))
        tagged, _, between = marginals(emit, real, step, first, pairs=True)
        miss = gold - tagged[rows, cols]
        at_start = np.array([1 - tagged[:, 0], tagged[:, 0]]).sum(axis=1)
        slopes = (
            np.bincount(flat, weights=miss[owner], minlength=n_features) - l2 * weight,
            seen - between - l2 * step,
            start - at_start - l2 * first,
        )
        for x, slope, total in zip((weight, step, first), slopes, sums, strict=True):
            total += slope**2
            x += rate * slope / np.sqrt(total)
    return weight, step, first
