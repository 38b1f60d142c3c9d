"""Plain NumPy versions of the metrics, written for small inputs only."""

import numpy as np


def points(y, s):
    """Score, tp, fp at every distinct score, highest first."""
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    levels = np.unique(s)[::-1]
    tp = np.array([((s >= t) & (y == 1)).sum() for t in levels])
    fp = np.array([((s >= t) & (y == 0)).sum() for t in levels])
    return levels, tp, fp


def auroc(y, s):
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def pr(y, s):
    """Precision and recall in ascending threshold order with the end point (1, 0), and thresholds."""
    levels, tp, fp = points(y, s)
    precision, recall = tp / (tp + fp), tp / tp[-1]
    return np.r_[precision[::-1], 1.0], np.r_[recall[::-1], 0.0], levels[::-1]


def auprc(y, s):
    precision, recall, _ = pr(y, s)
    return -np.trapezoid(precision, recall)


def average_precision(y, s):
    precision, recall, _ = pr(y, s)
    return -np.sum(np.diff(recall) * precision[:-1])
