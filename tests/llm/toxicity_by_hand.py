"""The classifier over a dense matrix, in plain sums."""

import math
import re
import zlib

import numpy as np

from siftline.llm import toxicity as op


def places(text):
    """Place to the number of different words that hold an n-gram in it."""
    out = {}
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        own = {f" {w} "[i : i + k] for k in (4, 5, 6) for i in range(len(w) + 3 - k)}
        for g in {zlib.crc32(g.encode("utf-32-le")) % op.PLACES for g in own}:
            out[g] = out.get(g, 0) + 1
    return out


def fit(learned):
    """(places, their weights, intercept) from (text, label) rows."""
    every = [places(t) for t, _ in learned]
    names = sorted(set().union(*every))
    at = {g: k for k, g in enumerate(names)}
    x, y = np.zeros((len(learned), len(names))), np.array([c for _, c in learned], float)
    for row, own in zip(x, every, strict=True):
        for g, n in own.items():
            row[at[g]] = n
    n, prior = len(y), y.mean()
    ratio = lambda k: math.log(((x[y == 1, k] > 0).sum() + prior) / prior) - math.log(((x[y == 0, k] > 0).sum() + 1 - prior) / (1 - prior))
    r = np.array([ratio(k) for k in range(len(names))])
    w, m, s = np.append(np.zeros(len(names)), math.log((y.sum() + 1) / (n - y.sum() + 1))), 0.0, 0.0
    for t in range(1, op.STEPS + 1):
        p = 1 / (1 + np.exp(-(x * r @ w[:-1] + w[-1])))
        g = np.append((x * r).T @ (p - y) / n + op.RIDGE * w[:-1], (p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return names, w[:-1] * r, float(w[-1])


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
