"""Small linear models fitted on bounded samples: sparse and dense logistic regression, folds, Platt calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of a labelled document that models are fitted on at most; longer ones are only scored. With ``most`` it bounds a sample.
LONGEST = 1 << 14


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``most`` documents of at most LONGEST bytes with all labels ``names``, those with the smallest hashes of their
    id: _id, _text, and _y0, _y1 ... for the labels.

    Rows without an id or a label don't take part; of several labels for an id the largest counts, of several texts the first.
    """
    whole = labels.filter(F.col(id_col).isNotNull())
    for name in names:
        whole = whole.filter(F.col(name).isNotNull())
    by_id = whole.groupBy(F.col(id_col).alias("_id")).agg(*(F.max(name).cast("int").alias(f"_y{k}") for k, name in enumerate(names)))
    picked = by_id.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id").limit(most)  # at most ``most`` rows: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.octet_length("_text") <= LONGEST)
    return texts.join(F.broadcast(picked), "_id").groupBy("_id", *(f"_y{k}" for k in range(len(names)))).agg(F.min("_text").alias("_text"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, dim: int, inside: np.ndarray | None = None, steps: int = 50, rate: float = 0.5, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows, by Adam on the whole batch; only rows ``inside`` count."""
    w, m, v, b, mb, vb = np.zeros(dim, np.float32), np.zeros(dim), np.zeros(dim), 0.0, 0.0, 0.0
    use = np.ones(len(y)) if inside is None else inside.astype(float)
    share = float((y * use).sum() / use.sum())
    balance = use * np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / use.sum()
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], len(y)) + b
        err = ((sigmoid(z) - y) * balance).astype(np.float32)
        g, gb = np.bincount(cols, vals * err[rows], dim) + l2 * w, float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= (rate * fix * m / (np.sqrt(v) + 1e-9)).astype(np.float32)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 0.001, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a ridge-penalized logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * len(y) / 100 + 1e-6)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return w


def folds(n: int, k: int) -> np.ndarray:
    """A fold for each of ``n`` rows, the same each time."""
    return np.random.default_rng(7).permutation(n) % k


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (fitted on out-of-fold scores, targets drawn in as Platt does)."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(scores.std(), 1e-9)
    w = fit_dense((scores / scale)[:, None], target, l2=1e-3)
    return float(w[0] / scale), float(w[1])
