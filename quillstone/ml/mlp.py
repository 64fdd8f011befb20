"""The scoring head: a small perceptron with input scaling, trained in numpy on
the driver, applied in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DROPOUT, HIDDEN, TRAINING


@dataclass
class Head:
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    class_names: list[str]
    representation: str = ""
    history: list[dict] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = (np.asarray(x, np.float64) - self.mean) / self.std
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            h = h @ w + b
            if k < len(self.weights) - 1:
                h = np.maximum(h, 0)
        return h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def to_json(self) -> str:
        arrays = {"weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases], "mean": self.mean.tolist(), "std": self.std.tolist()}
        return json.dumps(arrays | {"class_names": self.class_names, "representation": self.representation, "history": self.history})

    @staticmethod
    def from_json(text: str, representation: str | None = None, class_names: Sequence[str] | None = None) -> Head:
        """Refuses a head of another representation or other classes."""
        d = json.loads(text)
        if representation is not None and d["representation"] != representation:
            raise ValueError(f"the model reads {d['representation']!r}, not {representation!r}")
        if class_names is not None and d["class_names"] != list(class_names):
            raise ValueError(f"the model's classes are {d['class_names']}, not {list(class_names)}")
        return Head([np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]], np.array(d["mean"]), np.array(d["std"]), d["class_names"], d["representation"], d["history"])


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    """Over the labels that occur."""
    scores = []
    for label in np.unique(np.concatenate([y, p])):
        tp, wrong = ((y == label) & (p == label)).sum(), ((y == label) ^ (p == label)).sum()
        scores.append(2 * tp / (2 * tp + wrong))
    return float(np.mean(scores)) if scores else 0.0


def train(x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray, class_names: Sequence[str], hidden: Sequence[int] = tuple(HIDDEN), dropout: float = DROPOUT, class_weights: np.ndarray | None = None, representation: str = "", **options) -> Head:
    """Adam on cross entropy; the rate falls when macro F1 has not risen for a
    while; stops early; returns the best epoch."""
    o = TRAINING | options
    rng = np.random.default_rng(o["seed"])
    sizes = [x.shape[1], *hidden, len(class_names)]
    ws = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
    bs = [np.zeros(b) for b in sizes[1:]]
    std = np.maximum(x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1]), 1e-6)
    head = Head(ws, bs, x.mean(axis=0), std, list(class_names), representation)
    params = [*ws, *bs]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z = (x - head.mean) / head.std
    lr, t, best, since, since_lr, kept = o["lr"], 0, -1.0, 0, 0, None
    weight = np.ones(len(class_names)) if class_weights is None else np.asarray(class_weights, float)
    for epoch in range(1, o["epochs"] + 1):
        losses = []
        order = rng.permutation(len(z))
        for at in range(0, len(order), o["batch_size"]):
            rows = order[at : at + o["batch_size"]]
            acts, masks = [z[rows]], []
            for k in range(len(ws)):
                h = acts[-1] @ ws[k] + bs[k]
                if k < len(ws) - 1:
                    mask = (h > 0) * (rng.random(h.shape) >= dropout) / (1 - dropout)
                    masks.append(mask)
                    h = h * mask
                acts.append(h)
            e = np.exp(acts[-1] - acts[-1].max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            own = weight[y[rows]] / weight[y[rows]].sum()
            losses.append(float(-(own * np.log(np.maximum(p[np.arange(len(rows)), y[rows]], 1e-12))).sum()))
            d = p.copy()
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= own[:, None]
            grads: list[np.ndarray] = [None] * len(params)
            for k in range(len(ws) - 1, -1, -1):
                grads[k], grads[len(ws) + k] = acts[k].T @ d, d.sum(axis=0)
                if k:
                    d = (d @ ws[k].T) * masks[k - 1]
            t += 1
            for i, g in enumerate(grads):
                g = g + o["weight_decay"] * params[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        score = macro_f1(y_val, head.logits(x_val).argmax(axis=1))
        head.history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), "val_macro_f1": score, "lr": lr})
        if score > best:
            best, since, since_lr, kept = score, 0, 0, [p.copy() for p in params]
            continue
        since, since_lr = since + 1, since_lr + 1
        if since_lr > o["lr_patience"]:
            lr, since_lr = max(lr * o["lr_factor"], o["min_lr"]), 0
        if since >= o["patience"]:
            break
    for p, k in zip(params, kept, strict=True):
        p[...] = k
    return head


def score(rows: DataFrame, head: Head, column: str = "embedding") -> DataFrame:
    """rows with p_<class> columns."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(shared.value.probabilities(np.stack(vectors.to_numpy()))))

    out = rows.withColumn("__p", apply(F.col(column)))
    return out.withColumns({"p_" + n: F.element_at("__p", i + 1) for i, n in enumerate(head.class_names)}).drop("__p")
