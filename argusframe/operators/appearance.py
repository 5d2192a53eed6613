"""Describing crops: colour bands, linear projection, routed embedders, and pair verifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = np.array([8, 8, 4])  # fixed: of hue, saturation, value
RANGE = np.array([180.0, 256.0, 256.0])  # fixed: what these lie under


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """Bytes B, G, R -> hue 0 to 179, saturation and value 0 to 255."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    h = np.where(d == 0, 0, np.where(h < 0, h + 180, h))
    s = np.where(v == 0, 0, 255 * d / np.where(v == 0, 1, v))
    return np.stack([np.minimum(np.round(h), 179), np.round(s), v], axis=-1)


def band_histograms(bgr: np.ndarray, bands: int) -> np.ndarray:
    """Colour histograms of ``bands`` horizontal bands of a crop, one after the other, as one unit vector.

    Each pixel row is counted once; a band is the difference of two running sums over the rows, at the nearest whole
    rows to its ends. A band without rows takes the whole crop; an empty crop is an error.
    """
    height, width = bgr.shape[:2]
    if not height or not width:
        raise ValueError("empty crop")
    h, s, v = np.moveaxis(np.minimum((to_hsv(bgr) * (CELLS / RANGE)).astype(np.int64), CELLS - 1), -1, 0)
    cell = np.ravel_multi_index((h, s, v), tuple(CELLS)) + np.arange(height)[:, None] * CELLS.prod()
    rows = np.bincount(cell.ravel(), minlength=height * CELLS.prod()).reshape(height, -1)
    upto = np.vstack([np.zeros(rows.shape[1], dtype=np.int64), rows.cumsum(0)])
    ends = np.round(height * np.arange(bands + 1) / bands).astype(np.int64)
    counts = np.where((np.diff(ends) > 0)[:, None], np.diff(upto[ends], axis=0), upto[-1]).ravel().astype(float)
    return counts / np.sqrt((counts * counts).sum())


Embedder = Callable[[list[np.ndarray]], np.ndarray]  # crops of bytes B, G, R -> a row each


def build_embedder(kind: str, *, bands: int = 3, weights: np.ndarray | None = None) -> Embedder:
    """A describer of crops by name: ``colour`` (histograms of bands) or ``projected`` (those, times ``weights``). An unknown name
    is an error."""
    if kind not in ("colour", "projected"):
        raise ValueError(f"unknown embedder {kind!r}")
    if kind == "projected" and weights is None:
        raise ValueError("a projection needs weights")

    def embed(crops: list[np.ndarray]) -> np.ndarray:
        found = np.stack([band_histograms(c, bands) for c in crops])
        return found if kind == "colour" else found @ np.asarray(weights, dtype=np.float64)

    return embed


def build_describer(kind: str, **settings) -> Callable[[DataFrame], DataFrame]:
    """``describe`` with an embedder by name: ``crops(item_id, height, width, data)`` -> ``item_id, vec``."""
    embedder = build_embedder(kind, **settings)
    return lambda crops: describe(crops, embedder)


def describe(crops: DataFrame, embedder: Callable[[list[np.ndarray]], np.ndarray], batch: int = 16) -> DataFrame:
    """``crops(item_id, height, width, data)`` of BGR bytes -> ``item_id, vec``, unit vectors.

    ``embedder`` gets up to ``batch`` crops at a time; load a model in it lazily, once a worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                images = [np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, 3) for r in part.itertuples()]
                v = np.asarray(embedder(images), dtype=np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"item_id": part["item_id"].to_numpy(), "vec": v.tolist()})

    return crops.select("item_id", "height", "width", "data").mapInPandas(run, "item_id long, vec array<double>")


def worth_encoding(detections: DataFrame, least_score: float) -> DataFrame:
    """The gate before the encoder: a filter below the Python function, on plain columns."""
    return detections.where(F.col("score") >= least_score)


def project(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``item_id, vec``: vectors times ``weights``, of unit norm again; a wrong width is an error."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            if x.shape[1] != sent.value.shape[0]:
                raise ValueError(f"expected {sent.value.shape[0]} components, got {x.shape[1]}")
            z = x @ sent.value
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy(), "vec": z.tolist()})

    return rows.where("vec is not null").select("item_id", "vec").mapInPandas(run, "item_id long, vec array<double>")


def pca_weights(rows: DataFrame, width: int) -> np.ndarray:
    """Principal directions, from the executors' sums of products: a projection to start from."""
    from .anomaly import fit_mahalanobis

    m = fit_mahalanobis(rows, 0.0)
    cov = m.factor @ m.factor.T
    return np.linalg.eigh(cov)[1][:, ::-1][:, :width]


@dataclass
class LogisticVerifier:
    """Same or not, from the nine pair features; the boundary is at 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, penalty: float = 1.0) -> LogisticVerifier:
    """Standardised features, L2 penalty, Newton steps; both classes are needed."""
    if len(set(y.tolist())) < 2:
        raise ValueError("need both same and different pairs")
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.diag([penalty] * (z.shape[1] - 1) + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) + keep @ w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), g)
        if np.abs(g).max() < 1e-8:
            break
    return LogisticVerifier(mean, scale, w[:-1], float(w[-1]))


@dataclass
class PairNetwork:
    """A small rectified network on ``[a * b, |a - b|, a . b]``; trained by Adam on the logistic loss."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    threshold: float = 0.5

    @staticmethod
    def inputs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.hstack([a * b, np.abs(a - b), (a * b).sum(1, keepdims=True)])

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            out.append(np.maximum(x, 0) if i < len(self.layers) - 1 else x)
        return out

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self.inputs(a, b))[-1][:, 0], -40, 40)))


def fit_pair_network(a: np.ndarray, b: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (32,), steps: int = 300, rate: float = 1e-2, decay: float = 1e-3, seed: int = 0) -> PairNetwork:
    """Classes are weighted to count the same."""
    x, rng = PairNetwork.inputs(a, b), np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, 1]
    net = PairNetwork([(rng.normal(size=(m, n)) * np.sqrt(2 / m), np.zeros(n)) for m, n in zip(sizes, sizes[1:])])
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum())) / len(y)
    mom = [[np.zeros_like(p) for p in layer] for layer in net.layers]
    var = [[np.zeros_like(p) for p in layer] for layer in net.layers]
    for t in range(1, steps + 1):
        acts = net._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(acts[-1][:, 0], -40, 40))) - y) * weight)[:, None]
        for i in range(len(net.layers) - 1, -1, -1):
            w, bias = net.layers[i]
            grads = (acts[i].T @ d + decay * w, d.sum(0))
            if i:
                d = (d @ w.T) * (acts[i] > 0)
            new = []
            for k, (p, g) in enumerate(zip((w, bias), grads)):
                mom[i][k] = 0.9 * mom[i][k] + 0.1 * g
                var[i][k] = 0.999 * var[i][k] + 0.001 * g * g
                new.append(p - rate * (mom[i][k] / (1 - 0.9**t)) / (np.sqrt(var[i][k] / (1 - 0.999**t)) + 1e-8))
            net.layers[i] = (new[0], new[1])
    return net


def build_verifier(kind: str):
    """The fitting function of a verifier by name; cosine needs none. An unknown name is an error."""
    makers = {"cosine": None, "logistic": fit_logistic, "mlp": fit_pair_network}
    if kind not in makers:
        raise ValueError(f"unknown verifier {kind!r}")
    return makers[kind]


def largest_blob(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected part of a mask, the first in reading order on ties."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        pad = np.pad(np.where(mask, labels, big), 1, constant_values=big)
        near = np.min([pad[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, near, 0)
        if (new == labels).all():
            break
        labels = new
    if not mask.any():
        return mask.copy()
    ids, sizes = np.unique(labels[mask], return_counts=True)
    return labels == ids[np.argmax(sizes)]
