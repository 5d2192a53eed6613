"""Anomaly scores against normal examples: neighbours, Mahalanobis, isolation forest, one-class SVM, patches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running
from .search import top_k


def knn_scores(rows: DataFrame, normal: DataFrame, k: int, digits: int = 6, itself: bool = True) -> DataFrame:
    """``item_id, score``: mean of 1 - cosine to the ``k`` nearest of ``normal(item_id, vec)``.

    ``k`` is cut to the number of normals; no normals is an error. A normal scored against its own bank
    counts itself, unless ``itself`` is false.
    """
    if normal.isEmpty():
        raise ValueError("no normal examples")
    best = top_k(rows.select(F.col("item_id").alias("query_id"), "vec"), normal.select("item_id", "vec"), k, digits, exclude_self=not itself)
    return best.groupBy(F.col("query_id").alias("item_id")).agg(F.avg(1 - F.col("score")).alias("score"))


def percentile_in(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """``item_id, score, share``: the share of ``baseline(score)`` below each score.

    Running counts over the distinct scores of both, so nothing is paired.
    """
    both = baseline.groupBy("score").agg(F.count("*").alias("b")).unionByName(scores.select("score", F.lit(0).cast("long").alias("b")).distinct())
    both = both.groupBy("score").agg(F.sum("b").alias("b"))
    shares = running(both, "score", {"below": "b"}, inclusive=False).join(F.broadcast(both.agg(F.sum("b").alias("total"))))
    return scores.join(shares.select("score", (F.col("below") / F.col("total")).alias("share")), "score").select("item_id", "score", "share")


@dataclass
class Mahalanobis:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt((np.linalg.solve(self.factor, (x - self.mean).T) ** 2).sum(0))


def fit_mahalanobis(normal: DataFrame, shrinkage: float) -> Mahalanobis:
    """Sums of components and of their products come from the executors, one small matrix a task; the
    covariance (of the sample) is drawn towards a multiple of the identity. Fewer than two rows, or no
    variance, is an error."""

    def sums(batches):
        n, s, p = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), dtype=np.float64)
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    parts = normal.where("vec is not null").select("vec").mapInPandas(sums, "n long, s array<double>, p array<double>").collect()  # a row a task
    n = sum(r["n"] for r in parts)
    if n < 2:
        raise ValueError("need two normal examples or more")
    s = np.sum([r["s"] for r in parts], axis=0)
    p = np.sum([r["p"] for r in parts], axis=0).reshape(len(s), len(s))
    mean = s / n
    cov = (p - n * np.outer(mean, mean)) / (n - 1)
    spread = float(np.trace(cov) / len(s))
    if spread <= 0:
        raise ValueError("normal examples have no variance")
    return Mahalanobis(mean, np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * spread * np.eye(len(s))))


@dataclass
class IsolationForest:
    """Trees as arrays: ``feature`` (-1 at a leaf), ``cut``, ``left`` and ``right``, and each node's path length."""

    trees: list[tuple[np.ndarray, ...]]
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / expected path): towards 1 for what is cut off early."""
        depth = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                rows = np.flatnonzero(inner)
                at = node[rows]
                down = x[rows, feature[at]] < cut[at]
                node[rows] = np.where(down, left[at], right[at])
            depth += length[node]
        return 2.0 ** (-depth / len(self.trees) / max(_expected_path(self.sample), 1e-9))


def _expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` leaves."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_isolation_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> IsolationForest:
    """Liu, Ting and Zhou's forest: random cuts of random samples until each row is alone or deep enough."""
    if not len(x):
        raise ValueError("no normal examples")
    rng, size = np.random.default_rng(seed), min(sample, len(x))
    limit, forest = int(np.ceil(np.log2(max(2, size)))), []
    for _ in range(trees):
        nodes: list[list] = []
        todo = [(x[rng.choice(len(x), size, replace=False)], 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _expected_path(len(part))])
            if parent >= 0:
                nodes[parent][2 + side] = me
            lo, hi = part.min(0), part.max(0)
            able = np.flatnonzero(hi > lo)
            if depth >= limit or len(part) <= 1 or not len(able):
                continue
            f = int(rng.choice(able))
            c = float(rng.uniform(lo[f], hi[f]))
            nodes[me][:2] = [f, c]
            below = part[:, f] < c
            todo += [(part[below], depth + 1, me, 0), (part[~below], depth + 1, me, 1)]
        forest.append(tuple(np.array(col, dtype=t) for col, t in zip(zip(*nodes), (np.int64, float, np.int64, np.int64, float))))
    return IsolationForest(forest, size)


@dataclass
class OneClassSVM:
    support: np.ndarray
    weight: np.ndarray
    rho: float
    gamma: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Positive outside of the learnt region."""
        return self.rho - _rbf(x, self.support, self.gamma) @ self.weight


def _rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def fit_one_class_svm(x: np.ndarray, nu: float = 0.1, rounds: int = 20_000, tolerance: float = 1e-4) -> OneClassSVM:
    """Schoelkopf's dual, min a'Ka/2 with 0 <= a <= 1/(nu n) and sum 1, by pairs that violate it most.

    gamma is 1 / (width * variance).
    """
    if not len(x):
        raise ValueError("no normal examples")
    n, spread = len(x), float(x.var())
    gamma = 1.0 / (x.shape[1] * spread) if spread > 0 else 1.0
    k, top = _rbf(x, x, gamma), 1.0 / (nu * n)
    a, full = np.zeros(n), int(nu * n)
    a[:full] = top
    if full < n:
        a[full] = 1 - full * top
    g = k @ a
    for _ in range(rounds):
        up, down = np.where(a < top - 1e-12, g, np.inf), np.where(a > 1e-12, g, -np.inf)
        i, j = int(np.argmin(up)), int(np.argmax(down))
        if down[j] - up[i] < tolerance:
            break
        step = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += step * (k[:, i] - k[:, j])
    free = (a > 1e-9) & (a < top - 1e-9)
    rho = float(g[free].mean()) if free.any() else float((g[a > 1e-9].max() + g[a < top - 1e-9].min()) / 2) if (a < top - 1e-9).any() else float(g.mean())
    return OneClassSVM(x[a > 1e-12], a[a > 1e-12], rho, gamma)


def bounded_matrix(normal: DataFrame, bound: int) -> np.ndarray:
    """Up to ``bound`` vectors by id hash: what the two seeded models are fitted on."""
    rows = normal.where("vec is not null").orderBy(F.xxhash64("item_id"), "item_id").limit(bound).select("vec").toPandas()
    return np.array(rows["vec"].tolist(), dtype=np.float64)


def scored(rows: DataFrame, model) -> DataFrame:
    """``item_id, score`` by a fitted model, which every task gets."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"item_id": pdf["item_id"], "score": sent.value.score(np.array(pdf["vec"].tolist(), dtype=np.float64))})

    return rows.where("vec is not null").select("item_id", "vec").mapInPandas(run, "item_id long, score double")


def build_detector(method: str, normal: DataFrame, *, k: int = 5, shrinkage: float = 0.1, trees: int = 100, nu: float = 0.1, seed: int = 0, bound: int = 5000):
    """A function from rows to scores, fitted on ``normal``; an unknown method is an error."""
    if method == "knn":
        return lambda rows: knn_scores(rows, normal, k)
    if method == "mahalanobis":
        model = fit_mahalanobis(normal, shrinkage)
    elif method == "isolation_forest":
        model = fit_isolation_forest(bounded_matrix(normal, bound), trees, seed=seed)
    elif method == "ocsvm":
        model = fit_one_class_svm(bounded_matrix(normal, bound), nu)
    else:
        raise ValueError(f"unknown anomaly method {method!r}")
    return lambda rows: scored(rows, model)


def must_refit(now: int, fitted: int | None, least: int = 8, growth: float = 1.25) -> bool:
    """Whether a label's model is due: enough examples, and none yet or a quarter more than it has seen."""
    return now >= least and (fitted is None or now >= growth * fitted)


# Fixed values of the patch bank's policy: crops that it takes at most, the fewest it is fitted on, and how many more
# make a new fit due.
MOST_CROPS, LEAST_CROPS, MORE_CROPS = 40, 3, 8


def patch_bank(patches: DataFrame, crops: DataFrame) -> DataFrame:
    """``crop_id, gy, gx, vec`` of the crops that a bank takes: of ``crops(crop_id, identity_id)`` those of a bound object,
    the first ``MOST_CROPS`` by id."""
    bound = crops.where("identity_id is not null").select("crop_id").distinct().orderBy("crop_id").limit(MOST_CROPS)
    return patches.join(F.broadcast(bound), "crop_id", "left_semi")


def must_refit_bank(now: int, fitted: int | None) -> bool:
    """Whether a label's patch bank is due: enough crops, and none yet or ``MORE_CROPS`` more than it has seen."""
    return now >= LEAST_CROPS and (fitted is None or now >= fitted + MORE_CROPS)


class ModelCache:
    """A fitted model for each label, fitted anew only when ``must_refit`` says so.

    It holds the models themselves (functions from rows to scores, on the driver), so as many as there are labels.
    """

    def __init__(self, method: str, due=must_refit, **settings):
        self.method, self.due, self.settings = method, due, settings
        self.models: dict[str, tuple[int, object]] = {}

    def model(self, label: str, normal: DataFrame):
        """The label's model, or None while there are too few examples."""
        now = normal.count()
        fitted = self.models[label][0] if label in self.models else None
        if self.due(now, fitted):
            self.models[label] = (now, build_detector(self.method, normal, **self.settings))
        return self.models[label][1] if label in self.models else None


def patch_distances(patches: DataFrame, bank: DataFrame, digits: int = 6, budget: int = 4096, least: int = 64) -> DataFrame:
    """``crop_id, gy, gx, distance``: 1 - the best cosine of each patch to the bank of normal patches.

    The bank, sampled by hash down to ``budget``, is sent to the tasks as a matrix; fewer than ``least`` patches
    is an error.
    """
    have = bank.where("vec is not null").orderBy(F.xxhash64("item_id"), "item_id").limit(budget).select("vec").toPandas()
    if len(have) < least:
        raise ValueError(f"need {least} normal patches, got {len(have)}")
    sent = patches.sparkSession.sparkContext.broadcast(np.array(have["vec"].tolist(), dtype=np.float64))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                best = (np.array(pdf["vec"].tolist(), dtype=np.float64) @ sent.value.T).max(1)
                yield pdf[["crop_id", "gy", "gx"]].assign(distance=np.round(1 - best, digits))

    return patches.select("crop_id", "gy", "gx", "vec").mapInPandas(run, "crop_id long, gy int, gx int, distance double")


def patch_score(distances: DataFrame, side: int) -> DataFrame:
    """``crop_id, score``: the largest mean over a patch and those above, to the left and between.

    At the upper and left edge the grid is mirrored without repeating the edge.
    """
    mirror = lambda c: F.when(F.col(c) == 0, F.lit(min(1, side - 1))).otherwise(F.col(c) - 1)
    near = distances.select(
        "crop_id", "gy", "gx",
        F.explode(F.array(*[F.struct(y.cast("int").alias("y"), x.cast("int").alias("x")) for y in (F.col("gy"), mirror("gy")) for x in (F.col("gx"), mirror("gx"))])).alias("n"),
    )
    src = distances.select("crop_id", F.col("gy").alias("y"), F.col("gx").alias("x"), "distance")
    means = near.select("crop_id", "gy", "gx", "n.y", "n.x").join(src, ["crop_id", "y", "x"]).groupBy("crop_id", "gy", "gx").agg(F.avg("distance").alias("m"))
    return means.groupBy("crop_id").agg(F.max("m").alias("score"))
