"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a quantile of all scores."""

from __future__ import annotations

from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, stored, tidy
from ._labels import held_out, training_sample

PUNCTUATION = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
N_FEATURES = len(PUNCTUATION) + 9


def features(text: str | None) -> np.ndarray:
    """What a text's form says: shares of characters and words, over the whole text.

    An empty text has zeros everywhere but for its flag.
    """
    x = np.zeros(N_FEATURES)
    data = (text or "").encode()
    words = data.split()
    if not words:
        x[-1] = 1
        return x
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, size = len(words), len(data)
    x[: len(PUNCTUATION)] = np.sqrt(seen[PUNCTUATION] / n)
    at = len(PUNCTUATION)
    lines = [line for line in data.split(b"\n") if line]
    x[at : at + 8] = (
        seen[0x41:0x5B].sum() / size,
        seen[0x30:0x3A].sum() / size,
        seen[0x61:0x7B].sum() / size,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        np.log(len(set(words))) / np.log(n) if n > 1 else 1.0,
        1 - len(set(lines)) / max(1, len(lines)),
        min(size / n, 40) / 40,
    )
    return x


@dataclass
class Ranking:
    """Strength ``(x - mean) / scale @ weights``; documents of strength under ``cut`` are rejected.

    ``quantile`` is the share of documents to reject that the labels tell, ``margin`` how far off that may be;
    ``cut`` is set by ``cut_at_quantile``, from the strengths of all documents.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float
    margin: float
    at_cut: float
    known: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # the sample's strengths, by class
    cut: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``at_cut`` at the cut, and the odds change with the strength as in the model."""
        z = self.strength(x) - self.cut + np.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranking(
    x: np.ndarray, y: np.ndarray, share: dict[int, int] | None = None, pairs: int = 40_000, at_cut: float = 0.3,
    penalty: float = 1e-3, steps: int = 300, seed: int = 7,
) -> Ranking:
    """Bradley-Terry: of a pair, the document of quality 1 is preferred with the logistic of the difference
    of strengths. Weights maximise the likelihood of ``pairs`` random preferences, by logistic loss on
    feature differences. ``share``: rows of each class where ``x`` was taken from. The quantile is the share of
    class 0 among these; four standard errors, and one document's worth, are its margin. Without one of the
    classes, every document gets the same strength.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = {0: len(bad), 1: len(good), **(share or {})}
    n = max(1, share[0] + share[1])
    quantile = share[0] / n
    margin = 4 * float(np.sqrt(quantile * (1 - quantile) / n)) + 1 / n
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(x.shape[1]), quantile, 0.0, at_cut)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance that the model has of the wrong order
        g = penalty * w - (p @ d) / pairs
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ranking(mean, scale, w, quantile, margin, at_cut, (z[bad] @ w, z[good] @ w))


LEVELS = 2000  # levels at which the quantiles of all strengths are looked at within the margin


def cut_at_quantile(model: Ranking, strengths: DataFrame) -> Ranking:
    """``model`` with its cut: a quantile of ``strengths(strength)``, those of all documents.

    The labels tell the level but for its margin. Of the levels within it, that one is taken whose strength parts the
    labelled sample best and, of several, the one before the widest gap to the next; the cut is in the middle of the gap.
    Quantiles are approximate to a hundredth of a per cent in rank, from one distributed pass.
    Without documents the cut is 0; without one of the classes, all documents are kept (no class 0) or
    rejected.
    """
    if not model.weights.any():
        return replace(model, cut=3.0 if model.quantile > 0 else -3.0)
    lo, hi = max(0.0, model.quantile - model.margin), min(1.0, model.quantile + model.margin)
    levels = np.linspace(lo, hi, LEVELS + 1)
    found = strengths.agg(F.percentile_approx("strength", [float(v) for v in levels], 10_000)).first()[0]
    if not found:
        return model
    s = np.array(found)
    cuts, gap = (s[:-1] + s[1:]) / 2, np.diff(s)
    bad, good = (np.searchsorted(np.sort(k), cuts) / len(k) for k in model.known)
    parted = np.round(bad - good, 9)
    return replace(model, cut=float(cuts[np.lexsort((gap, parted))[-1]]))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4000, at_cut: float = 0.3, **cols) -> Ranking:
    """Fit on at most ``per_class`` labelled documents of each class, none of them held out; the cut is still open."""
    sample, share = training_sample(docs, labels, "quality", per_class, **cols)
    x = np.array([features(t) for t, _ in sample]).reshape(len(sample), N_FEATURES)
    return fit_ranking(x, np.array([y for _, y in sample]), share or None, at_cut=at_cut)


def strengths(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, strength)``, a row a document."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.strength(x), pa.float64())], ["id", "strength"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, strength double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, per_class: int = 4000, at_cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: ``<id_col>, held_out, score, predicted``.

    ``score`` depends on the document's text, the model, and the cut in the strengths of all documents;
    ``predicted`` is 1 from ``at_cut`` on, that is from the cut on. Null text counts as empty, equal texts score
    alike, rows may repeat ids or have none. With an empty label table every document is kept, at one score; an
    empty table of documents gives none. Other columns are not read.
    """
    model = fit_quality(docs, labels, per_class, at_cut, id_col=id_col, text_col=text_col)
    found = stored(strengths(docs, model, id_col, text_col), "strengths")
    model = cut_at_quantile(model, found)
    z = F.col("strength") - F.lit(model.cut) + F.lit(float(np.log(at_cut / (1 - at_cut))))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    return found.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= at_cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, without the documents that the classifier rejects; two passes, no shuffle.

    Null text counts as empty and is judged like any other text, whole texts of any length by their form; equal
    texts, and so repeated rows and ties, stay or go together. With an empty label table all stay.
    """
    model = fit_quality(docs, labels, per_class, id_col=id_col, text_col=text_col)
    model = cut_at_quantile(model, strengths(docs, model, id_col, text_col))

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            yield b.filter(pa.array(model.strength(x) >= model.cut, pa.bool_()))

    return bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
