"""Toxic spans by a linear-chain conditional random field; its marginals give document scores and offsets."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, tidy
from ._labels import held_out, training_sample

WORDS = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
BLOCK = 256  # tokens in a row of the blocked recursions
CACHE = 600_000  # words whose emission one Python worker remembers
CHUNK = 1 << 20  # tokens worked on at once, at document ends


def words_of(text: str | None) -> list[str]:
    """The words of a text, each in lower case; a few letters get longer by that, so those texts are cut first."""
    text = text or ""
    low = text.lower()
    return WORDS.findall(low) if len(low) == len(text) else [w.lower() for w in WORDS.findall(text)]


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; a word shorter than a beginning has none of that length."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


# -- labelled tokens -------------------------------------------------------------------------------------


def label_features(texts: list[list[str]], labels: list[int], least: int = 3, trust: float = 0.98) -> list[str]:
    """The features whose tokens are labelled toxic in toxic documents.

    Documents carry the labels, tokens don't. Greedily, the feature that explains most toxic documents not
    yet explained is taken, if, of the documents with it, at least ``trust`` are toxic, and if it is in so
    many (``least`` at least) that among all features less than one would be by chance. Equal texts count
    once. On ties the longer, then the alphabetically last.
    """
    toxic, clean = Counter(), Counter()
    seen: dict[tuple[int, int], int] = {}  # equal texts, by two hashes of their words
    for i, (words, y) in enumerate(zip(texts, labels)):
        seen.setdefault((hash(tuple(words)), 2 * len(words) + y), i)
    for i in seen.values():
        (toxic if labels[i] else clean).update({f for w in set(texts[i]) for f in word_features(w)})
    bad = [i for i in seen.values() if labels[i]]
    share = min(0.95, max(0.02, len(bad) / max(1, len(seen))))
    least = max(least, int(np.ceil(np.log(max(2, len(toxic))) / -np.log(share))))
    able = {f for f, n in toxic.items() if n >= least and n >= trust * (n + clean[f])}
    # a second look, which holds but the few features that may be taken
    docs = [{f for w in set(texts[i]) for f in word_features(w) if f in able} for i in bad]
    open_, chosen = Counter(f for d in docs for f in d), []
    holders: dict[str, list[int]] = {}
    for i, d in enumerate(docs):
        for f in d:
            holders.setdefault(f, []).append(i)
    explained = [False] * len(docs)
    while open_:
        best = max(open_, key=lambda f: (open_[f], -clean[f], len(f), f))
        if open_[best] < least:
            break
        chosen.append(best)
        for i in holders[best]:
            if not explained[i]:
                explained[i] = True
                open_.subtract(docs[i])
        open_ = Counter({f: n for f, n in open_.items() if n >= least})
    # of features that none of the documents needs any more, those as sure as the chosen ones
    sure = [f for f in able if clean[f] == 0 and toxic[f] >= max(least, 0.02 * len(docs))]
    return sorted({*chosen, *sure})


# -- the field -------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Two states, clean (0) and toxic (1). Emissions are scores of state 1 against 0."""

    weights: dict[str, float]
    bias: float
    start: np.ndarray  # 2: weight of each state at a document's first token
    step: np.ndarray  # 2 x 2: weight of each state after each
    calibration: np.ndarray  # of the document's score: bias, log1p(expected tokens), largest marginal

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))


def forward_backward(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray):
    """Exact marginals over many documents at once.

    ``emission``: score of state 1 a token, ``first``: whether a token is its document's first. The
    recursions are products of 2 x 2 matrices; a first token's matrix has equal rows, which cuts the
    documents apart. The tokens are laid out as rows of ``BLOCK``; each row's product is taken over all
    rows at once, the short chain of rows in order, and then all rows again from their own start.
    Returns the marginals of state 1 and, for the pair of tokens t - 1 and t, of the four state pairs.
    """
    n = len(emission)
    rows = max(1, -(-n // BLOCK))
    e = np.ones(rows * BLOCK)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    f = np.ones(rows * BLOCK, dtype=bool)
    f[:n] = first
    e, f = (np.ascontiguousarray(a.reshape(rows, BLOCK).T) for a in (e, f))
    a = np.exp(step)
    s = np.exp(start)
    m = np.empty((2, 2, BLOCK, rows))
    for i in range(2):
        m[i, 0] = np.where(f, s[0], a[i, 0])
        m[i, 1] = np.where(f, s[1], a[i, 1]) * e
    total = m.sum(axis=(0, 1))
    m /= total
    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(BLOCK):
        p00, p01 = p00 * m[0, 0, t] + p01 * m[1, 0, t], p00 * m[0, 1, t] + p01 * m[1, 1, t]
        p10, p11 = p10 * m[0, 0, t] + p11 * m[1, 0, t], p10 * m[0, 1, t] + p11 * m[1, 1, t]
        scale = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / scale, p01 / scale, p10 / scale, p11 / scale
    before, after = np.empty((2, rows)), np.empty((2, rows))
    u = (0.5, 0.5)
    for k in range(rows):
        before[:, k] = u
        x, y = u[0] * p00[k] + u[1] * p10[k], u[0] * p01[k] + u[1] * p11[k]
        u = (x / (x + y), y / (x + y))
    u = (0.5, 0.5)
    for k in range(rows - 1, -1, -1):
        after[:, k] = u
        x, y = p00[k] * u[0] + p01[k] * u[1], p10[k] * u[0] + p11[k] * u[1]
        u = (x / (x + y), y / (x + y))
    front = np.empty((2, BLOCK + 1, rows))
    x, y = front[:, 0] = before
    for t in range(BLOCK):
        x, y = x * m[0, 0, t] + y * m[1, 0, t], x * m[0, 1, t] + y * m[1, 1, t]
        scale = x + y
        x, y = x / scale, y / scale
        front[0, t + 1], front[1, t + 1] = x, y
    back = np.empty((2, BLOCK, rows))
    x, y = after
    for t in range(BLOCK - 1, -1, -1):
        back[0, t], back[1, t] = x, y
        x, y = m[0, 0, t] * x + m[0, 1, t] * y, m[1, 0, t] * x + m[1, 1, t] * y
        scale = x + y
        x, y = x / scale, y / scale
    one = front[1, 1:] * back[1]
    one = one / (one + front[0, 1:] * back[0])
    pairs = front[:, None, :-1] * m * back[None, :]
    pairs /= pairs.sum(axis=(0, 1))
    return one.T.reshape(-1)[:n], pairs.transpose(3, 2, 0, 1).reshape(-1, 2, 2)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    return forward_backward(emission, first, start, step)[0]


def _expected(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1, and the expected number of each step, in bounded space: some documents at a time."""
    one, pairs = np.empty(len(emission)), np.zeros((2, 2))
    starts = np.append(np.flatnonzero(first), len(emission))
    at = 0
    while at < len(emission):
        k = np.searchsorted(starts, at + CHUNK // 4, side="right") - 1
        end = int(starts[k]) if starts[k] > at else int(starts[np.searchsorted(starts, at, side="right")])
        o, p = forward_backward(emission[at:end], first[at:end], start, step)
        one[at:end] = o
        pairs += p[~first[at:end]].sum(0)
        at = end
    return one, pairs


def fit_field(
    texts: list[list[str]], labels: list[int], steps: int = 60, rate: float = 0.3, penalty: float = 1e-5
) -> Field:
    """Maximum likelihood of the labelled tokens, with an L2 penalty, by gradient (expected counts come
    from the marginals); then the document score is calibrated on the same documents. With no document,
    or one class only, every score is that of the calibration's prior."""
    y = np.array(labels, dtype=float)
    seeds = set(label_features(texts, labels))
    vocab = {w: i for i, w in enumerate(sorted({w for words in texts for w in words}))}
    names: dict[str, int] = {}
    owner, member = [], []
    marked = np.zeros(len(vocab), dtype=bool)
    for w, i in vocab.items():
        own = word_features(w)
        marked[i] = not seeds.isdisjoint(own)
        for f in own:
            owner.append(i)
            member.append(names.setdefault(f, len(names)))
    owner, member = np.array(owner, dtype=np.int64), np.array(member, dtype=np.int64)
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    ids = np.fromiter((vocab[w] for words in texts for w in words), dtype=np.int64, count=int(lengths.sum()))
    first = np.zeros(len(ids), dtype=bool)
    first[np.cumsum(lengths)[:-1][lengths[1:] > 0] if len(lengths) > 1 else []] = True
    if len(first):
        first[0] = True
    doc = np.repeat(np.arange(len(texts)), lengths)
    truth = marked[ids] & (y[doc] == 1) if len(ids) else np.zeros(0, bool)
    w, bias = np.zeros(len(names)), -3.0
    start, step = np.zeros(2), np.zeros((2, 2))
    if truth.any():
        starts = np.flatnonzero(first)
        seen = np.bincount(ids, weights=truth, minlength=len(vocab))
        prev = truth[:-1].astype(int) * 2 + truth[1:]
        inside = ~first[1:]
        step_seen = np.bincount(prev[inside], minlength=4).reshape(2, 2)
        start_seen = np.bincount(truth[starts].astype(int), minlength=2)
        n = len(ids)
        theta = np.concatenate([w, [bias], start, step.ravel()])
        mom, var = np.zeros_like(theta), np.zeros_like(theta)
        k = len(w)
        for t in range(1, steps + 1):
            w, bias, start, step = theta[:k], theta[k], theta[k + 1 : k + 3], theta[k + 3 :].reshape(2, 2)
            words = np.bincount(owner, weights=w[member], minlength=len(vocab)) + bias
            one, pair = _expected(words[ids], first, start, step)
            miss = np.bincount(ids, weights=one, minlength=len(vocab)) - seen
            g = np.concatenate(
                [
                    np.bincount(member, weights=miss[owner], minlength=k) + penalty * n * w * 0.01,
                    [miss.sum()],
                    np.bincount(np.zeros(len(starts), int), minlength=1) * 0 + np.array([(1 - one[starts]).sum() - start_seen[0], one[starts].sum() - start_seen[1]]),
                    (pair - step_seen).ravel(),
                ]
            ) / n
            mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
            theta = theta - rate * min(1, 3 * (1 - t / (steps + 1))) * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        w, bias, start, step = theta[:k], theta[k], theta[k + 1 : k + 3], theta[k + 3 :].reshape(2, 2)
        words = np.bincount(owner, weights=w[member], minlength=len(vocab)) + bias
        one = _expected(words[ids], first, start, step)[0]
    else:
        one = np.zeros(len(ids))
    x = document_features(one, lengths)
    keep = np.abs(w) > 1e-4
    named = np.array(list(names), dtype=object)
    return Field(
        dict(zip(named[keep].tolist(), w[keep].tolist())) if len(names) else {}, float(bias), start, step, _calibrate(x, y)
    )


def document_features(one: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row a document: 1, log1p of its expected number of toxic tokens, its largest marginal.

    A token counts by its marginal's fourth power, the chance that four looks all call it toxic: all are summed, but
    the faint marginals of a long text's many clean words don't add up.
    """
    x = np.zeros((len(lengths), 3))
    x[:, 0] = 1
    some = np.flatnonzero(lengths)
    if len(some):
        at = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        x[some, 1] = np.log1p(np.add.reduceat(one**4, at))
        x[some, 2] = np.maximum.reduceat(one, at)
    return x


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, lightly held back."""
    c = np.array([-2.0, 0.0, 0.0])
    if not len(y):
        return c
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (p - y) + penalty * c
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(3)
        c = c - np.clip(np.linalg.solve(h, g), -2, 2)
    return c


# -- scoring ---------------------------------------------------------------------------------------------


class Tagger(dict):
    """Word -> emission, and from there the marginals of whole texts."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        value = self.field.emission(word)
        if len(word) <= 48:
            self[word] = value
        return value

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """The marginals of each text's words."""
        out: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        for text in texts:
            if len(self) > CACHE:
                self.clear()
            words = words_of(text)
            waiting.append(np.fromiter(map(self.__getitem__, words), dtype=float, count=len(words)))
            if sum(map(len, waiting[-1:])) >= CHUNK or len(waiting) >= 512:
                out += self._flush(waiting)
                waiting = []
        return out + self._flush(waiting)

    def _flush(self, waiting: list[np.ndarray]) -> list[np.ndarray]:
        lengths = [len(w) for w in waiting]
        emission = np.concatenate(waiting) if waiting else np.zeros(0)
        if not len(emission):
            return [np.zeros(0)] * len(waiting)
        first = np.zeros(len(emission), dtype=bool)
        ends = np.cumsum(lengths)
        first[0] = True
        first[ends[:-1][ends[:-1] < len(emission)]] = True
        one = marginals(emission, first, self.field.start, self.field.step)
        return np.split(one, ends[:-1])

    def scores(self, tagged: list[np.ndarray]) -> np.ndarray:
        x = document_features(np.concatenate(tagged) if tagged else np.zeros(0), np.array([len(t) for t in tagged], dtype=np.int64))
        return 1 / (1 + np.exp(-np.clip(x @ self.field.calibration, -40, 40)))

    @staticmethod
    def spans(text: str, one: np.ndarray, level: float = 0.5) -> list[tuple[int, int]]:
        """Offsets in characters of maximal runs of words whose marginal reaches ``level``."""
        out: list[tuple[int, int]] = []
        if not (one >= level).any():
            return out
        last = -2
        low = text.lower()
        for i, (m, p) in enumerate(zip(WORDS.finditer(low if len(low) == len(text) else text), one)):
            if p >= level:
                if last == i - 1:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
                last = i
        return out


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 24
) -> Field:
    """Fit on at most ``per_class`` labelled documents and ``most_bytes`` of text of each class, none of them held out."""
    sample, _ = training_sample(docs, labels, "toxic", per_class, id_col, text_col, most_bytes)
    return fit_field([words_of(t) for t, _ in sample], [y for _, y in sample])


def toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: ``<id_col>, held_out, score, predicted, n_toxic_tokens, spans``.

    ``score`` is calibrated from the marginals of all words of the text; ``predicted`` is 1 from 0.5 on.
    ``spans`` holds the character offsets of the runs of words tagged toxic. Null text counts as empty,
    which has the score of a text without any toxic word. Rows may repeat ids or have none, equal texts score
    alike; an empty table gives none. Other columns are neither read nor returned.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, per_class, id_col, text_col))

    def run(batches):
        tagger = Tagger(field.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            tagged = tagger.tag(texts)
            spans = [[{"begin": a, "end": e} for a, e in tagger.spans(t or "", one)] for t, one in zip(texts, tagged)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(tagger.scores(tagged), pa.float64()),
                    pa.array([int((t >= 0.5).sum()) for t in tagged], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                ["id", "score", "n_toxic_tokens", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(tidy(run), f"id {kind}, score double, n_toxic_tokens long, spans array<struct<begin:int,end:int>>")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "spans",
    )
