"""Toxicity by a linear-chain conditional random field over words: spans, and their marginals summed up per document."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesalith.llm import labelled
from mesalith.llm._common import fold

#: Labelled documents that are learned from, at most about.
SAMPLE_DOCS = 6000
#: Feature weights (hashed).
BUCKETS = 1 << 18
SEGMENT = 48
WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 200_000
#: Rows that are tagged at once.
PART = 4000


def features(word: str) -> list[int]:
    import xxhash

    w = word.lower()
    names = ["w=" + w, *(f"p{k}=" + w[:k] for k in (3, 4, 5, 6)), "s3=" + w[-3:]]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in names]


def token_labels(texts: list[str], ys: list[int]) -> set[str]:
    """Words and word starts ("^abcd") that mark toxic documents.

    Two in five documents that have one are toxic, three times the usual share at least, and so are at least three and
    1.5 % of the toxic ones; and chance would not be expected to make even one of all the words and starts look so
    (log likelihood ratio).
    """

    def seen(wanted, only=None):
        found = Counter()
        for t, y in zip(texts, ys, strict=True):
            if y == wanted:
                words = {w.lower() for w in WORD.findall(t)}
                marks = words | {"^" + w[:k] for w in words for k in (3, 4, 5, 6) if len(w) > k}
                found.update(marks if only is None else marks & only)
        return found

    toxic, n, share = seen(1), sum(ys), sum(ys) / max(1, len(ys))
    least = np.log(len(toxic) + 1) + 1
    toxic = {f: c for f, c in toxic.items() if c >= max(3, 0.015 * n)}
    clean = seen(0, toxic.keys())

    def surprise(a, b):
        rate = a / (a + b)
        return a * np.log(rate / share) + (b * np.log((1 - rate) / (1 - share)) if b else 0)

    return {f for f, c in toxic.items() if c / (c + clean[f]) >= max(0.4, min(0.9, 3 * share)) and surprise(c, clean[f]) >= least}


def _is_marked(word: str, marks: set[str]) -> bool:
    w = word.lower()
    return w in marks or any("^" + w[:k] in marks for k in (3, 4, 5, 6) if len(w) > k)


class Crf:
    """Two states; `weights` are of state 1 against 0, `trans` log transitions, `start` the log odds of the first state."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.trans = np.zeros((2, 2))
        self.start = 0.0
        self.calibration = np.array([-3.0, 0.0, 0.0, 0.0])

    def emission(self, word: str) -> float:
        return min(30.0, max(-30.0, sum(map(memoryview(self.weights).__getitem__, features(word)))))

    def marginals(self, s: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """P(state 1) by forward-backward over rows of emissions, padded at the right; by odds, as there are two states."""
        a = np.exp(self.trans)
        e = np.exp(s).T
        steps, n = e.shape
        live = mask.T
        fwd = np.empty((steps, n))
        r = np.exp(self.start) * e[0]
        fwd[0] = r
        for t in range(1, steps):
            r = e[t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
            fwd[t] = r
        b = np.ones(n)
        for t in range(steps - 1, -1, -1):
            fwd[t] *= b
            x = e[t] * b
            b = np.where(live[t], (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x), 1.0)
        return (fwd / (1 + fwd)).T * mask

    def fit(self, segments: list[tuple[list[list[int]], list[int]]], epochs: int = 5, batch: int = 256, rate: float = 0.3, decay: float = 1e-6, seed: int = 0) -> None:
        """Maximum conditional likelihood by AdaGrad. Segments: features and label of each word."""
        rng, g2, gt2, gs2 = np.random.default_rng(seed), np.full(BUCKETS, 1e-4), np.full((2, 2), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(segments))
            for at in range(0, len(order), batch):
                part = [segments[i] for i in order[at: at + batch]]
                steps = max(len(y) for _, y in part)
                mask = np.array([[t < len(y) for t in range(steps)] for _, y in part])
                y = np.array([[*y, *[0] * (steps - len(y))] for _, y in part])
                feats = np.array([[*f, *[[0] * 6] * (steps - len(f))] for f, _ in part])
                s = np.where(mask, np.clip(self.weights[feats].sum(-1), -30, 30), 0.0)
                one, pairs = self._pairs(s, mask)
                grad = np.bincount(feats[mask].ravel(), np.repeat((y - one)[mask], 6), BUCKETS) / len(part) - decay * self.weights
                both = mask[:, 1:]
                seen = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
                gt, gs = (seen - pairs) / len(part), float((y[:, 0] - one[:, 0]).mean())
                g2 += grad**2
                gt2 += gt**2
                gs2 += gs**2
                self.weights += rate * grad / np.sqrt(g2)
                self.trans += 0.1 * gt / np.sqrt(gt2)
                self.start += 0.1 * gs / gs2**0.5

    def _pairs(self, s, mask):
        """Marginals of single words, and expected counts of neighbouring states."""
        n, steps = s.shape
        a = np.exp(self.trans)
        e = np.stack([np.ones_like(s), np.exp(s)], -1)
        fwd, bwd = np.empty((steps, n, 2)), np.ones((steps, n, 2))
        f = e[:, 0] * np.array([1.0, np.exp(self.start)])
        fwd[0] = f / f.sum(1, keepdims=True)
        for t in range(1, steps):
            f = fwd[t - 1] @ a * e[:, t]
            fwd[t] = f / f.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            b = (bwd[t + 1] * e[:, t + 1]) @ a.T
            b /= b.sum(1, keepdims=True)
            bwd[t] = np.where(mask[:, t + 1, None], b, 1.0)
        both = fwd * bwd
        one = (both[..., 1] / both.sum(-1)).T * mask
        pairs = np.zeros((2, 2))
        for t in range(steps - 1):
            p = fwd[t][:, :, None] * a * (e[:, t + 1] * bwd[t + 1])[:, None, :]
            pairs += (p / p.sum((1, 2), keepdims=True))[mask[:, t + 1]].sum(0)
        return one, pairs

    def tag(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of each row of emissions; rows of like length share a padded block of bounded size."""
        out: list = [np.zeros(0)] * len(rows)
        order, at = sorted(range(len(rows)), key=lambda i: len(rows[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and (end + 1 - at) * len(rows[order[end]]) <= 1_000_000:
                end += 1
            part = order[at:end]
            steps = len(rows[part[-1]])
            if steps:
                s, mask = np.zeros((len(part), steps)), np.zeros((len(part), steps), bool)
                for k, i in enumerate(part):
                    s[k, : len(rows[i])], mask[k, : len(rows[i])] = rows[i], True
                for k, (i, p) in enumerate(zip(part, self.marginals(s, mask), strict=True)):
                    out[part[k]] = p[: len(rows[i])]
            at = end
        return out

    @staticmethod
    def summary(p: np.ndarray) -> tuple[float, float, float]:
        """What of a document's marginals its score is made from: the largest (log odds), the sum, the share (logs)."""
        if not len(p):
            return (-12.0, -12.0, -12.0)
        top, total = float(np.clip(p.max(), 1e-6, 1 - 1e-6)), float(p.sum())
        return float(np.log(top / (1 - top))), float(np.log(total + 6e-6)), float(np.log(total / len(p) + 6e-6))

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.calibration @ np.array([1.0, *self.summary(p)]), -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Newton steps, halved until the penalised log loss falls; x with a column of ones first, which isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + w @ keep @ w / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before, now = w + step, now, min(now, after)
        if before - now < 1e-8:
            break
    return w


def train(texts: list[str], ys: list[int], seed: int = 0) -> Crf:
    """Fit the field on words labelled by token_labels, then the document score. Without both classes, scores are about the share of label 1."""
    model = Crf()
    n, pos = len(ys), sum(ys)
    if pos == 0 or pos == n:
        rate = (pos + 0.5) / (n + 1)
        model.calibration = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
        return model
    own, own_y = labelled.distinct_texts(texts, ys)
    marks, rng, cache, segments = token_labels(own, own_y), np.random.default_rng(seed), {}, []
    for t, y in zip(own, own_y, strict=True):
        words = WORD.findall(t)
        if not words:
            continue
        tags = [int(y and _is_marked(w, marks)) for w in words]
        at: list[int] = []  # every tagged word is in a segment
        for i, g in enumerate(tags):
            if g and (not at or i >= at[-1] + SEGMENT):
                at.append(max(0, i - SEGMENT // 2))
        at += [int(i) for i in rng.integers(0, max(1, len(words) - SEGMENT + 1), 2)]
        if y and not any(tags):
            continue  # toxic, but no word is known to be why: its words have no labels, though its score is fitted like all others
        for i in sorted(set(at)):
            part = words[i: i + SEGMENT]
            for w in part:
                if w not in cache:
                    cache[w] = features(w)
            segments.append(([cache[w] for w in part], tags[i: i + SEGMENT]))
    if segments:
        model.fit(segments, seed=seed)
    known: dict[str, float] = {}
    rows = [np.array([known[w] if w in known else known.setdefault(w, model.emission(w)) for w in WORD.findall(t)]) for t in own]
    x = np.array([[1.0, *model.summary(p)] for p in model.tag(rows)])
    model.calibration = fit_logistic(x, np.array(own_y))
    return model


def _parts(batches):
    """PART rows at a time; of their words only the emissions are kept."""
    for b in batches:
        for at in range(0, b.num_rows, PART):
            yield b.slice(at, PART)


_NAMES = ["id", "held_out", "score", "predicted", "toxic_spans", "n_spans"]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 3, left_out: int = 1, threshold: float = 0.7, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: id, held_out, score, predicted, toxic_spans ("start:end,..." in code points), n_spans.

    The field is fitted on a bounded sample of labelled rows outside the fold left_out and sent to the executors (two
    megabytes, whatever the corpus). Every whole text is scored; nothing is shuffled. Null and empty texts, and texts
    without letters, get the score of a document without a toxic word. Rows may repeat; a row with a null id is held
    out. Other columns are not read.
    """
    texts, ys = labelled.sample(docs, labels, label, folds, left_out, sample_docs, id_col, text_col)
    return score_toxicity(docs, train(texts, ys), id_col, text_col, folds, left_out, threshold)


def score_toxicity(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, left_out: int = 1, threshold: float = 0.7) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.trans, model.start, model.calibration))

    def run(batches):
        own = Crf()
        own.weights, own.trans, own.start, own.calibration = sent.value
        known: dict[str, float] = {}

        def emission(w):
            v = known.get(w)
            if v is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                v = known[w] = own.emission(w)
            return v

        for b in _parts(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            tagged = own.tag([np.fromiter(map(emission, WORD.findall(t)), float) for t in texts])
            spans, n = [], []
            for t, p in zip(texts, tagged, strict=True):
                mine: list[list[int]] = []
                if len(p) and p.max() >= 0.5:
                    last = -2
                    for k, m in enumerate(WORD.finditer(t)):
                        if p[k] >= 0.5:
                            if k == last + 1:
                                mine[-1][1] = m.end()
                            else:
                                mine.append([m.start(), m.end()])
                            last = k
                spans.append(",".join(f"{i}:{j}" for i, j in mine))
                n.append(len(mine))
            score = [own.score(p) for p in tagged]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(spans, pa.string()), pa.array(n, pa.int32())], names=_NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col, folds) == left_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int, toxic_spans string, n_spans int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Crf, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents (all columns) that score below the threshold; row by row, so ids don't matter. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.trans, model.start, model.calibration))
    at = docs.columns.index(text_col)

    def run(batches):
        own = Crf()
        own.weights, own.trans, own.start, own.calibration = sent.value
        known: dict[str, float] = {}
        for b in _parts(batches):
            rows = []
            for t in b.column(at).to_pylist():
                words = WORD.findall(t or "")
                if len(known) > WORDS_KEPT:
                    known.clear()
                rows.append(np.array([known[w] if w in known else known.setdefault(w, own.emission(w)) for w in words], float))
            yield b.filter(pa.array([own.score(p) < threshold for p in own.tag(rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
