"""Quality classifier: a convolutional network over the bytes of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesalith.llm import labelled
from mesalith.llm._common import fold

#: Labelled documents that are learned from, at most about; and the blocks of each that a training step sees: a run that starts
#: anywhere in the text, so that over the steps every block is drawn. The calibration that follows sees all blocks.
SAMPLE_DOCS = 4000
TRAIN_BLOCKS = 20
#: Share of the texts of a training step that are cut to a short piece, as few documents are short.
SHORT_SHARE = 0.2
#: Bytes of a stride; a filter sees two strides. Strides of a block; a chunk is two neighbouring blocks, so chunks overlap by half.
STRIDE, BLOCK = 4, 32
DIM, FILTERS, HIDDEN = 6, 24, 12
BLOCK_BYTES = STRIDE * BLOCK
#: Blocks that go through the filters at once.
AT_ONCE = 4096
PAD = 256


class ByteCnn:
    """Byte embedding, filters over windows of eight bytes with a step of four, maximum over each chunk, a hidden layer, a logit per chunk; the logits of all chunks make one probability."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (PAD + 1, DIM)), "w": rng.normal(0, (1 / (2 * STRIDE * DIM)) ** 0.5, (2 * STRIDE * DIM, FILTERS)), "b": np.zeros(FILTERS),
            "u": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "c": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }
        self.p["e"][PAD] = 0
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.calibration = np.array([0.0, 1.0, 0.0, 0.0])

    def arrays(self):
        return self.p, self.calibration

    def _windows(self, codes: np.ndarray):
        """codes: blocks x BLOCK_BYTES, each followed by the next block's first stride: strides and the filters' outputs."""
        x = self.p["e"][codes].reshape(len(codes), BLOCK + 1, STRIDE * DIM)
        half = STRIDE * DIM
        flat = np.ascontiguousarray(x[:, :-1]).reshape(-1, half), np.ascontiguousarray(x[:, 1:]).reshape(-1, half)
        z = flat[0] @ self.p["w"][:half] + flat[1] @ self.p["w"][half:] + self.p["b"]
        return flat, z.reshape(len(codes), BLOCK, FILTERS)

    def block_maxima(self, codes: np.ndarray) -> np.ndarray:
        """Largest output of each filter (0 at least) in each block. Windows of padding alone don't count."""
        _, z = self._windows(codes)
        real = (codes[:, : BLOCK_BYTES : STRIDE] != PAD)[:, :, None]
        return np.maximum(np.where(real, z, 0).max(1), 0)

    def chunk_logits(self, maxima: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the chunks of documents whose blocks lie one after another, and the number of chunks of each."""
        n = np.maximum(counts - 1, 1)
        left = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        right = np.minimum(left + 1, np.repeat(firsts + counts - 1, n))
        h = np.maximum(maxima[left], maxima[right])
        return np.maximum(h @ self.p["u"] + self.p["c"], 0) @ self.p["v"] + self.p["d"], n

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        """Mean, largest and smallest chunk logit of each whole text; an empty text has one chunk of padding."""
        counts = np.array([max(1, -(-len(t) // BLOCK_BYTES)) for t in texts])
        maxima, held, size = [], [], 0
        for t, k in zip(texts, counts, strict=True):
            for at in range(0, int(k), AT_ONCE):  # a long text goes in parts; each block brings the stride after it
                held.append(blocks_of(t, at, min(int(k), at + AT_ONCE)))
                size += len(held[-1])
                if size >= AT_ONCE:
                    maxima.append(self.block_maxima(np.concatenate(held)))
                    held, size = [], 0
        if held:
            maxima.append(self.block_maxima(np.concatenate(held)))
        if not maxima:
            return np.zeros((0, 3))
        firsts = np.cumsum(counts) - counts
        logits, n = self.chunk_logits(np.concatenate(maxima), firsts, counts)
        starts = np.cumsum(n) - n
        return np.stack([np.add.reduceat(logits, starts) / n, np.maximum.reduceat(logits, starts), np.minimum.reduceat(logits, starts)], 1).astype(float)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = self.summaries(texts)
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + x @ self.calibration[1:], -30, 30)))

    def step(self, codes, counts, y, state, rate):
        """One Adam step on the mean log loss of documents, the document's logit being the mean of its chunks' logits."""
        p, half = self.p, STRIDE * DIM
        (x0, x1), z = self._windows(codes)
        z = np.where((codes[:, : BLOCK_BYTES : STRIDE] != PAD)[:, :, None], z, 0)
        best = z.argmax(1)
        maxima = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0], 0)
        firsts = np.cumsum(counts) - counts
        n = np.maximum(counts - 1, 1)
        left = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        right = np.minimum(left + 1, np.repeat(firsts + counts - 1, n))
        take_left = maxima[left] >= maxima[right]
        h = np.maximum(maxima[left], maxima[right])
        a = np.maximum(h @ p["u"] + p["c"], 0)
        logits = a @ p["v"] + p["d"]
        doc = np.repeat(np.arange(len(n)), n)
        prob = 1 / (1 + np.exp(-np.clip(np.bincount(doc, logits) / n, -30, 30)))
        dl = ((prob - y) / n / len(y)).astype(np.float32)[doc]
        da = dl[:, None] * p["v"] * (a > 0)
        dh = da @ p["u"].T
        dm = np.zeros_like(maxima)
        np.add.at(dm, left, dh * take_left)
        np.add.at(dm, right, dh * ~take_left)
        dz = np.zeros_like(z)
        np.put_along_axis(dz, best[:, None], (dm * (maxima > 0))[:, None], 1)
        dz = dz.reshape(-1, FILTERS)
        dx = np.zeros((len(codes), BLOCK + 1, half), np.float32)
        dx[:, :-1] += (dz @ p["w"][:half].T).reshape(len(codes), BLOCK, half)
        dx[:, 1:] += (dz @ p["w"][half:].T).reshape(len(codes), BLOCK, half)
        flat, de = codes.ravel(), dx.reshape(-1, DIM)
        grads = {
            "e": np.stack([np.bincount(flat, de[:, k], PAD + 1) for k in range(DIM)], 1), "w": np.concatenate([x0.T @ dz, x1.T @ dz]), "b": dz.sum(0),
            "u": h.T @ da, "c": da.sum(0), "v": a.T @ dl, "d": dl.sum(keepdims=True),
        }
        grads["e"][PAD] = 0
        state["t"] = t = state.get("t", 0) + 1
        for k, g in grads.items():
            m, s = state.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def blocks_of(text: bytes, first: int, last: int) -> np.ndarray:
    """Blocks first..last (exclusive) of a text, each with the stride that follows it, as byte codes; PAD after the end."""
    span = (last - first) * BLOCK_BYTES + STRIDE
    raw = text[first * BLOCK_BYTES: first * BLOCK_BYTES + span]
    codes = np.full(span, PAD, np.int64)
    codes[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(codes, BLOCK_BYTES + STRIDE)[::BLOCK_BYTES]


def train(texts: list[str], ys: list[int], epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 0, min_steps: int = 400) -> ByteCnn:
    """Fit on texts without their copies; each step sees a random run of blocks of each text. Without both classes, scores are about the share of label 1."""
    from mesalith.llm.toxicity import fit_logistic

    model, rng = ByteCnn(seed), np.random.default_rng(seed)
    n, pos = len(ys), sum(ys)
    if pos == 0 or pos == n:
        share = (pos + 0.5) / (n + 1)
        model.calibration = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
        return model
    own, own_y = labelled.distinct_texts(texts, ys)
    data, y = [t.encode() for t in own], np.array(own_y, float)
    # the rarer class is drawn as often as a quarter of the time at least
    share = np.where(y == 1, y.mean(), 1 - y.mean())
    weight = np.where(share < 0.25, 0.25 / share, np.where(share > 0.75, 0.75 / share, 1.0))
    weight /= weight.sum()
    state: dict = {}
    steps = max(min_steps, epochs * len(data) // batch)
    for k in range(steps):
        pick = rng.choice(len(data), min(batch, len(data)), p=weight)
        codes, counts = [], []
        for i in pick:
            text = data[i]
            if rng.random() < SHORT_SHARE:
                start = int(rng.integers(0, max(1, len(text) - 8)))
                text = text[start: start + int(rng.integers(8, BLOCK_BYTES))]
            have = max(1, -(-len(text) // BLOCK_BYTES))
            at = int(rng.integers(0, max(1, have - TRAIN_BLOCKS + 1)))
            codes.append(blocks_of(text, at, min(have, at + TRAIN_BLOCKS)))
            counts.append(len(codes[-1]))
        model.step(np.concatenate(codes), np.array(counts), y[pick], state, rate * (1 - 0.9 * k / steps))
    x = model.summaries(data)
    model.calibration = fit_logistic(np.concatenate([np.ones((len(x), 1)), x], 1), y, ridge=1.0)
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, left_out: int = 0, threshold: float = 0.3, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    The network is fitted on a bounded sample of labelled rows outside the fold left_out; its few thousand numbers go
    to the executors. Every whole text is scored, long ones in parts; nothing is shuffled. Null counts as the empty
    text, which is one chunk of padding. Rows may repeat; a row with a null id is held out. Other columns are not read.
    """
    texts, ys = labelled.sample(docs, labels, label, folds, left_out, sample_docs, id_col, text_col)
    return score_quality(docs, train(texts, ys), id_col, text_col, folds, left_out, threshold)


def score_quality(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, left_out: int = 0, threshold: float = 0.3) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches):
        own = ByteCnn()
        own.p, own.calibration = sent.value
        for b in batches:
            score = own.scores([(t or "").encode() for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col, folds) == left_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op2(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
