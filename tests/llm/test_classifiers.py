"""Quality and toxicity: held-out accuracy, sums by brute force, odd rows."""

import itertools

import numpy as np
import pytest

from mesalith.llm import labelled, quality, toxicity


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    m = toxicity.Crf()
    m.trans, m.start = rng.normal(size=(2, 2)), 0.3
    s = rng.normal(size=5)
    weight = np.zeros((5, 2))
    for path in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(s[t] * path[t] for t in range(5)) + m.start * path[0] + sum(m.trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t in range(5):
            weight[t, path[t]] += w
    want = weight[:, 1] / weight.sum(1)
    got = m.tag([s, np.zeros(0), s[:2]])
    assert np.allclose(got[0], want) and len(got[1]) == 0
    one, pairs = m._pairs(s[None], np.ones((1, 5), bool))
    assert np.allclose(one[0], want) and np.isclose(pairs.sum(), 4)


def test_cnn_gradient_lowers_the_loss_and_whole_texts_count():
    rng = np.random.default_rng(1)
    good = ["".join(rng.choice(list("abc "), 300)) for _ in range(40)]
    bad = ["".join(rng.choice(list("abc%"), 300)) for _ in range(40)]
    m = quality.train(good + bad, [1] * 40 + [0] * 40, min_steps=150)
    s = m.scores([t.encode() for t in good + bad])
    assert s[:40].min() > s[40:].max()
    long = good[0].encode() * 3000
    assert abs(m.scores([long])[0] - m.scores([good[0].encode() * 20])[0]) < 0.2
    tail = m.scores([good[0].encode() * 300 + bad[0].encode() * 3000])[0]
    assert tail < 0.5  # what stands at the end counts
    assert m.scores([long, b"", b"a"]).shape == (3,)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize("op,label,least", [(quality.quality, "quality", 0.85), (toxicity.toxicity, "toxic", 0.9)])
def test_held_out(spark, tables, op, label, least):
    docs, labels = tables
    rows = op(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("op", [quality.quality, toxicity.toxicity])
def test_odd_rows(spark, op):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 0), (2, "", 1), (2, "", 1), (3, "é" * 70000, 0), (4, "12 !!", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = op(docs, labels).collect()
    assert len(rows) == 6 and all(r.score is not None and r.held_out is not None for r in rows)
    assert op(docs.limit(0), labels.limit(0)).count() == 0


def test_copies_are_learned_from_once():
    texts = ["one two three four five", "one two three four five six", "an other text of six words"]
    assert labelled.distinct_texts(texts, [1, 1, 0])[1] in ([1, 0], [1, 1, 0])
    assert labelled.distinct_texts([texts[0]] * 3 + ["", ""], [1, 1, 1, 0, 0])[1] == [1, 0]


def test_long_texts_are_learned_from(spark):
    """Windows reach from the start to the end of a long text; short ones come whole."""
    text = "".join(chr(0x4E00 + i % 20000) for i in range(50_000))
    docs = spark.createDataFrame([(1, text, 0), (2, "short", 0), (3, None, 0)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    texts, ys = labelled.sample(docs, labels, "quality", 1, -1, 100)
    assert ys == [1, 0] and texts[1] == "short"
    parts = texts[0].split("\n")
    assert len(parts) == labelled.WINDOWS and text.startswith(parts[0]) and text.endswith(parts[-1]) and all(p in text for p in parts)
    assert sum(map(len, parts)) == labelled.LONGEST


def test_all_blocks_are_drawn(monkeypatch):
    """Over the steps of a fit, the runs of blocks cover a text of more blocks than a step sees."""
    seen = set()
    real = quality.blocks_of
    monkeypatch.setattr(quality, "blocks_of", lambda t, a, b: (seen.update(range(a, b)) if len(t) == 100 * quality.BLOCK_BYTES else None, real(t, a, b))[1])
    words = np.random.default_rng(0).choice(["one", "two", "six", "ten", "all"], 8000)
    long = " ".join(words)[: 100 * quality.BLOCK_BYTES]
    quality.train([long, "bad %% text", "worse ## text", "more $$ text"], [1, 0, 0, 0], min_steps=120)
    assert seen >= set(range(100))


def naive_score(model, text):
    """The network in plain loops."""
    p, pad, w = model.p, quality.PAD, quality.STRIDE
    n = max(1, -(-len(text) // quality.BLOCK_BYTES))
    codes = list(text) + [pad] * (n * quality.BLOCK_BYTES + w - len(text))
    blocks = []
    for b in range(n):
        top = np.zeros(quality.FILTERS)
        for at in range(b * quality.BLOCK_BYTES, (b + 1) * quality.BLOCK_BYTES, w):
            if codes[at] != pad:
                x = np.concatenate([p["e"][c] for c in codes[at: at + 2 * w]])
                top = np.maximum(top, x @ p["w"] + p["b"])
        blocks.append(top)
    logits = []
    for k in range(max(1, n - 1)):
        h = np.maximum(blocks[k], blocks[min(k + 1, n - 1)])
        logits.append(float((np.maximum(h @ p["u"] + p["c"], 0) @ p["v"] + p["d"])[0]))
    z = model.calibration @ np.array([1.0, np.mean(logits), max(logits), min(logits)])
    return 1 / (1 + np.exp(-z))


def test_quality_against_plain_loops():
    rng = np.random.default_rng(7)
    m = quality.ByteCnn(3)
    m.p["b"], m.p["c"], m.calibration = rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.HIDDEN).astype(np.float32), np.array([0.2, 0.5, -0.3, 0.4])
    texts = [b"", b"a", bytes(rng.integers(0, 256, 127, dtype=np.uint8)), bytes(rng.integers(0, 256, 128, dtype=np.uint8)), bytes(rng.integers(0, 256, 1000, dtype=np.uint8)), "é ".encode() * 300]
    assert np.allclose(m.scores(texts), [naive_score(m, t) for t in texts], atol=1e-5)


def test_toxic_scores_and_spans_by_brute_force(spark):
    """Scores and spans of the operator's rows, from the sums over all taggings."""
    m = toxicity.Crf()
    rng = np.random.default_rng(8)
    m.weights, m.trans, m.start, m.calibration = rng.normal(scale=0.8, size=toxicity.BUCKETS), rng.normal(size=(2, 2)), -0.2, np.array([-1.0, 0.4, 0.3, 0.2])
    m.weights = m.weights.astype(np.float32).astype(float)
    texts = ["", "One two, three! four", "é 12 ünder_score x", "a b c d e f g", "no"]
    rows = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(texts):
        words = list(toxicity.WORD.finditer(t))
        s = [sum(m.weights[f] for f in toxicity.features(w.group())) for w in words]
        weight = np.zeros((len(s), 2))
        for path in itertools.product((0, 1), repeat=len(s)) if s else ():
            w = np.exp(sum(a * b for a, b in zip(s, path, strict=True)) + m.start * path[0] + sum(m.trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            for k, state in enumerate(path):
                weight[k, state] += w
        p = weight[:, 1] / weight.sum(1) if s else np.zeros(0)
        spans, last = [], -2
        for k, w in enumerate(words):
            if p[k] >= 0.5:
                if k == last + 1:
                    spans[-1][1] = w.end()
                else:
                    spans.append([w.start(), w.end()])
                last = k
        assert np.isclose(rows[i].score, m.score(p), atol=1e-6) and rows[i].predicted == int(m.score(p) >= 0.7)
        assert rows[i].toxic_spans == ",".join(f"{a}:{b}" for a, b in spans) and rows[i].n_spans == len(spans)
