"""Embedding links against all pairs."""

import numpy as np
import pytest

from mesalith.llm import embedding_dedup as ed


def brute(rows, least=0.93):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v):
            good[i] = (label, np.array(v, float) / np.linalg.norm(v))
    links = {i: set() for i, *_ in rows}
    for i, (la, a) in good.items():
        for j, (lb, b) in good.items():
            if i != j and la == lb and len(a) == len(b) and a @ b >= least:
                links[i].add(j)
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            for j in js:
                if comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return [(i, len(links[i]), comp[i], i is None or comp[i] == i) for i, *_ in rows]


COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def taken(out):
    """Results without the audit's figure."""
    return [tuple(r[c] for c in COLUMNS) for r in out.collect()]


@pytest.mark.parametrize("most", [3000, 40])
def test_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(ed, "SHARD_MOST", most)
    monkeypatch.setattr(ed, "SHARD", 10)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.0, 0.15, 0.3])).tolist(), int(rng.integers(2))) for i in range(400)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [float("nan")] * 16, 1), (1005, rows[0][1], None), (1006, [1e300] * 16, 1), (1007, [float("inf")] * 16, 1), (1008, [2e300] * 16, 1), (1009, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, links int").repartition(3)
    out = ed.embedding_links(df)
    got = {r[0]: r for r in taken(out)}
    rows[406] = (1006, [1.0] * 16, 1)
    rows[408] = (1008, [1.0] * 16, 1)
    want = {w[0]: w for w in brute(rows)}
    assert set(got) == set(want) and out.count() == len(rows)
    assert sum(g[1] for g in got.values()) >= 0.97 * sum(w[1] for w in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert sum(g[1] for g in got.values()) % 2 == 0  # a link is told at both its ends
    assert ed.audit_recall(df, out) >= 0.97 and out.first().recall >= 0.97


def test_repeated_rows(spark):
    """Each row is a vector of its own, whether it repeats an id, a vector or both."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, a, 1), (1, a, 1), (1, b, 1), (2, b, 1), (3, a, 2), (4, None, 1), (4, a, 1), (None, a, 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, h int, copies int").repartition(2)
    want = [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]
    assert sorted(taken(ed.embedding_links(df)), key=repr) == sorted(want, key=repr)


def test_many_groups_larger_than_the_pool(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 32))
    rows = [(i, (base[i % 12] + 0.1 * rng.normal(size=32)).tolist(), 1) for i in range(3000)]
    out = ed.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    got = np.array([r[1] for r in sorted(taken(out))])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum() and out.first().recall >= 0.95


def test_one_large_group(spark, monkeypatch):
    """A group that has one centre is dealt over parts, and each two of them meet."""
    monkeypatch.setattr(ed, "SHARD_MOST", 700)
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    x = base + 0.15 * rng.normal(size=(3000, 24))
    out = ed.embedding_links(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    got = np.array([r[1] for r in sorted(taken(out))])
    assert (got <= true).all() and got.sum() >= 0.9 * true.sum() and got.sum() % 2 == 0


def test_low_recall_is_searched_again(spark, monkeypatch):
    monkeypatch.setattr(ed, "range_search", lambda x, graph, starts, queries, own, least, beam=0: np.zeros((len(queries), len(x)), bool))
    rng = np.random.default_rng(4)
    rows = [(i, [float(i % 3 == k) + 0.01 * rng.normal() for k in range(3)], i % 2) for i in range(60)]
    out = ed.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(taken(out)) == sorted(brute(rows)) and out.first().recall == 1.0


@pytest.mark.parametrize("noise", [0.01, 0.0])
def test_groups_larger_than_the_pool(spark, noise):
    """Pools lie within their group, so no edge leaves it; every group is found all the same."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 16))
    rows = [(i, (base[i % 3] + noise * rng.normal(size=16)).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(taken(ed.embedding_links(df))) == sorted(brute(rows))


def test_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    out = ed.embedding_links(df)
    got, want = {r[0]: r for r in taken(out)}, {w[0]: w for w in brute(rows)}
    assert sum(g[1] for g in got.values()) >= 0.9 * sum(w[1] for w in want.values()) and all(got[i][1] <= want[i][1] for i in want)
    assert ed.audit_recall(df, out) >= 0.9


def test_null_ids_and_empty(spark):
    assert ed.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert taken(ed.embedding_links(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int"))) == [(None, 0, None, True)] * 2
