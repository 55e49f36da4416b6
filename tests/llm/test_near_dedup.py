"""Near-dedup against all pairs."""

import random

import numpy as np
import pytest

from mesalith.llm import near_dedup as nd


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        c = min(ids) if ids else None
        for i in g:
            ident = rows[i][0]
            out.append((ident, len(sets[i]), c, len(g) == 1 if ident is None else ident == c))
    return out


@pytest.mark.parametrize("k,block", [(2, 4096), (5, 4096), (2, 7)])
def test_against_all_pairs(spark, monkeypatch, k, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(k)
    base = [[rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 4) for _ in range(rng.choice([60, 120]))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(1000)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "oNE"), (205, "Ä b"), (206, "ä b"), (207, "x y z"), (7, rows[7][1]), (None, rows[3][1]), (None, "alone here now"), (300, " ".join(map(str, range(60000)))), (301, " ".join(map(str, range(60001))))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(3)
    got = [tuple(r) for r in nd.near_duplicates(docs, shingle=k).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, k), key=repr)
    kept = nd.keep_one(docs, shingle=k)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_links_of_passed_over_documents():
    core, x, own = range(70), range(100, 130), iter(range(1000, 2000))
    take = lambda n: [next(own) for _ in range(n)]
    docs = [[*core, *x[:20], *take(10)], [*core, *x[10:], *take(10)], [*core, *x], list(core)]
    sets = [np.array(sorted(d), np.uint64) for d in docs]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        links = nd.exact_links([sets[i] for i in order], 80, np.ones(4, bool))
        assert {frozenset(order[i] for i in pair) for pair in links} == {frozenset((0, 2)), frozenset((1, 2))}


@pytest.mark.parametrize("seed", range(40))
def test_join_all_against_union(seed):
    rng = np.random.default_rng(seed)
    n = 14
    near = np.triu(rng.random((n, n)) < rng.choice([0.05, 0.12, 0.25]), 1)
    near |= near.T
    ask = rng.random(n) < rng.choice([0.3, 0.7, 1.0])
    want = np.arange(n)
    for _ in range(n):
        for i, j in np.argwhere(near & (ask[:, None] | ask)):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    comp = np.arange(n)
    links = nd.join_all(comp, ask, lambda i: np.flatnonzero(near[i]), 0)
    assert all(near[i, j] for i, j in links)
    assert all(comp[i] == comp[j] for i, j in np.argwhere(want[:, None] == want))


def test_reaches_is_the_estimate():
    rng = np.random.default_rng(5)
    up, down = rng.integers(0, 70, 3000), rng.integers(0, 70, 3000)
    n_a = rng.integers(50, 5000, 3000).astype(float)
    n_b = n_a * rng.uniform(0.8, 1.25, 3000)
    assert (nd.reaches(up, down, n_a, n_b, 0.64) == (nd.estimate(up, down, n_a, n_b) > 0.635)).all()


@pytest.mark.parametrize("bucket", [4096, 12])
def test_bucket_of_a_template(spark, monkeypatch, bucket):
    """One bucket, whose first node is unlike the others: all likely pairs meet, whatever blocks they are in, and chains are followed."""
    monkeypatch.setattr(nd, "BUCKET", bucket)
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    template, sets = fresh(600), [np.arange(400, dtype=np.uint64)]
    for _ in range(25):
        own = fresh(600)
        sets += [np.concatenate([template, own[60 * k: 600], fresh(60 * k)]) for k in range(3)]
    regs = [nd.registers(x) for x in sets]
    n = len(sets)
    rows = [(7, i, i, n, len(x), bytearray(r.tobytes())) for i, (x, r) in enumerate(zip(sets, regs, strict=True))]
    torn = spark.createDataFrame(rows, "key long, num long, comp long, size long, n long, regs binary")
    got = nd._blocks(torn.drop("n", "regs")).join(torn.select("num", "n", "regs"), "num").groupBy("key", "salt", "part").applyInArrow(nd._partners(80), "a long, b long").collect()
    true = [(i, j) for i in range(n) for j in range(i) if min(map(len, (sets[i], sets[j]))) * 100 >= 80 * max(map(len, (sets[i], sets[j]))) and nd.estimate(*(np.array([v], float) for v in ((regs[i] > regs[j]).sum(), (regs[i] < regs[j]).sum(), len(sets[i]), len(sets[j]))))[0] >= 0.635]

    def united(pairs):
        comp = np.arange(n)
        for i, j in pairs:
            comp[comp == comp[i]] = comp[j]
        return {frozenset(np.flatnonzero(comp == c).tolist()) for c in comp}

    assert len(true) >= 50 and united([(r.a, r.b) for r in got]) == united(true)


def test_keep_one_by_row(spark):
    copy, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    lone = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [
        (1, copy), (None, copy), (None, lone[0]),  # a copy without an id takes no other along
        (None, lone[1]), (None, lone[1]), (None, lone[1].upper()),  # a group without ids: one stays
        (2, near), (2, lone[2]),  # an id with two texts
        (3, lone[3]), (3, lone[3]),  # repeated rows stay
        (4, lone[4]), (4, lone[4] + " end"),  # one id, two texts of one group: one stays
        (None, None), (None, ""), (None, " "), (None, None), (5, None),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = [(r.doc_id, r.text) for r in nd.keep_one(docs).collect()]
    assert nd.keep_one(docs).columns == docs.columns
    ends = [(i, t) for i, t in got if t and (t.lower().startswith(lone[1]) or t.startswith(lone[4]))]
    assert sorted(i or 0 for i, _ in ends) == [0, 4]
    want = [(1, copy), (None, lone[0]), (2, lone[2]), (3, lone[3]), (3, lone[3]), (None, None), (None, ""), (None, " "), (None, None), (5, None)]
    assert sorted((g for g in got if g not in ends), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block,bucket", [(4096, 4096), (7, 7)])
def test_chains_of_windows(spark, monkeypatch, block, bucket):
    """Families of overlapping windows, each with words of its own, in random order: one component each, however many steps it takes."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BUCKET", bucket)
    rng = random.Random(9)
    texts = []
    for f in range(20):
        words = [f"f{f}w{i}" for i in range(420)]
        texts += [" ".join(w for i, w in enumerate(words[:100]) if i != rng.randrange(2, 98)) for _ in range(8)]
        starts = list(range(8, 300, 8))
        rng.shuffle(starts)
        texts += [" ".join(words[at: at + 100]) for at in starts if rng.random() < 0.95]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, gone int, gone_th int, own_th int").repartition(3)
    assert sorted(tuple(r) for r in nd.near_duplicates(docs, shingle=2).collect()) == sorted(brute(rows, 2))
    assert nd.keep_one(docs, shingle=2).columns == docs.columns


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = nd.registers(x[:2500]), nd.registers(x[500:])
    assert (np.maximum(a, b) == nd.registers(x)).all()
    est = nd.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([2500.0]), np.array([2500.0]))[0]
    assert abs(est - 2000 / 3000) < 0.12


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in nd.near_duplicates(docs, shingle=2).collect()]
    assert sorted(got) == sorted(brute(rows, 2))
