"""Line dedup against all pairs on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from mesalith.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, hashes):
    first, spots = {}, []
    for (i, t), th in zip(rows, hashes, strict=True):
        for no, raw in enumerate(t.split("\n") if t is not None else []):
            line = raw.strip(" \t\r")
            if line:
                spot = (i is not None, i or 0, th, no)
                spots.append(line)
                first[line] = min(first.get(line, spot), spot)
    near = {x for x in first if any(first[y] < first[x] and distance(x, y) <= 1 for y in first)}
    out = []
    for (i, t), th in zip(rows, hashes, strict=True):
        keep, n = [], 0
        parts = t.split("\n") if t is not None else []
        for no, raw in enumerate(parts):
            line = raw.strip(" \t\r")
            if line and (line in near or first[line] != (i is not None, i or 0, th, no)):
                n += line in near
            else:
                keep.append(raw)
        out.append((i, None if t is None else "\n".join(keep), len(parts), len(parts) - len(keep), n))
    return out


def edit(rng, s):
    i = rng.randrange(len(s))
    return rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("abcz") + s[i:], s[:i] + rng.choice("abcz") + s[i + 1:]])


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(18, 24))) for _ in range(12)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "short", "éü" * 11, "x" * 200]
    for _ in range(40):
        pool.append(edit(rng, rng.choice([p for p in pool if len(p) < 100])))
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool[:-1]) + rng.choice(["", "\r"]) for _ in range(rng.randrange(0, 5)))) for i in range(40)]
    rows += [(3, rows[3][1]), (3, pool[0]), (None, pool[1] + "\n\n" + pool[2]), (90, None), (91, ""), (92, " \n\n"), (93, "x" * 200), (94, "x" * 201)]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, id string, n_near int").repartition(3)
    got_rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    want = brute([(r.doc_id, r.text) for r in got_rows], [r.h for r in got_rows])
    out = ld.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "id", "n_lines", "n_dropped", "n_near"]
    got = [tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped", "n_near").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[4] for w in want) > 0


@pytest.mark.parametrize("seed", [2, 3])
def test_short_lines(spark, seed):
    """Lines of one character and more, and columns whose names clash."""
    rng = random.Random(seed)
    rows = [(i, "\n".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 20) if i % 2 else rng.randrange(0, 4))) for _ in range(3))) for i in range(40)]
    rows += [(i + 100, edit(rng, t)) for i, t in rows if t and "\n" not in t[:1]]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, __drops string, th int").repartition(3)
    got_rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    want = brute([(r.doc_id, r.text) for r in got_rows], [r.h for r in got_rows])
    out = ld.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "__drops", "th", "n_lines", "n_dropped", "n_near"]
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped", "n_near").collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_check():
    rng = random.Random(5)
    for _ in range(500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        assert ld.within_one_edit(a, b) == (distance(a, b) <= 1)


def test_long_lines(spark):
    a = "xy" * 20000
    out = ld.line_dedup(spark.createDataFrame([(1, a), (2, a[:-1] + "z"), (3, a + "q\nshort")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == [a, "", "short"] and [r.n_near for r in out] == [0, 1, 1]
