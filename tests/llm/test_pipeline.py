"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline as cp
from mesalith.llm import packing, secrets, toxicity
from tests.llm import test_near_dedup as tn
from tests.llm import test_text_ops as tt


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs = []
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        outs.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
    for _, out in outs[:-1]:
        assert out.columns == list(cp.COLUMNS)
    # toxicity: the same decisions as the operator's
    given, out = outs[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in toxicity.toxicity(given, labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in out.collect()} == want
    given, out = outs[1]
    rows = given.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    lines = {x.strip(" \t\r") for r in rows for x in r.text.split("\n")}
    assert len(lines) < 20000
    brute = {}
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.h)):
        for no, x in enumerate(r.text.split("\n")):
            first.setdefault(x.strip(" \t\r"), (r.doc_id, no))
    order = {x: i for i, x in enumerate(sorted(first, key=first.get))}
    by_length = {}
    for x in first:
        by_length.setdefault(len(x), []).append(x)
    near = {x for x in first if x and any(y and order[y] < order[x] and quick(x, y) for n in (len(x) - 1, len(x), len(x) + 1) for y in by_length.get(n, ()))}
    for r in rows:
        brute[r.doc_id] = "\n".join(x for no, x in enumerate(r.text.split("\n")) if not x.strip(" \t\r") or (x.strip(" \t\r") not in near and first[x.strip(" \t\r")] == (r.doc_id, no)))
    assert {r.doc_id: r.text for r in out.collect()} == brute
    given, out = outs[2]
    want = {w[0] for w in tn.brute([(r.doc_id, r.text) for r in given.collect()], 5) if w[3]}
    assert {r.doc_id for r in out.collect()} == want
    given, out = outs[3]
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: secrets.redact(r.text) for r in given.collect()}
    given, out = outs[4]
    tk = Tokenizer.from_file(packing.default_tokenizer())
    tt.check_packs(out.collect(), {r.doc_id: [*tk.encode(r.text, add_special_tokens=False).ids, 1] for r in given.collect()}, 2048)


def quick(a, b):
    """Levenshtein distance 1 at most, by the longest common start and end."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0


def test_odd_documents(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", None), (None, "a b c", "en", "s", 5), (3, "x" * 50000, "en", "s", 1), (3, "x" * 50000, "en", "s", 1), (4, "token=abcdefgh123", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    outs = [docs]
    for _, f in cp.STAGES:
        outs.append(cp.written(f(spark, outs[-1], "/root/testdata/sf0.001")))
    told = lambda d: sorted(((r.doc_id, r.text if r.text is None else r.text[:20]) for r in d.collect()), key=repr)
    kept = sorted([(1, None), (2, ""), (None, "a b c"), (3, "x" * 20), (3, "x" * 20), (4, "token=abcdefgh123")], key=repr)
    assert told(outs[1]) == kept  # none is toxic
    assert told(outs[2]) == kept  # rows that repeat an id and text are treated alike: none of their lines stands earlier
    assert told(outs[3]) == kept  # and so both stay
    assert told(outs[4]) == sorted([*[r for r in kept if r[0] != 4], (4, "[SECRET]")], key=repr)
    packed = outs[5].collect()
    assert sorted((r.doc_id for r in packed if r.start == 0), key=repr) == sorted((i for i, _ in kept), key=repr)
    assert all(r.length == r.doc_tokens == 1 for r in packed if r.doc_id in (1, 2))
    empty = docs.limit(0)
    for _, f in cp.STAGES:
        empty = f(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0


def test_sql(spark):
    """The operators' SQL on the small tables, as the driver runs it."""
    import duckdb

    import __spark_entry__ as e
    from tests.conftest import SF

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = {k: v for k, v in e.oracle_sql().items() if k.startswith("op") and k[2].isdigit()}
    assert set(found) == {"op4_exact_dedup", "op10_url_filter"}
    for name, sql in found.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = [tuple(r[c] for c in columns) for r in e.queries()[name](spark, SF).collect()]
        assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
