"""Line dedup by a deletion-neighbourhood join: equal and nearly equal lines stay only where they come first."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesalith.llm._common import free_name, written

#: Parts of a line in the second, finer search for lines that differ in one part only.
SEGMENTS = 16


def half_keys(line: str) -> list[int]:
    """Keys that two lines within one edit share: with m the shorter length, they agree in the first m div 2 or in the other characters."""
    import xxhash

    out, n = [], len(line)
    for m in (n, n - 1):
        a = m // 2
        out += [xxhash.xxh3_64_intdigest(f"p{m}\x00{line[:a]}") - (1 << 63), xxhash.xxh3_64_intdigest(f"s{m}\x00{line[n - (m - a):]}") - (1 << 63)]
    return out


def _cut(text: str | None):
    """(number, trimmed line) of the lines that aren't blank."""
    for no, raw in enumerate(text.split("\n") if text else ()):
        if line := raw.strip(" \t\r"):
            yield no, line


def _batches(rows, names, types, most: int = 20_000):
    """Record batches of at most `most` rows from an iterator of tuples."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _hashed():
    """(id, th, no, h, n, k0..k3): each line's 128-bit hash, its length and its half keys."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
    names = ["id", "th", "no", "h", "n", "k0", "k1", "k2", "k3"]

    def run(batches):
        import xxhash

        def rows(b):
            for ident, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for no, line in _cut(text.as_py()):
                    yield ident, th, no, xxhash.xxh3_128_digest(line), len(line), *half_keys(line)

        for b in batches:
            yield from _batches(rows(b), names, types)

    return run


def _texts(batches):
    import xxhash

    for b in batches:
        lines = (line for text in b.column(0) for _, line in _cut(text.as_py()))
        yield from _batches(((xxhash.xxh3_128_digest(x), x) for x in lines), ["h", "line"], [pa.binary(), pa.string()], 5000)


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that belong to more than one line; the aggregation is partial on both sides of the shuffle."""
    return written(keyed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key"))


def segments(n: int, parts: int = SEGMENTS) -> list[tuple[int, int]]:
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def segment_keys(line: str) -> list[tuple[int, int, int, int]]:
    """(key, m, part, first position): what is left of the line around each part; m is the shorter length of a pair."""
    import xxhash

    out, n = [], len(line)
    for m in (n, n - 1):
        extra = n - m  # the longer line's part has one character more
        for k, (a, b) in enumerate(segments(m)):
            out.append((xxhash.xxh3_64_intdigest(f"{m}\x00{k}\x00{line[:a]}\x00{line[b + extra:]}") - (1 << 63), m, k, a))
    return out


def variants(line: str, parts: set[tuple[int, int]]) -> list[tuple[bytes, int]]:
    """Deletion neighbourhood within the given (m, part): hashed keys and kinds.

    Kind 0: the line itself; 1: one character less; 2: one character less, with its position, which two lines share
    that differ by a replacement there. Lines that share a kind 2 key are within one edit of each other, and the lines
    of a kind 1 key are within one edit of the line that has it as kind 0; so the earliest line of each is enough.
    """
    import xxhash

    n, out = len(line), {(xxhash.xxh3_128_digest(line), 0)}
    for m, k in parts:
        a, b = segments(m)[k]
        for i in range(a, min(n, b + (n - m))):
            less = line[:i] + line[i + 1:]
            if m == n:
                out.add((xxhash.xxh3_128_digest(f"{i}\x00{less}"), 2))
            else:
                out.add((xxhash.xxh3_128_digest(less), 1))
    return list(out)


def within_one_edit(a: str, b: str) -> bool:
    """Levenshtein distance at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i:]


def _near(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(h) of lines with an earlier line within one edit."""
    # first search, on hashes only: lines that share half of their text with another one
    keyed = distinct.select("g", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    maybe = written(keyed.join(_shared(keyed), "key", "left_semi").select("g").distinct())
    found = texts.withColumn("g", F.xxhash64("h")).join(maybe, "g", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    cand = written(found.join(distinct.join(maybe, "g", "left_semi").select("h", "first"), "h"))

    def part_keys(batches):
        for b in batches:
            rows = ((h, key, m, k) for h, line in zip(b.column(0).to_pylist(), b.column(1), strict=True) for key, m, k, _ in segment_keys(line.as_py()))
            yield from _batches(rows, ["h", "key", "m", "part"], [pa.binary(), pa.int64(), pa.int32(), pa.int32()])

    # second search: lines that differ from another one in one part of sixteen only
    parted = cand.select("h", "line").mapInArrow(part_keys, "h binary, key long, m int, part int").withColumn("g", F.xxhash64("h"))
    where = parted.join(_shared(parted), "key", "left_semi").groupBy("h").agg(F.collect_set(F.struct("m", "part")).alias("parts"))

    def emit(batches):
        for b in batches:
            found = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True)
            rows = ((h, first, key, kind) for h, first, line, parts in found for key, kind in variants(line.as_py(), {(p["m"], p["part"]) for p in parts}))
            yield from _batches(rows, ["h", "first", "key", "kind"], [pa.binary(), b.schema.field(1).type, pa.binary(), pa.int32()])

    keys = written(cand.join(where, "h").select("h", "first", "line", "parts").mapInArrow(emit, "h binary, first struct<id:long,th:long,no:int>, key binary, kind int"))
    one = lambda *kinds: keys.where(F.col("kind").isin(*kinds)).groupBy("key").agg(F.min(F.struct("first", "h")).alias("e"), F.count("*").alias("n"))
    pair = lambda members, best: members.join(best, "key").where("e.first < first").select("h", F.col("e.h").alias("by"))
    own, less, swap = (keys.where(F.col("kind") == k).select("key", "h", "first") for k in (0, 1, 2))
    pairs = pair(swap, one(2).where("n > 1")).unionByName(pair(less, one(0))).unionByName(pair(own, one(1))).distinct()
    named = pairs.join(cand.select("h", F.col("line").alias("x")), "h").join(cand.select(F.col("h").alias("by"), F.col("line").alias("y")), "by")

    def verify(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if within_one_edit(x, y)], pa.binary())], names=["h"])

    return named.select("h", "x", "y").mapInArrow(verify, "h binary").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) with cleaned texts, and n_lines, n_dropped, n_near as further columns.

    Lines are what stands between newlines, trimmed of blanks, tabs and carriage returns for comparison; blank lines
    stay and count in n_lines only. The earliest occurrence of a line by (id, text hash, line number) stays, later
    ones go. A line also goes, in all places, where an earlier line is within edit distance 1 of it, however short,
    whether or not that one goes itself (n_near counts these; n_dropped counts both).
    Null texts stay null with 0 lines, empty texts have one blank line; null ids come first. Rows that repeat an id
    and text are treated alike. All documents stay; a text that loses all its lines becomes empty. The names n_lines,
    n_dropped and n_near are replaced where the input has them.

    Only hashes of all lines are shuffled: equal lines meet by a partial aggregation. The deletion neighbourhood is
    emitted for those lines alone that share all of their text but one sixteenth with another line, which two searches
    on hashed keys find without loss; of each variant only the earliest line is joined, never all pairs.
    """
    return apply_drops(docs, dropped_lines(docs, id_col, text_col), id_col, text_col)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, drops): for each text that loses lines, their numbers and whether each goes for being nearly equal."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = written(rows.mapInArrow(_hashed(), "id long, th long, no int, h binary, n int, k0 long, k1 long, k2 long, k3 long"))
    distinct = written(lines.groupBy("h").agg(F.min(F.struct("id", "th", "no")).alias("first"), F.count("*").alias("n"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4))).withColumn("g", F.xxhash64("h")))
    texts = rows.select("text").mapInArrow(_texts, "h binary, line string")
    near = written(_near(distinct, texts).withColumn("near", F.lit(True)))
    told = distinct.select("h", "first", "n").join(near, "h", "left").where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return (lines.select("id", "th", "no", "h").join(told, "h").where(~(F.struct("id", "th", "no").eqNullSafe(F.col("first"))) | F.col("near"))
            .groupBy("id", "th").agg(F.collect_set(F.struct("no", "near")).alias("drops")))


def apply_drops(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    extra = ["n_lines", "n_dropped", "n_near"]
    base = docs.drop(*extra)
    cols = base.columns
    key = base.select(F.struct(*cols).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_col).alias("own_th"))
    joined = key.join(drops, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left").select("row.*", F.col("drops").alias(free_name(base, "drops")))
    schema = base.schema
    for name in extra:
        schema = schema.add(name, "integer")

    def run(batches):
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts, gone = b.column(cols.index(text_col)).to_pylist(), b.column(len(cols)).to_pylist()
            out, n = [], ([], [], [])
            for t, drop in zip(texts, gone, strict=True):
                parts = t.split("\n") if t is not None else []
                numbers = {d["no"] for d in drop or ()}
                out.append("\n".join(x for i, x in enumerate(parts) if i not in numbers) if numbers else t)
                for c, v in zip(n, (len(parts), len(numbers), sum(d["near"] for d in drop or ())), strict=True):
                    c.append(v)
            arrays = [*b.columns[:-1], *(pa.array(c, pa.int32()) for c in n)]
            arrays[cols.index(text_col)] = pa.array(out, b.schema.field(cols.index(text_col)).type)
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *extra])

    return joined.mapInArrow(run, schema)


def op1(spark, sf_dir):
    """Per document: doc_id, n_lines, n_dropped, n_near, and the SHA-256 of the cleaned text (null: of the empty one)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
