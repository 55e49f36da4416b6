"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesalith.llm._common import fold

#: Longer texts (code points) are learned from by so many windows, spread evenly from their start to their end, of that length in all; they are scored whole like all others.
LONGEST, WINDOWS = 20_000, 10


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most about `most` labelled rows outside the fold `left_out`, no matter how many there are.

    Rows are drawn by a hash of the id. Texts of more than `longest` code points come as WINDOWS pieces spread over all of them. Null ids, labels and texts, labels other than 0 and 1, and ids whose labels
    differ are left out. Only the drawn ids (at most about `most`) are broadcast.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
             .where(fold("id", folds) != left_out).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / n))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    got = texts.join(F.broadcast(known), "id").select("id", spread("text", longest).alias("text"), "y").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["text"].to_pylist(), got["y"].to_pylist(), strict=True))
    return [t for _, t, _ in rows], [y for *_, y in rows]


def spread(text: str, longest: int = LONGEST) -> Column:
    """The text, or its windows if it is longer, one a line."""
    n, size = F.length(text), longest // WINDOWS
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substr(F.col(text), (F.lit(1) + F.floor(i * (n - size) / (WINDOWS - 1))).cast("int"), F.lit(size)))
    return F.when(n <= longest, F.col(text)).otherwise(F.array_join(windows, "\n"))


def distinct_texts(texts: list[str], ys: list[int]) -> tuple[list[str], list[int]]:
    """Without exact and near copies (any of three least three-word hashes seen before), so that no group of copies weighs more than one document."""
    import xxhash

    seen, out = set(), ([], [])
    for t, y in zip(texts, ys, strict=True):
        w = t.lower().split()
        grams = [" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))]
        keys = {(s, min(xxhash.xxh64_intdigest(g, s) for g in grams)) for s in range(3)}
        if not keys & seen:
            out[0].append(t)
            out[1].append(y)
        seen |= keys
    return out
