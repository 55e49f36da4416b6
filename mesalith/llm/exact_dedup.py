"""Exact dedup by Patricia-trie owners: compressed radix tries over (length, content hash) partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keys that a task's trie may hold before its largest subtree leaves it.
TRIE_BYTES = 48 << 20


class PatriciaTrie:
    """A compressed radix trie of byte strings; a terminal holds the keeper's id and the number of copies.

    A node is [edge bytes, children by first byte or None, keep id or None, copies]. `prefer` picks the id that stays.
    """

    def __init__(self, prefer=min):
        self.root = [b"", {}, None, 0]
        self.held = 0
        self.prefer = prefer

    def insert(self, key: bytes, ident: int | None, copies: int = 1) -> None:
        node, rest = self.root, key
        while rest:
            kids = node[1]
            child = kids.get(rest[0]) if kids else None
            if child is None:
                if kids is None:
                    kids = node[1] = {}
                node = kids[rest[0]] = [rest, None, None, 0]
                self.held += len(rest) + 200
                break
            edge = child[0]
            if rest.startswith(edge):
                node, rest = child, rest[len(edge):]
                continue
            k = _common_prefix(edge, rest)
            upper = [edge[:k], {edge[k]: child}, None, 0]
            child[0] = edge[k:]
            kids[rest[0]] = upper
            self.held += 200
            node, rest = upper, rest[k:]
        if node[3] and ident is not None and node[2] is not None:
            node[2] = self.prefer(node[2], ident)
        elif node[2] is None:
            node[2] = ident
        node[3] += copies

    def terminals(self, node=None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node[0]
            if node[3]:
                yield key, node[2], node[3]
            if node[1]:
                stack += [(x, key) for x in node[1].values()]

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the subtree below the root that holds the most bytes."""
        sizes = {b: sum(len(k) + 200 for k, _, _ in self.terminals(x)) for b, x in self.root[1].items()}
        if self.root[3]:
            yield b"", self.root[2], self.root[3]
            self.root[2], self.root[3] = None, 0
        if sizes:
            gone = self.root[1].pop(max(sizes, key=sizes.get))
            yield from self.terminals(gone)
        self.held = sum(sizes.values()) - max(sizes.values(), default=0)


def _common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_PARTIAL = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])


def _partial(found, prefix=b""):
    cols = [[], [], [], [], []]
    for key, keep, copies in found:
        for c, v in zip(cols, (len(key), hashlib.sha256(key).digest(), key, keep, copies), strict=True):
            c.append(v)
        if sum(map(len, cols[2][-64:])) > 4 << 20 or len(cols[0]) >= 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PARTIAL.types, strict=True)], schema=_PARTIAL)
            cols = [[], [], [], [], []]
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PARTIAL.types, strict=True)], schema=_PARTIAL)


def _local_tries(prefer, budget):
    """Copies within a task meet in its trie, so that a hot group sends one row per task."""

    def run(batches):
        trie = PatriciaTrie(prefer)
        for b in batches:
            for ident, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                trie.insert(content.as_py() or b"", ident)
                while trie.held > budget:
                    yield from _partial(trie.spill())
        yield from _partial(trie.terminals())

    return run


def _owner_tries(prefer, budget):
    """Owners of (length, hash) partitions. Rows come sorted by both, so a subtree that is left behind is complete and leaves the task."""
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def out(trie):
        rows = [(hashlib.sha256(k).digest(), i, n) for k, i, n in trie.terminals()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        trie, last = PatriciaTrie(prefer), None
        for b in batches:
            for digest, content, keep, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if digest != last and trie.held > budget:
                    yield from out(trie)
                    trie = PatriciaTrie(prefer)
                trie.insert(content.as_py(), keep, copies)
                last = digest
        yield from out(trie)

    return run


def normalised(text):
    """UTF-8 bytes with A-Z lower-cased; null is the empty text."""
    from mesalith.llm._common import ascii_lower

    return F.coalesce(ascii_lower(text), F.lit("")).cast("binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep: "min" or "max" id of the group
    stays. Rows with a null id count in group_size and never stay unless all ids of the group are null (then keep_id
    is null and kept is false). Rows that repeat an id and text are each returned, all kept if that id stays. Other
    columns are not read.

    Each task first merges its copies in a trie of its own; the distinct texts go to owners by length and SHA-256,
    which insert the full byte strings again. A trie over its budget gives up its largest subtree (at an owner: the
    finished ones). The answer (32 bytes a text) is joined back by digest for groups of two rows or more only; Spark
    splits that join where a digest is frequent.
    """
    prefer = {"min": min, "max": max}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("content"))
    local = rows.mapInArrow(_local_tries(prefer, budget), "n_bytes long, digest binary, content binary, keep_id long, copies long")
    owners = (local.repartition(F.col("n_bytes"), F.col("digest")).sortWithinPartitions("n_bytes", "digest").select("digest", "content", "keep_id", "copies")
              .mapInArrow(_owner_tries(prefer, budget), "digest binary, keep_id long, group_size long"))
    groups = owners.where("group_size > 1").select(F.hex("digest").alias("h"), "keep_id", "group_size")
    own = docs.select(F.col(id_col).alias("id"), F.upper(F.sha2(normalised(F.col(text_col)), 256)).alias("h"))
    joined = own.join(groups, "h", "left")
    single = F.col("group_size").isNull()
    out = joined.select(F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep_id")).cast("long").alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower("h").alias("text_sha256"))
    return out.select(id_col, "keep_id", "group_size", F.coalesce(F.col(id_col) == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def op4(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
