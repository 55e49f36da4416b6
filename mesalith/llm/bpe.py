"""Byte-level BPE by a global distinct-word shuffle: every distinct word is encoded once, and its ids are joined back to its places."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of documents is closed at so many pre-tokens; it is the unit in which positions are counted and put together again.
BLOCK_TOKENS = 1 << 20
#: Hash buckets of words, at most: a full block's packs have some hundred words each.
BUCKETS = 512
#: Words of a bucket that a task remembers before it forgets them all.
WORDS_KEPT = 2_000_000
#: Pre-tokens of a document that are put together at once.
PIECE = 1 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The token-byte table by id; as long as the rank file, whatever the corpus."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tuple(table)


def squeeze_ints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32: the four planes of their bytes, each compressed on its own."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    parts = _squeeze(*(np.ascontiguousarray(p).tobytes() for p in planes))
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def expand_ints(data: bytes) -> np.ndarray:
    at, planes = 16, []
    for n in np.frombuffer(data[:16], "<u4").tolist():
        planes.append(np.frombuffer(_expand(data[at: at + n]), np.uint8))
        at += n
    return np.ascontiguousarray(np.stack(planes, 1)).view("<u4")[:, 0].astype(np.int64) if len(planes[0]) else np.zeros(0, np.int64)


class _Words(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _squeeze(*parts: bytes) -> list[bytes]:
    import zstandard

    return [zstandard.ZstdCompressor(level=3).compress(p) for p in parts]


def _expand(part: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(part)


_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("codes", pa.binary()), ("packs", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))])


def _blocks(pattern: str, most: int, buckets: int):
    """Rows (block, docs, codes, packs): of each document the id, whether it is null, and its pre-tokens; the number of the word at each position; the block's distinct words by hash bucket, in the order of their numbers."""

    def close(block, words, codes, docs):
        import zlib

        names = list(words)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), np.int32, len(names))
        codes = np.concatenate(codes)
        # in a bucket the most frequent word first
        order = np.lexsort((-np.bincount(codes, minlength=len(names)), bucket))
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        packs = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            part = "\n".join([names[i].replace("\\", "\\\\").replace("\n", "\\n") for i in order[ends[k]: ends[k + 1]].tolist()])
            packs.append({"bucket": k, "words": _squeeze(part.encode())[0]})
        head = _squeeze(np.array([x for d in docs for x in d], np.int64).tobytes())[0]
        row = ([block], [head], [squeeze_ints(rank[codes])], [packs])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        task, k = TaskContext.get(), 0
        first = (task.partitionId() if task else 0) << 32
        words, codes, docs, n = _Words(), [], [], 0
        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = find(text.as_py() or "")
                codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                docs.append((0 if ident is None else ident, ident is None, len(found)))
                n += len(found) + 1
                if n >= most:
                    yield close(first + k, words, codes, docs)
                    words, codes, docs, n, k = _Words(), [], [], 0, k + 1
        if docs:
            yield close(first + k, words, codes, docs)

    return run


_PACK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])


def _packs(batches):
    """(bucket, block, words): the distinct words of blocks, exploded by bucket."""
    for b in batches:
        for block, packs in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array([x["bucket"] for x in packs], pa.int32()), pa.array([block] * len(packs), pa.int64()), pa.array([x["words"] for x in packs], pa.binary())], schema=_PACK)


_ESCAPED = {"\\\\": "\\", "\\n": "\n"}


def _spelt(part: bytes) -> list[str]:
    import re

    words = _expand(part).decode().split("\n")
    return [re.sub(r"\\\\|\\n", lambda m: _ESCAPED[m[0]], w) if "\\" in w else w for w in words]


_CODED = pa.schema([("bucket", pa.int32()), ("of", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _encode(path: str, pattern: str):
    """Rows (bucket, of, lengths, ids). All rows of a bucket come one after another in one task, so each distinct word is encoded once."""

    def run(batches):
        encode = _encoding(path, pattern).encode_ordinary
        known, last = {}, None
        for batch in batches:
            rows = []
            for bucket, block, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                found = []
                for w in _spelt(words):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = np.array(encode(w), "<u4").tobytes()
                    found.append(ids)
                rows.append((bucket, block, squeeze_ints(np.array([len(x) // 4 for x in found])), squeeze_ints(np.frombuffer(b"".join(found), "<u4"))))
                if len(known) > WORDS_KEPT:
                    known = {}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _CODED.types, strict=True)], schema=_CODED)

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values[np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]


def _together(path: str, with_ids: bool):
    """Join a block's ids back to its positions, and the ids with the token-byte table; per document: ids, their digest, and the digest of the decoded bytes."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.binary()] if with_ids else [])]

    def run(block: pa.Table, packs: pa.Table) -> pa.Table:
        out, spelling = [], token_bytes(path)
        packs = packs.sort_by("bucket").select(["lengths", "ids"]).to_pylist()
        whole = lambda name: np.concatenate([np.zeros(0, np.int64), *(expand_ints(r[name]) for r in packs)])
        n_ids, ids = whole("lengths"), whole("ids").astype("<u4")
        ids_at = np.cumsum(n_ids) - n_ids
        for b in block.select(["docs", "codes"]).to_pylist():
            codes, at = expand_ints(b["codes"]), 0
            for ident, null, n in np.frombuffer(_expand(b["docs"]), np.int64).reshape(-1, 3).tolist():
                total, sums, kept = 0, (hashlib.sha256(), hashlib.sha256()), ([], [])
                for cut in range(at, at + n, PIECE):
                    own = codes[cut: min(at + n, cut + PIECE)]
                    found = _gather(ids, ids_at[own], n_ids[own])
                    total += len(found)
                    for digest, keep, part in zip(sums, kept, (found.tobytes(), b"".join(map(spelling.__getitem__, found.tolist()))), strict=True):
                        digest.update(part)
                        if with_ids:
                            keep.append(part)
                at += n
                out.append((None if null else ident, total, *(x.hexdigest() for x in sums), *((np.frombuffer(b"".join(kept[0]), "<u4").astype(np.int32), b"".join(kept[1])) if with_ids else ())))
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode every whole text and decode the ids again: id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded].

    Null counts as the empty text (no ids). Rows may repeat and ids may be null; each row gives one row. Other columns
    are not read. ranks: path of a rank file, the same on all executors; pattern: the pre-token pattern.

    A task cuts its documents into blocks and numbers each block's distinct words; the word numbers are the positions,
    and travel once, to the task that puts the block together. Only distinct words go to the buckets of a hash (packed, BUCKETS of them at
    most, so a block has no more packs than that on any cluster; with more shuffle partitions, a bucket is dealt over
    several tasks by the block). Each distinct word is encoded once a task, and ids are joined back to their block. A frequent word is
    one entry a block. What a block holds is bounded by block_tokens (or one document). Block numbers come from the
    partition and a counter, so a task that runs again makes the same blocks.
    """
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(BUCKETS, 4 * partitions)
    kind = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # both uses of the blocks read one shuffle: they take the same columns, so Spark makes it once
    blocks = rows.mapInArrow(_blocks(pattern, block_tokens, buckets), "block long, docs binary, codes binary, packs array<struct<bucket:int,words:binary>>").repartition("block")
    packs = blocks.mapInArrow(_packs, "bucket int, block long, words binary")
    dealt = packs.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(max(1, partitions // buckets)))).sortWithinPartitions("bucket")
    coded = dealt.mapInArrow(_encode(path, pattern), "bucket int, of long, lengths binary, ids binary")
    return blocks.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(_together(path, with_ids), kind).withColumnRenamed("id", id_col)


def op8(spark, sf_dir):
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
