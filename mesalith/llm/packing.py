"""Hierarchical multi-length packing of token ids into sequences of several context sizes."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesalith.llm._common import small, written

#: Context sizes; all are powers of two, the first is the longest.
TIERS = (2048, 1024, 512, 256, 128, 64)
END_ID = 1
#: Tokens of a step group; each group has sequences of one context size only.
STEP_TOKENS = 1 << 16
#: Strings whose ids a task remembers before it forgets them all.
UNITS_KEPT = 250_000

#: Pre-tokens never reach over the start of white space (but for one blank before a word), so that the ids of these units, put together, are those of the text.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer, its special tokens, an equal and faster encoder of single units or None, and the units that this worker knows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    special = tuple(t.content for t in made.get_added_tokens_decoder().values())
    return made, special, _by_ranks(path, special), {}


@functools.cache
def _splits_at_blanks(path: str) -> bool:
    """Whether the file leaves texts as they are and cuts them by the byte-level pattern, so that units can be encoded on their own."""
    with open(path) as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    return not made.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _by_ranks(path: str, special: tuple[str, ...]):
    """Where nothing but byte-level pre-tokens and merges in the order of their ids is at work, ranks alone give the tokenizer's ids; else None."""
    try:
        import public_tokenizers
        import tiktoken
    except ImportError:
        return None
    with open(path) as f:
        model = json.load(f)["model"]
    if not _splits_at_blanks(path) or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(vocab) != 256 + len(merged):
        return None
    # the printable stand-ins of bytes: bytes that print stand for themselves, the others follow from 256 on in order
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts by the tokenizer; units of text that were seen are not encoded again."""

    def __init__(self, path: str):
        self.tokenizer, self.special, self.by_ranks, self.known = _tokenizer(path)
        self.whole = not _splits_at_blanks(path)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.whole or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        units = _UNIT.findall(text)
        known = self.known
        if new := [u for u in dict.fromkeys(units) if u not in known]:
            if len(known) + len(new) > UNITS_KEPT:
                known.clear()
                new = list(dict.fromkeys(units))
            made = map(self.by_ranks, new) if self.by_ranks else (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))
            for u, ids in zip(new, made, strict=True):
                known[u] = array("I", ids).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, units)), "<u4")


class Packer:
    """Open windows, one for each tier. A piece is (document, start, ids, the document's length)."""

    def __init__(self, tiers=TIERS, first_id: int = 0):
        self.tiers = tuple(sorted(tiers, reverse=True))
        assert all(t & (t - 1) == 0 for t in self.tiers)
        self.open: dict[int, list] = {t: [] for t in self.tiers}
        self.used = dict.fromkeys(self.tiers, 0)
        self.next, self.made = first_id, {}

    def _close(self, size: int, pieces: list) -> list[tuple]:
        """Rows of a full window: each with its sequence, context size and the number of windows of that size before it."""
        k = self.made[size] = self.made.get(size, -1) + 1
        at, rows = 0, []
        for doc, start, ids, total in pieces:
            rows.append((doc, start, ids, total, self.next, at, size, k))
            at += len(ids)
        self.next += 1
        return rows

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        total, longest, done, at = len(ids), self.tiers[0], [], 0
        while total - at >= longest:
            done += self._close(longest, [(doc, at, ids[at: at + longest], total)])
            at += longest
        return done + self._place((doc, at, ids[at:], total)) if at < total else done

    def _place(self, piece) -> list[tuple]:
        """Put a piece shorter than the longest tier in the window of the smallest tier that holds it; a window it doesn't fit in is filled up, with whole pieces of shorter tiers first and then with the start of this piece."""
        done = []
        while len(piece[2]):
            n = len(piece[2])
            tier = min((t for t in self.tiers if t >= n), default=self.tiers[0])
            window = self.open[tier]
            if n > tier - self.used[tier]:
                self._fill(tier)
            gap = tier - self.used[tier]
            doc, start, ids, total = piece
            if gap:
                window.append((doc, start, ids[:gap], total))
                self.used[tier] += min(gap, n)
            piece = (doc, start + gap, ids[gap:], total)
            if self.used[tier] == tier:
                done += self._close(tier, window)
                self.open[tier], self.used[tier] = [], 0
        return done

    def _fill(self, tier: int) -> None:
        """Move whole pieces from the open windows of shorter tiers into the gap, longest first."""
        for t in (t for t in self.tiers if t < tier):
            for piece in sorted(self.open[t], key=lambda x: -len(x[2])):
                if len(piece[2]) <= tier - self.used[tier]:
                    self.open[tier].append(piece)
                    self.used[tier] += len(piece[2])
                    self.open[t] = [x for x in self.open[t] if x is not piece]
                    self.used[t] -= len(piece[2])

    def finish(self) -> list[tuple]:
        """What is left in the open windows, in sequences whose lengths are powers of two: no padding."""
        rest = [p for t in self.tiers for p in self.open[t]]
        left, done = sum(len(p[2]) for p in rest), []
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, need = [], size
            while need:
                doc, start, ids, total = rest.pop(0)
                window.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
            done += self._close(size, window)
            left -= size
        self.open = {t: [] for t in self.tiers}
        self.used = dict.fromkeys(self.tiers, 0)
        return done


_COLS = (("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int64()), ("nth", pa.int64()))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers=TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group [, ids].

    A document's ids are those of its whole text (null: none) and end_id; each id lies in exactly one piece. All
    sequences have a power of two of tokens, so nothing is padded. Rows may repeat and ids may be null: every row is a
    document of its own. Other columns are not read. step_group: the sequences of a context size over the whole table
    are dealt in order to groups of step_tokens tokens or less, whose totals differ by one sequence at most; the number
    is unique over all context sizes.

    Each task packs what it reads, with at most one open window per tier, so memory doesn't grow with the input and
    no text is shuffled. Pieces are written once; the sequences of each task and context size are counted, and the
    counts (a row each, so tasks times tiers) give the first number of each. Sequence ids join the partition's number and a
    counter: a task that runs again makes the same.
    """
    path = tokenizer or default_tokenizer()
    kind = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, nth long" + (", ids array<int>" if with_ids else "")

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        doc, start, ids, total, seq, at, size, nth = cols
        values = [doc, start, [len(x) for x in ids], [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids], total, seq, at, size, nth]
        made = [pa.array(list(v), t) for v, (_, t) in zip(values, _COLS, strict=True)]
        names = [n for n, _ in _COLS]
        if with_ids:
            made.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches):
        encode, task = Encoder(path), TaskContext.get()
        packer = Packer(tiers, (task.partitionId() if task else 0) << 32)
        end = np.array([end_id], "<u4")
        rows = []
        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += packer.add(ident, np.concatenate([encode(text.as_py()), end]))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    pieces = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kind))
    named = _step_groups(pieces, step_tokens).drop("nth")
    first = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
    return named.select(F.col("id").alias(id_col), *first[1:], *(["ids"] if with_ids else []))


def _step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """pieces with the step group of their sequence, from its task, context size and number there."""
    task = F.shiftright("sequence_id", 32).alias("task")
    counts = written(pieces.groupBy(task, "context").agg((F.max("nth") + 1).alias("n")))
    # one window a context size, over a row for each task
    before = Window.partitionBy("context").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # sequences r of N go to group r * groups div N: groups of one size, but for one sequence
    all_ = counts.groupBy("context").agg(F.sum("n").alias("all_n")).withColumn("groups", F.ceil(F.col("all_n") / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("context")))).cast("long"))
    starts = counts.select("task", "context", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).join(F.broadcast(all_), "context")
    starts = small(written(starts).select(F.col("task").alias("own_task"), F.col("context").alias("own_context"), "first", "all_n", "groups"))
    told = pieces.join(starts, (F.shiftright("sequence_id", 32) == F.col("own_task")) & (F.col("context") == F.col("own_context")))
    group = F.floor((F.col("first") + F.col("nth")).cast("decimal(38,0)") * F.col("groups") / F.col("all_n")).cast("long")
    return told.withColumn("step_group", F.col("context") * F.lit(1 << 40) + group)


def op7(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
