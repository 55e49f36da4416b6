"""MinHash near-dedup on SetSketch registers: banded candidates, joint likelihood estimates, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesalith.llm._common import components, free_name, written

#: Bands and registers of a band. At a Jaccard similarity of 0.8, all bands differ for about 3 in 1,000,000 pairs.
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Registers are truncated minima with exponential spacing: 1 - log_BASE of a minimum of exponential variates of this rate, cut to 0..255.
BASE, RATE = 1.2, 20.0
#: Pairs whose estimate is this much (about five standard errors) below the threshold are not confirmed on full sets.
SLACK = 0.16
#: Members of a bucket that are compared with each other at once; larger buckets are dealt over blocks that meet each other.
BUCKET = 4096
#: Documents, and shingles, of a group that are held against each other at once; larger groups are dealt over blocks.
BLOCK, BLOCK_ITEMS = 4096, 4_000_000
WORDS_KEPT = 200_000

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode().lower().split()  # bytes: A-Z only, and splits at the six ASCII blanks only
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x100000001B3) ^ h[i: len(h) - k + 1 + i])
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set; those of a union are the larger ones, register by register."""
    low, short = np.full(REGISTERS, np.iinfo(np.uint32).max), hashes.astype(np.uint32)
    for at in range(0, len(short), 512):
        part = short[at: at + 512, None] ^ _XOR
        part *= _MUL
        np.minimum(low, part.min(0), out=low)
    least = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 + (np.log(RATE) - np.log(least)) / np.log(BASE)), 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    part = regs.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((part << (np.uint64(8) * np.arange(ROWS, dtype=np.uint64))).sum(1) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS))).view(np.int64)


_GRID = np.linspace(0, 1, 101)


def _score(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood of the similarities of the grid."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    up, down = up[:, None], down[:, None]
    tiny = 1e-12
    return up * np.log(more + tiny) + down * np.log(less + tiny) + (REGISTERS - up - down) * np.log(np.maximum(1 - more - less, tiny))


def estimate(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood, jointly from the sizes of both sets and the numbers of registers that are larger in a (up), larger in b (down), or equal."""
    return _GRID[_score(up, down, n_a, n_b, _GRID).argmax(1)]


def reaches(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is `least` or more: the likelihood has one peak, so it still rises there."""
    score = _score(up, down, n_a, n_b, np.array([least - 0.01, least]))
    return score[:, 1] >= score[:, 0]


def _signatures(k: int):
    def run(batches):
        import xxhash

        shingle = Shingler(k)
        for b in batches:
            rows = []
            for ident, text, th in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = shingle(text.as_py())
                if len(s):
                    r = registers(s)
                    rows.append((ident, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), r.tobytes(), band_keys(r)))
                else:
                    rows.append((ident, th, 0, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["id", "th", "n", "node", "regs", "keys"])

    return run


def _sets(k: int):
    def run(batches):
        import xxhash

        shingle = Shingler(k)
        for b in batches:
            rows = []
            for i, (node, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                s = shingle(text.as_py()).tobytes()
                if xxhash.xxh3_128_digest(s) == node:
                    rows.append((i, s))
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([s for _, s in rows], pa.binary()), *(b.column(c).take(at) for c in (3, 4, 5))], names=["num", "items", "component", "block", "blocks"])

    return run


def _likely(percent: int):
    """Keep the pairs whose sizes and estimate allow the threshold."""

    def run(batches):
        for b in batches:
            n_a, n_b = (np.array(b.column(i).to_pylist(), float) for i in (2, 4))
            if not len(n_a):
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (3, 5))
            ok = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate((ra > rb).sum(1), (ra < rb).sum(1), n_a, n_b) >= percent / 100 - SLACK)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _partners(percent: int):
    """Links (a, b) that join all likely pairs within a block of a bucket whose members aren't one group yet; `ask` marks the documents that are compared with all others."""

    def run(table: pa.Table) -> pa.Table:
        node, comp = table["num"].to_numpy(), table["comp"].to_numpy()
        n = table["n"].to_numpy().astype(float)
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        _, comp = np.unique(comp, return_inverse=True)

        def linked_to(i: int) -> np.ndarray:
            fit = np.flatnonzero((100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (comp != comp[i]))
            other = regs[fit]
            return fit[reaches((regs[i] > other).sum(1), (regs[i] < other).sum(1), np.full(len(fit), n[i]), n[fit], percent / 100 - SLACK)]

        found = join_all(comp, table["ask"].to_numpy(zero_copy_only=False), linked_to)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return run


def _blocks(torn: DataFrame) -> DataFrame:
    """(key, salt, part, num, comp, ask): the members of torn buckets, dealt over blocks where there are more than BUCKET.

    A member of a large bucket has a salt; those outside the bucket's largest group also have a part, and visit the
    block of each salt and their part. So each pair that isn't of the largest group meets, and a block has about BUCKET members
    and BUCKET visitors at most.
    """
    one = torn.where(F.col("size") <= BUCKET).select("key", F.lit(0).alias("salt"), F.lit(0).alias("part"), "num", "comp", F.lit(True).alias("ask"))
    large = written(torn.where(F.col("size") > BUCKET))
    if large.isEmpty():
        return one
    most = large.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", "n").alias("most"), F.max("n").alias("in_most"))
    salted = (large.join(most, "key").withColumn("outside", F.col("comp") != F.col("most"))
              .withColumn("salts", F.ceil(F.col("size") / BUCKET).cast("int")).withColumn("parts", F.ceil((F.col("size") - F.col("in_most")) / BUCKET).cast("int"))
              .withColumn("salt", F.pmod(F.xxhash64("key", "num"), F.col("salts")).cast("int")).withColumn("part", F.pmod(F.xxhash64("num", "key"), F.col("parts")).cast("int")))
    place = lambda salt, part, ask: F.struct(salt.alias("salt"), part.alias("part"), ask.alias("ask"))
    home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(F.col("salt"), p, F.col("outside") & (p == F.col("part"))))
    away = F.transform(F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: s != F.col("salt")), lambda s: place(s, F.col("part"), F.lit(True)))
    spread = salted.select("key", "num", "comp", F.explode(F.when(F.col("outside"), F.concat(home, away)).otherwise(home)).alias("at"))
    return one.unionByName(spread.select("key", "at.salt", "at.part", "num", "comp", "at.ask"))


def _visits(large: DataFrame) -> DataFrame:
    """(component, p, q, num, items, ask): each two blocks of a group, where one has members outside the group's largest part; these ask. Two blocks are what a task gets at most."""
    large = written(large)
    most = large.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("part", "n").alias("most"))
    marked = large.join(most, "component").withColumn("ask", F.col("part") != F.col("most")).drop("part", "most")
    torn = written(marked.where("ask").select("component", F.col("block").alias("to")).distinct())
    fixed = marked.where("not ask").join(torn, "component")
    free = marked.where("ask").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (fixed.unionByName(free.select(*fixed.columns)).where("block <> to")
            .select("component", F.least("block", "to").alias("p"), F.greatest("block", "to").alias("q"), "num", "items", "ask"))


def join_all(comp: np.ndarray, ask: np.ndarray, linked_to, first: int | None = None) -> list[tuple[int, int]]:
    """Links that join all that is connected by pairs with one side (at least) asked for; comp is changed on the way.

    linked_to(i) tells all that i is linked with. Who is in the largest component at its turn is passed over, and comes
    again in a further pass if that component isn't the largest any more; so in the end all who never asked are in one
    component. Gives at most one link for each component that is joined.
    """
    links: list[tuple[int, int]] = []
    asked = np.zeros(len(comp), bool)

    def hold(i: int) -> None:
        asked[i] = True
        linked = linked_to(i)
        linked = linked[comp[linked] != comp[i]]
        for c, at in zip(*np.unique(comp[linked], return_index=True), strict=True):
            links.append((i, int(linked[at])))
            comp[comp == c] = comp[i]

    if first is not None:
        hold(first)
    while len(todo := np.flatnonzero(ask & ~asked & (comp != np.bincount(comp).argmax()))):
        for i in todo.tolist():
            if comp[i] != np.bincount(comp).argmax():
                hold(i)
    # who was passed over may be linked with some outside that aren't asked for: the fewer of both are held against all
    idle = np.flatnonzero(ask & ~asked)
    if len(idle):
        rest = np.flatnonzero(~asked & (comp != comp[idle[0]]))
        if len(rest) <= len(idle):
            for i in rest.tolist():
                if comp[i] != comp[idle[0]]:
                    hold(i)
        else:
            for i in idle.tolist():
                hold(i)
    return links


def exact_links(sets: list[np.ndarray], percent: int, ask: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all documents (of those asked for) that are connected, counted on full sets through an inverted index.

    A document is held against all others at once. Gives at most one link for each component that a document joins.
    """
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(code, kind="stable")
    posting, first = doc[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    # the document with the most common shingles first: it joins the most
    common = np.add.reduceat((first[code + 1] - first[code]) / 1.0, ends - sizes) / sizes

    def linked_to(i: int) -> np.ndarray:
        own = code[ends[i] - sizes[i]: ends[i]]
        starts, n = first[own], first[own + 1] - first[own]
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        return np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))

    return join_all(np.arange(len(sets)), ask, linked_to, int(common.argmax()))


def _confirm(percent: int):
    """Links (a, b) within a block of a group; `ask` marks the documents that are held against the others."""

    def run(table: pa.Table) -> pa.Table:
        num = table["num"].to_numpy()
        order = np.argsort(num, kind="stable")
        sets = [np.frombuffer(table["items"][int(i)].as_py(), np.uint64) for i in order]
        found = exact_links(sets, percent, table["ask"].to_numpy(zero_copy_only=False)[order]) if len(sets) > 1 else []
        num = num[order]
        return pa.table({"a": pa.array([num[i] for i, _ in found], pa.int64()), "b": pa.array([num[j] for _, j in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are what stands between ASCII blanks, A-Z lower-cased; a document's set has its distinct shingles (fewer
    words: the whole sequence as one). Documents are linked where 100 * intersection >= percent * union, confirmed on
    full sets; component_id is the smallest id reachable over links. Null and empty texts have no shingles and no
    links. A row with a null id is linked with rows of an equal set only, never gives a component its id unless all are
    null (then component_id is null), and is kept only if it is alone. Rows that repeat an id are documents of their own. Other
    columns are not read.

    Equal sets are one node from the start (partial aggregation by digest). Nodes that share a band key are candidates:
    each is compared with its bucket's first node, and where a bucket is not one group by then, those outside its
    largest group with all of it; a bucket of s nodes still gives less than 2 s pairs, as only those that join groups
    are told. Pairs whose estimate allows the threshold make groups, and within a group links are counted on full sets, each document
    against all. A group of more than BLOCK documents is dealt over blocks by a hash; each two blocks then meet, if one
    has documents that are not in the group's largest component. Candidates come from hashing: at the threshold about 3 pairs in 1,000,000
    share no band key.
    """
    out = _rows_in_groups(docs, id_col, text_col, shingle, percent)
    comp = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.col("grouped").isNull()).alias("kept"))


def _rows_in_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """One row per document: id, th (text hash), n, component_id, best and grouped; the last three are null where a document is alone. best (none, id, th) is the group's first row, null ids last."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = written(rows.withColumn("th", F.xxhash64("text")).mapInArrow(_signatures(shingle), "id long, th long, n long, node binary, regs binary, keys array<long>"))
    # the written numbers of the nodes are what everything after goes by
    nodes = written(sig.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
                    .withColumn("num", F.monotonically_increasing_id()))
    banded = nodes.select("num", F.explode("keys").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.min("num").alias("a"), F.count("*").alias("size")).where("size > 1"))
    member = written(banded.join(buckets, "key").select("key", "num", "a", "size"))
    pairs = member.where("num <> a").select("a", F.col("num").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("num").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(_likely(percent), "a long, b long"))
    grouped = components(likely)
    placed = member.join(grouped.select(F.col("node").alias("num"), "component"), "num", "left").select("key", "size", "num", F.coalesce("component", "num").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    nearest = (_blocks(placed.join(split, "key", "left_semi")).join(nodes.select("num", "n", "regs"), "num")
               .groupBy("key", "salt", "part").applyInArrow(_partners(percent), "a long, b long"))
    more = written(nearest.distinct())
    # the groups so far are stars already, which settle in fewer rounds than their pairs
    groups = components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if not more.isEmpty() else grouped
    # full sets are looked at again for the members of groups only
    shared = groups.join(nodes.select(F.col("num").alias("node"), "n", F.col("node").alias("digest"), F.col("least").alias("id")), "node").select(F.col("node").alias("num"), "component", "n", "digest", "id")
    sizes = shared.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    dealt = shared.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    items = written(rows.join(dealt, "id").select("num", "digest", "text", "component", "block", "blocks").mapInArrow(_sets(shingle), "num long, items binary, component long, block int, blocks int").dropDuplicates(["num"]))
    links = written(items.withColumn("ask", F.lit(True)).groupBy("component", "block").applyInArrow(_confirm(percent), "a long, b long"))
    joined = components(links)
    large = items.where("blocks > 1").join(joined.select(F.col("node").alias("num"), F.col("component").alias("part")), "num", "left").withColumn("part", F.coalesce("part", "num"))
    if not large.isEmpty():
        across = written(_visits(large).groupBy("component", "p", "q").applyInArrow(_confirm(percent), "a long, b long"))
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))
    placed = nodes.select("num", "node", "least", "best", "copies").join(joined.select(F.col("node").alias("num"), "component"), "num", "left").select("node", "least", "best", "copies", F.coalesce("component", "num").alias("comp"))
    grouped = placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("best").alias("chosen"), F.sum("copies").alias("size")).where("size > 1")
    named = placed.join(grouped, "comp").select("node", "component_id", F.col("chosen").alias("best"))
    return sig.select("id", "th", "n", "node").join(named.withColumn("grouped", F.lit(True)), "node", "left")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) that are alone, and of each group the one with the smallest (id, text hash), null ids last.

    Rows are told by id and text: rows that repeat a kept id and text all stay, but for those without an id, of which
    one stays. Texts without shingles stay, all of them.
    """
    told = _rows_in_groups(docs, id_col, text_col, shingle, percent).where("grouped and not (id <=> best.id and th = best.th)")
    k_id, k_th, k_own = (free_name(docs, c) for c in ("gone", "gone_th", "own_th"))
    gone = written(told.select(F.col("id").alias(k_id), F.col("th").alias(k_th)).distinct())
    ident, th = F.col(id_col).cast("long"), F.xxhash64(text_col)
    named = docs.where(ident.isNotNull()).join(gone.where(F.col(k_id).isNotNull()), (ident == F.col(k_id)) & (th == F.col(k_th)), "left_anti")
    nameless = docs.where(ident.isNull())
    some = F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))
    left = nameless.where(some).withColumn(k_own, th).join(gone.where(F.col(k_id).isNull()).select(k_th), F.col(k_own) == F.col(k_th), "left_anti")
    return named.unionByName(nameless.where(~some)).unionByName(left.dropDuplicates([k_own]).drop(k_own))


def op5(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
