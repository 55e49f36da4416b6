"""Embedding near-dedup on a robust-pruned flat graph: built on overlapping shards, joined, searched from the medoids of its components and the vector itself, verified and audited."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesalith.llm._common import components, join_back, small, written

#: Vectors that a shard's centres are drawn from, and the children that a shard is split into at most.
CENTRE_SAMPLE, FAN = 4096, 64
#: Vectors for each child. Larger shards than SHARD_MOST are split again, down to LEVELS; what can't be split is dealt over parts of that size, of which each two meet.
SHARD, SHARD_MOST, LEVELS = 1000, 3000, 6
#: Vectors of a shard that are dealt to children at once.
DEALT = 50_000
#: Children that a vector goes to: its nearest centre, and the next one where a linked vector may have that for its nearest.
OVERLAP = 2
#: Centres are at least so far apart (cosine), so that a group of near copies doesn't take many of them and isn't torn apart.
APART = 0.8
#: Out-degree of the graph, candidates that pruning starts from, and the slack of robust pruning.
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Search: beam width before the range grows; open vectors expanded in a step; vectors searched at once.
BEAM, STEP, AT_ONCE = 48, 64, 256
#: Below this audited recall, the parts are searched again, all their vectors against all.
RECALL, AUDIT = 0.9, 500


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each vector, -1 where there are fewer: from its nearest `pool` in the shard, one is taken unless a nearer one taken before is alpha times nearer to it than the vector is."""
    n = len(x)
    k = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int32)
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        if k < n - 1:
            near = np.argpartition(-sim, k - 1, 1)[:, :k] if k else np.zeros((len(rows), 0), int)
        else:
            near = np.argsort(-sim, 1)[:, :k]
        d = 1 - np.take_along_axis(sim, near, 1)
        order = np.argsort(d, 1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        alive, count = np.ones(near.shape, bool), np.zeros(len(rows), int)
        for j in range(k):
            take = alive[:, j] & (count < degree)
            if take.any():
                out[rows[take], count[take]] = near[take, j]
                count[take] += 1
                between = 1 - np.einsum("ikd,id->ik", x[near[take, j + 1:]], x[near[take, j]])
                alive[np.flatnonzero(take)[:, None], np.arange(j + 1, k)[None]] &= alpha * between > d[take, j + 1:]
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(0)).argmax())


def entry_points(x: np.ndarray, graph: list[np.ndarray]) -> np.ndarray:
    """The medoid of each connected component of a graph with edges both ways."""
    comp = np.full(len(x), -1)
    out = []
    for i in range(len(x)):
        if comp[i] < 0:
            comp[i], wait = i, [i]
            while wait:
                near = graph[wait.pop()]
                near = near[comp[near] < 0]
                comp[near] = i
                wait += near.tolist()
            own = np.flatnonzero(comp == i)
            out.append(int(own[medoid(x[own])]))
    return np.array(out, np.int64)


def range_search(x: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """For each query, a row of booleans: the vectors found whose cosine is `least` or more (float, verified later).

    Greedy search over the graph with a beam, from the medoids of its components and from the query itself where it
    is a vector of the graph (own, else -1); then the range expands: every found vector within the
    range has its neighbours looked at, until nothing new is in the range. All queries go step by step together.
    """
    n, q = len(x), len(queries)
    degree = np.array([len(g) for g in graph], np.int64)
    first, flat = np.cumsum(degree) - degree, np.concatenate([np.zeros(0, np.int64), *graph])
    seen, sim, open_ = np.zeros((q, n), bool), np.full((q, n), -np.inf), np.zeros((q, n), bool)
    sim[:, starts] = queries @ x[starts].T
    seen[:, starts] = open_[:, starts] = True
    r = np.flatnonzero(own >= 0)
    sim[r, own[r]] = np.einsum("ij,ij->i", queries[r], x[own[r]])
    seen[r, own[r]] = open_[r, own[r]] = True
    live = np.arange(q)
    while len(live):
        # of what is seen, the best `beam` and all that are in the range may be expanded
        s = sim[live]
        bar = np.partition(s, n - beam, 1)[:, n - beam] if n > beam else np.full(len(live), -np.inf)
        may = open_[live] & (s >= np.minimum(bar, least)[:, None])
        has = may.any(1)
        live, may, s = live[has], may[has], s[has]
        if not len(live):
            break
        # the best open vectors of each query at once
        step = min(STEP, n)
        pick = np.argpartition(-np.where(may, s, -np.inf), step - 1, 1)[:, :step]
        good = np.take_along_axis(may, pick, 1)
        row = np.repeat(live, pick.shape[1])[good.ravel()]
        node = pick.ravel()[good.ravel()]
        open_[row, node] = False
        d = degree[node]
        new = np.zeros((q, n), bool)
        new[np.repeat(row, d), flat[np.arange(d.sum()) + np.repeat(first[node] - (np.cumsum(d) - d), d)]] = True
        r, c = np.nonzero(new & ~seen)
        seen[r, c] = open_[r, c] = True
        for at in range(0, len(r), 1 << 16):
            a, b = r[at: at + (1 << 16)], c[at: at + (1 << 16)]
            sim[a, b] = np.einsum("ij,ij->i", queries[a], x[b])
    return sim >= least - 1e-6


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return unit(np.array(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), -1)) if len(col) else np.zeros((0, 1))


def pick_centres(x: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of k-means, then thinned."""
    c = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(8):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        hit = np.linalg.norm(total, axis=1) > 1e-9
        c[hit] = unit(total[hit])
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < APART:
            kept.append(i)
    return c[kept]


def _centres(table: pa.Table) -> pa.Table:
    """(kind, path, blocks, centres) of one shard, from its sample."""
    order = np.argsort(table["num"].to_numpy(), kind="stable")
    n = table["n"][0].as_py()
    c = pick_centres(_matrix(table["v"])[order], min(FAN, math.ceil(n / SHARD)))
    return pa.table({"kind": table["kind"][:1], "path": table["path"][:1], "blocks": table["blocks"][:1], "centres": pa.array([c.ravel()], pa.list_(pa.float64()))})


def _deal(least: float):
    """(num, kind, path, child, whole, v): the children that vectors of a shard go to.

    Of two unit vectors within a cosine of `least`, the one's nearest centre is no further from the other than its own
    by more than their distance along the line between both centres; within that margin a vector goes to both.
    """
    margin = math.sqrt(2 - 2 * least)

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        x = _matrix(rows["v"])
        c = np.array(centres["centres"][0].as_py()).reshape(-1, x.shape[1]) if centres.num_rows and len(x) else np.zeros((0, x.shape[1]))
        at, child = np.arange(len(x)), np.zeros(len(x), int)
        if len(c) > 1:
            sim = x @ c.T
            near = np.argsort(-sim, 1, kind="stable")[:, :OVERLAP]
            gap = np.take_along_axis(sim, near[:, :1], 1) - np.take_along_axis(sim, near, 1)
            apart = np.linalg.norm(c[near[:, :1]] - c[near], axis=2)
            at, k = np.nonzero(gap <= margin * apart + 1e-9)
            child = near[at, k]
        took = rows.take(pa.array(at))
        return pa.table({"num": took["num"], "kind": took["kind"], "path": took["path"], "child": pa.array(child, pa.int32()), "whole": pa.array(np.full(len(at), len(c) < 2)), "v": took["v"]})

    return run


def _shards(nodes: DataFrame, least: float) -> DataFrame:
    """(num, kind, path, v): vectors in overlapping shards, split level by level while they are large and have more than one centre."""
    open_, done = nodes.select("num", "kind", F.lit(0).cast("long").alias("path"), "v"), []
    for _ in range(LEVELS):
        large = written(open_.groupBy("kind", "path").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_MOST).withColumn("blocks", F.ceil(F.col("n") / DEALT).cast("int")))
        if large.isEmpty():
            break
        large = small(large)
        done.append(open_.join(large, ["kind", "path"], "left_anti"))
        own = open_.join(large, ["kind", "path"])
        some = own.where(F.pmod(F.xxhash64("num", "path"), F.lit(1_000_000)) * F.col("n") < CENTRE_SAMPLE * 1_000_000)
        centres = some.groupBy("kind", "path").applyInArrow(_centres, "kind string, path long, blocks int, centres array<double>")
        centres = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = own.withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).groupBy("kind", "path", "block")
        split = written(placed.cogroup(centres.groupBy("kind", "path", "block")).applyInArrow(_deal(least), "num long, kind string, path long, child int, whole boolean, v array<double>"))
        done.append(split.where("whole").select("num", "kind", "path", "v"))
        open_ = split.where("not whole").select("num", "kind", F.xxhash64("path", "child").alias("path"), "v")
    out = open_
    for d in done:
        out = out.unionByName(d)
    return out


def _build(table: pa.Table) -> pa.Table:
    """Adjacency of one part of a shard: (num, near)."""
    order = np.argsort(table["num"].to_numpy(), kind="stable")
    num, x = table["num"].to_numpy()[order], _matrix(table["v"])[order]
    graph = robust_prune(x) if len(x) > 1 else np.zeros((len(x), 0), np.int32)
    return pa.table({"num": pa.array(num), "near": pa.array([num[g[g >= 0]] for g in graph], pa.list_(pa.int64()))})


def _graph(num: np.ndarray, near: list) -> list[np.ndarray]:
    """The joined adjacency lists within a part, edges both ways; num is sorted."""
    around: list[set] = [set() for _ in num]
    for i, g in enumerate(near):
        if g:
            g = np.array(g)
            at = np.minimum(np.searchsorted(num, g), len(num) - 1)
            for j in at[num[at] == g].tolist():
                if i != j:
                    around[i].add(j)
                    around[j].add(i)
    return [np.array(sorted(g), np.int64) for g in around]


def _found(x: np.ndarray, num: np.ndarray, near: list, queries: np.ndarray, inside: bool, least: float, all_pairs: bool) -> np.ndarray:
    """Rows of queries, columns of vectors: what the search over the vectors' graph finds."""
    out = np.ones((len(queries), len(x)), bool)
    if not all_pairs and len(x):
        graph = _graph(num, near)
        starts = entry_points(x, graph)
        for at in range(0, len(queries), AT_ONCE):
            part = queries[at: at + AT_ONCE]
            out[at: at + AT_ONCE] = range_search(x, graph, starts, part, np.arange(at, at + len(part)) if inside else np.full(len(part), -1), least)
    return out


def _search(least: float, all_pairs: bool = False):
    """Links within a part of a shard, or between two of its parts: found by either side, confirmed in double precision. Rows (num, links, other): counts of each vector, and the links of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        parts, num = table["own_part"].to_numpy(), table["num"].to_numpy()
        order = np.lexsort((num, parts))
        parts, num, x, copies = parts[order], num[order], _matrix(table["v"])[order], table["copies"].to_numpy()[order]
        near, leaves = table["near"].take(pa.array(order)).to_pylist(), table["paths"].take(pa.array(order)).to_pylist()
        n, path = int((parts == parts[0]).sum()), table["path"][0].as_py()
        two = table["p"][0].as_py() != table["q"][0].as_py()
        a, b = (np.arange(n), np.arange(n, len(num))) if two else (np.arange(n), np.arange(n))
        found = _found(x[b], num[b], [near[i] for i in b], x[a], not two, least, all_pairs)
        found |= (_found(x[a], num[a], [near[i] for i in a], x[b], False, least, all_pairs) if two else found).T
        # a pair counts in one shard only: the smallest that both belong to
        lower = sorted({v for own in leaves for v in own if v < path})
        at = {v: k for k, v in enumerate(lower)}
        shared = np.zeros((len(num), len(lower)), np.float32)
        for i, own in enumerate(leaves):
            shared[i, [at[v] for v in own if v < path]] = 1
        links = np.zeros(len(num), np.int64)
        for k in range(0, len(a), AT_ONCE):
            rows = a[k: k + AT_ONCE]
            hit = found[k: k + AT_ONCE]
            hit &= x[rows] @ x[b].T >= least
            if not two:
                hit[np.arange(len(rows)), rows] = False
            own = hit & (shared[rows] @ shared[b].T == 0) if lower else hit
            links[rows] += own @ copies[b]
            if two:
                links[b] += copies[rows] @ own
        if not two:
            found &= found.T
        edges = _forest(found, two)
        some = np.flatnonzero(links)
        return pa.table({
            "num": pa.array([*num[some].tolist(), *(int(num[i]) for i, _ in edges)], pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64()),
            "other": pa.array([*[None] * len(some), *(int(num[j]) for _, j in edges)], pa.int64()),
        })

    return run


def _forest(found: np.ndarray, two: bool) -> list[tuple[int, int]]:
    """(first, member) for each further member of a component; with two parts, the columns come after the rows."""
    n = found.shape[0]
    comp, edges = np.full(n + found.shape[1] if two else n, -1), []
    for i in range(len(comp)):
        if comp[i] < 0:
            comp[i], wait = i, np.array([i])
            while len(wait):
                if two:
                    rows, cols = wait[wait < n], wait[wait >= n] - n
                    reach = np.concatenate([found[:, cols].any(1), found[rows].any(0)])
                else:
                    reach = found[wait].any(0)
                wait = np.flatnonzero(reach & (comp < 0))
                comp[wait] = i
                edges += [(i, int(j)) for j in wait]
    return edges


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, kind, h, g, v), all but the id null where a vector can't be linked: kind joins label and length, h and g are hashes, and v is scaled by its largest component, so that no square over- or underflows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0)
    rows = rows.select("id", "label", F.when(usable, F.transform("v", lambda e: e / F.array_max(F.transform("v", F.abs)))).alias("v"))
    known = lambda c: F.when(F.col("v").isNotNull(), c)
    return rows.select("id", known(F.concat_ws("/", F.col("label").cast("string"), F.size("v"))).alias("kind"), known(F.xxhash64("v")).alias("h"), known(F.xxhash64(F.lit("v"), "v")).alias("g"), "v")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, recall.

    Vectors are compared only under equal, non-null labels and equal lengths, by cosine in double precision; those
    that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor do rows with a null id. Every
    link returned has a cosine of `least` or more; the graph may miss some. recall is the share found, audited for AUDIT
    vectors against all (1 where there are no links); under RECALL, all vectors of each part are held against each other. n_links
    counts other vectors, component_id is the smallest id reachable over links, itself included, kept marks it. Each
    row is a vector of its own, also where it repeats an id (then component_id is the same). Other columns are not read.

    Equal vectors are one node from the start (partial aggregation). Nodes go to the shards of their nearest centres,
    level by level, so work doesn't grow faster than the table; shards overlap. Per label, a shard's part is a graph of
    its own, pruned robustly; adjacency lists of one vector are joined over all shards, and each vector is searched for
    in the parts of its shards. A shard of more than SHARD_MOST vectors that has one centre only is dealt over parts by
    a hash, and each two of them meet, so no task holds more than two parts. A pair counts in the smallest common
    shard only, and counts go to both its ends; a task passes on counts and a spanning forest, so a group of near
    copies gives no rows for its pairs.
    """
    rows = _keyed(vectors, id_col, vector_col, label_col)
    nodes = written(rows.where("kind is not null").groupBy("kind", "h", "g", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("num", F.monotonically_increasing_id()))
    placed = written(_shards(nodes, least))
    paths = placed.groupBy("num").agg(F.collect_set("path").alias("paths"))
    sizes = small(written(placed.groupBy("kind", "path").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("parts"))))
    dealt = placed.join(sizes, ["kind", "path"]).withColumn("own_part", F.pmod(F.xxhash64("num", "path"), F.col("parts")).cast("int"))
    graph = (dealt.select("kind", "path", "own_part", "num", "v").groupBy("kind", "path", "own_part").applyInArrow(_build, "num long, near array<long>")
             .groupBy("num").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # one list a shard
    known = nodes.select("num", "copies").join(paths, "num").join(graph, "num")
    ends = dealt.join(known, "num").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = written(ends.select("kind", "path", F.least("own_part", "to").alias("p"), F.greatest("own_part", "to").alias("q"), "own_part", "num", "v", "copies", "paths", "near"))

    def linked(all_pairs: bool) -> DataFrame:
        told = written(pairs.groupBy("kind", "path", "p", "q").applyInArrow(_search(least, all_pairs), "num long, links long, other long"))
        counts = told.groupBy("num").agg(F.sum("links").alias("links"))
        joined = components(told.where("other is not null").select(F.col("num").alias("a"), F.col("other").alias("b")))
        each = nodes.select("num", "kind", "h", "g", "least", "copies").join(counts, "num", "left").join(joined.select(F.col("node").alias("num"), "component"), "num", "left")
        each = each.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).withColumn("component", F.coalesce("component", "num"))
        names = each.groupBy("component").agg(F.min("least").alias("name"))
        return written(each.where("links > 0").join(names, "component").select("kind", "h", "g", "links", "name", "copies"))

    found = linked(False)
    if (share := _audit(nodes, found, least)) < RECALL:
        found = linked(True)
        share = _audit(nodes, found, least)
    told = join_back(rows.select("id", "kind", "h", "g"), found, ["kind", "h", "g"], "copies", "id")
    comp = F.coalesce("name", "id")
    return told.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"), F.lit(float(share)).alias("recall"))


def _true_links(rows: DataFrame, queries: pa.Table, least: float) -> np.ndarray:
    """For each query (kind, v), how many of the rows (kind, v, copies) are linked with it, itself included: brute force, in blocks."""
    by_kind: dict = {}
    for i, kind in enumerate(queries["kind"].to_pylist()):
        by_kind.setdefault(kind, []).append(i)
    known = {kind: (np.array(at), _matrix(queries["v"].take(pa.array(at)))) for kind, at in by_kind.items()}

    def run(batches):
        total = np.zeros(queries.num_rows, np.int64)
        for b in batches:
            kinds, weight = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy()
            for kind in set(kinds) & set(known):
                own = np.flatnonzero(kinds == kind)
                at, q = known[kind]
                total[at] += ((_matrix(b.column(1).take(pa.array(own))) @ q.T >= least) * weight[own, None]).sum(0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["i", "n"])

    out = np.zeros(queries.num_rows, np.int64)
    for r in rows.select("kind", "v", "copies").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        out[r["i"]] = r["n"]
    return out


def _drawn(col: str, most: int, n: int) -> Column:
    """About `most` of n rows, by a hash."""
    return F.pmod(F.xxhash64(F.col(col), F.lit("audit")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, n)))


def _audit(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """Share of the links of about AUDIT nodes, drawn by a hash, that were found."""
    some = nodes.where(_drawn("num", AUDIT, nodes.count()))
    drawn = some.join(found.select("kind", "h", "g", "links"), ["kind", "h", "g"], "left").select("kind", "v", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    return _share(_true_links(nodes, drawn, least) - 1, drawn["links"].to_numpy()) if drawn.num_rows else 1.0


def _share(true: np.ndarray, got: np.ndarray) -> float:
    return float(np.minimum(true, got).sum() / true.sum()) if true.sum() > 0 else 1.0


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, queries: int = AUDIT) -> float:
    """Share of links found, of those of a bounded sample of query vectors against all vectors. Of rows that repeat an id, the most links found are compared."""
    rows = _keyed(vectors, id_col, vector_col, label_col).where("kind is not null").select("id", "kind", "v", F.lit(1).alias("copies"))
    got = result.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("n_links").alias("links"))
    drawn = rows.where(_drawn("id", queries, rows.count())).join(got, "id").toArrow()
    return _share(_true_links(rows, drawn, least) - 1, drawn["links"].to_numpy()) if drawn.num_rows else 1.0


def op9(spark, sf_dir):
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
