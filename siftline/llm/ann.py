"""Approximate nearest neighbours: a navigable small-world hierarchy per shard."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, shared_table

SHARD_ROWS = 4096
QUERY_BLOCK = 8192
M = 16
EF_BUILD, EF_UPPER, EF_SEARCH = 64, 8, 128
#: Nodes expanded at a time, queries searched together.
BEAM, LOCKSTEP = 4, 256


def pick(near, sims, vectors, keep):
    """Diverse neighbours: of candidates by nearness, those nearer to the node than to any kept one, then the nearest left."""
    if near.shape[1] < keep:
        pad = ((0, 0), (0, keep - near.shape[1]))
        near, sims = np.pad(near, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[near]
    between = np.einsum("bid,bjd->bij", v, v)
    real = np.isfinite(sims)
    kept = np.zeros(near.shape, bool)
    blocked = ~real
    for j in range(near.shape[1]):
        kept[:, j] = ~blocked[:, j] & (kept.sum(1) < keep)
        blocked |= kept[:, j : j + 1] & (between[:, j] >= sims)
    rank = np.where(kept, 0, np.where(real, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :keep]
    ok = np.take_along_axis(real, order, 1)
    return np.where(ok, np.take_along_axis(near, order, 1), -1)


def beam(graph, vectors, queries, entry, ef):
    """(nodes, similarities) of the ef nearest that a best-first search finds, all queries in step; -1 pads."""
    b, width = len(queries), graph.shape[1]
    seen = np.zeros((b, len(vectors) + 1), bool)
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), -1)
    entry = entry[:, :ef]
    ids[:, : entry.shape[1]] = entry
    seen[rows, ids] = True
    sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", vectors[ids], queries), -np.inf)
    done = ids < 0
    while True:
        open_sims = np.where(done, -np.inf, sims)
        at = np.argpartition(-open_sims, BEAM - 1, 1)[:, :BEAM] if ef > BEAM else np.argsort(-open_sims, 1)
        live = np.isfinite(np.take_along_axis(open_sims, at, 1))
        if not live.any():
            return ids, sims
        active = live.any(1)
        from_ids = np.where(live, np.take_along_axis(ids, at, 1), -1)
        np.put_along_axis(done, at, True, 1)
        near = np.where(from_ids[:, :, None] >= 0, graph[from_ids], -1).reshape(b, -1)[active]
        r = rows[active]
        near = np.where(seen[r, near], -1, near)
        # one of equals in a row
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[r, near] = True
        new = np.where(near >= 0, np.einsum("bkd,bd->bk", vectors[near], queries[active]), -np.inf)
        all_ids, all_sims = np.concatenate([ids[active], near], 1), np.concatenate([sims[active], new], 1)
        all_done = np.concatenate([done[active], near < 0], 1)
        best = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
        ids[active], sims[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))


class Graph:
    """A hierarchy over float32 vectors (rows), as flat neighbour arrays by level.

    Level l links nodes 0 .. sizes[l] - 1, so upper levels hold the first nodes.
    """

    def __init__(self, vectors, levels=None, sizes=None):
        self.vectors = vectors
        if levels is not None:
            self.levels, self.sizes = levels, sizes
            return
        n = len(vectors)
        self.sizes = [n]
        while self.sizes[-1] > 4 * M:
            self.sizes.append(max(1, self.sizes[-1] // M))
        self.levels = [None] * len(self.sizes)
        for level in reversed(range(len(self.sizes))):
            self.levels[level] = self.link(level)

    def link(self, level):
        """Insert the nodes of a level in growing batches, entering through the levels above."""
        n, width = self.sizes[level], 2 * M
        graph = np.full((n + 1, width), -1)
        done = min(n, 4 * M)
        self.insert(graph, np.arange(done), np.full((done, 1), -1), np.full((done, 1), -np.inf))
        while done < n:
            batch = np.arange(done, min(n, done + min(LOCKSTEP, done)))
            near, sims = beam(graph[: n + 1], self.vectors[:n], self.vectors[batch], self.entries(self.vectors[batch], level), EF_BUILD)
            self.insert(graph, batch, near, sims)
            done = batch[-1] + 1
        return graph

    def insert(self, graph, batch, near, sims):
        """Link a batch to what its search found and to each other, both ways."""
        v = self.vectors
        inner = v[batch] @ v[batch].T
        np.fill_diagonal(inner, -np.inf)
        take = min(M, len(batch))
        at = np.argpartition(-inner, take - 1, 1)[:, :take]
        near = np.concatenate([near, batch[at]], 1)
        sims = np.concatenate([sims, np.take_along_axis(inner, at, 1)], 1)
        chosen = pick(near, sims, v, M)
        graph[batch, :M] = chosen
        src, dst = np.repeat(batch, M), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("id,id->i", v[src], v[dst]), dst))
        src, dst = src[order], dst[order]
        nodes, first = np.unique(dst, return_index=True)
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        extra = np.full((len(nodes), graph.shape[1]), -1)
        ok = rank < graph.shape[1]
        extra[np.searchsorted(nodes, dst[ok]), rank[ok]] = src[ok]
        for i in range(0, len(nodes), 512):
            part = nodes[i : i + 512]
            cand = np.concatenate([graph[part], extra[i : i + 512]], 1)
            cand = np.sort(cand, 1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand[cand == part[:, None]] = -1
            s = np.where(cand >= 0, np.einsum("bkd,bd->bk", v[cand], v[part]), -np.inf)
            graph[part] = pick(cand, s, v, graph.shape[1])

    def entries(self, queries, level):
        """Nodes at which to enter a level; those of the top level, all compared, by nearness."""
        top = len(self.sizes) - 1
        at = np.argsort(-(queries @ self.vectors[: self.sizes[top]].T), 1, kind="stable")
        if level == top:
            return at
        at = at[:, :EF_UPPER]
        for upper in reversed(range(level + 1, top)):
            n = self.sizes[upper]
            at, _ = beam(self.levels[upper], self.vectors[:n], queries, at, EF_UPPER)
        return at

    def search(self, queries, ef):
        parts = [beam(self.levels[0], self.vectors, q, self.entries(q, 0), ef) for q in (queries[i : i + LOCKSTEP] for i in range(0, len(queries), LOCKSTEP))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def scaled(x):
    """``x`` times a power of two, exactly, with the largest component between a half and one."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def lifted(x):
    """Unit vectors, one dimension longer, whose cosine with (query, 0) orders as the inner product.

    The longest vector is the unit; rows come in bands of norm, so that none is
    so much shorter that single precision would lose its direction.
    """
    x = scaled(x)
    squares = (x**2).sum(1)
    top = squares.max()
    return (np.concatenate([x, np.sqrt(top - squares)[:, None]], 1) / np.sqrt(top)).astype(np.float32)


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; of rows alike in id the least vector."""
    x = rows.select(col(id).cast("long").alias("id"), col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    x = x.where("NOT exists(v, e -> e IS NULL OR isnan(e) OR abs(e) = double('Infinity')) AND exists(v, e -> e <> 0)")
    return x.groupBy("id").agg(F.min("v").alias("v"))


def band(v: str):
    """Binary logarithm of a vector's norm, rounded down; components are divided by the largest first, so no square overflows."""
    top = F.array_max(F.transform(v, F.abs))
    rest = F.aggregate(F.col(v), F.lit(0.0), lambda s, e: s + (e / top) * (e / top))
    return F.floor(F.log2(top) + 0.5 * F.log2(rest)).cast("int")


def top_neighbours(rows: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """The k rows of largest inner product with each query, its own id apart, as found by search.

    Rows of one band of norms, a factor of two wide, are dealt to shards of about
    SHARD_ROWS by id; equal vectors of a shard are one node with many ids.  Each shard's graph is kept as flat neighbour
    arrays in the shared folder, and blocks of queries meet every shard of their
    dimension; results are merged by rank.  Scores are inner products in double
    precision of the vectors as given, ties to the smaller id.  Vectors that
    are null or zero, or hold null or non-finite components, take no part; so
    do null ids.  Returns query_id, rank (from 1), the id as ``vec_id``, score.
    """
    rows, queries = usable(rows, id, vector), usable(queries, id, vector)
    sized = rows.groupBy(F.size("v").alias("d"), band("v").alias("band")).agg(F.count("*").alias("n")).orderBy("d", "band").collect()
    # shards of a dimension are numbered through its bands: (first, number) by dimension and band, and all by dimension
    bands, shards = {}, {}
    for r in sized:
        first = shards.get(r["d"], 0)
        bands[f"{r['d']}:{r['band']}"] = (first, math.ceil(r["n"] / SHARD_ROWS))
        shards[r["d"]] = first + math.ceil(r["n"] / SHARD_ROWS)
    n_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    mapped = lambda table, kind: F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v))) if table else F.lit(None).cast(kind)
    where = F.concat(F.size("v").cast("string"), F.lit(":"), band("v").cast("string"))
    first, number = (F.try_element_at(mapped({k: v[i] for k, v in bands.items()}, "map<string,int>"), where) for i in (0, 1))
    placed = rows.select(F.size("v").alias("d"), (first + F.pmod(F.xxhash64("id"), number)).alias("shard"), "id", "v")

    def build(table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").combine_chunks().values).reshape(len(table), -1)
        ids = np.array(table.column("id"))
        order = np.argsort(ids)
        nodes, first, inverse = np.unique(x[order], axis=0, return_index=True, return_inverse=True)
        mixed = np.random.default_rng(7).permutation(len(nodes))
        place = np.empty(len(nodes), int)
        place[mixed] = np.arange(len(nodes))
        nodes, member = nodes[mixed], place[inverse.ravel()]
        by = np.argsort(member, kind="stable")
        graph = Graph(lifted(nodes))
        blob = lambda a, t: np.ascontiguousarray(a, t).tobytes()
        row = {"d": table.column("d")[0].as_py(), "shard": table.column("shard")[0].as_py(), "nodes": blob(nodes, "<f8"), "ids": blob(ids[order][by], "<i8"), "edge": blob(np.searchsorted(member[by], np.arange(len(nodes) + 1)), "<i4"), "sizes": graph.sizes, "links": [blob(g, "<i4") for g in graph.levels]}
        return pa.Table.from_pylist([row], index_arrow)

    index_arrow = pa.schema([("d", pa.int32()), ("shard", pa.int64()), ("nodes", pa.binary()), ("ids", pa.binary()), ("edge", pa.binary()), ("sizes", pa.list_(pa.int32())), ("links", pa.list_(pa.binary()))])
    index = placed.groupBy("d", "shard").applyInArrow(build, "d int, shard long, nodes binary, ids binary, edge binary, sizes array<int>, links array<binary>")
    index = shared_table(index)
    out_arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out_arrow.empty_table()
        row = left.to_pylist()[0]
        nodes = np.frombuffer(row["nodes"], "<f8").reshape(-1, row["d"])
        ids, edge = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["edge"], "<i4")
        levels = [np.frombuffer(b, "<i4").reshape(n + 1, -1) for n, b in zip(row["sizes"], row["links"])]
        graph = Graph(lifted(nodes), levels, row["sizes"])
        q = np.array(right.column("v").combine_chunks().values).reshape(len(right), -1)
        asked = np.array(right.column("id"))
        unit = q / np.abs(q).max(1)[:, None]
        unit /= np.sqrt((unit**2).sum(1))[:, None]
        found, _ = graph.search(np.concatenate([unit, np.zeros((len(q), 1))], 1).astype(np.float32), max(ef, k + 1))
        out = [[], [], []]
        for i in range(len(q)):
            near = found[i][found[i] >= 0]
            scores = nodes[near] @ q[i]
            # a node's ids are sorted, so k + 1 of them are enough
            n = np.minimum(edge[near + 1] - edge[near], k + 1)
            member = np.repeat(edge[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, s = ids[member], np.repeat(scores, n)
            who, s = who[who != asked[i]], s[who != asked[i]]
            best = np.lexsort((who, -s))[:k]
            out[0].append(np.full(len(best), asked[i]))
            out[1].append(who[best])
            out[2].append(s[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(x), t.type) for x, t in zip(out, out_arrow)], schema=out_arrow)

    blocks = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    asked = queries.withColumn("d", F.size("v")).withColumn("s", F.try_element_at(mapped(shards, "map<int,int>"), F.col("d"))).where("s IS NOT NULL").select("d", "id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - F.lit(1).cast("long"))).alias("shard"))
    found = blocks.groupBy("d", "shard", "block").cogroup(asked.groupBy("d", "shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
