"""Nearest neighbours by cosine: robust-pruned directed graphs over shards of the vectors, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import discard, materialize

K = 5
#: Distinct vectors of a shard, links of a node, width of the beam while building and searching, and how much longer than a detour a link may be.
SHARD_VECTORS, DEGREE, BEAM, SEARCH_BEAM, ALPHA = 8192, 24, 48, 128, 1.2
#: Points that are inserted, pruned or searched together, and queries of one search task.
TOGETHER, QUERY_BLOCK = 256, 8192


def usable(vector: Column) -> Column:
    """Whether a vector is there, has only finite entries, and one that is not zero."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; entries are first brought near 1 by a power of two, so that no square over- or underflows."""
    _, power = np.frexp(np.abs(vectors).max(1, keepdims=True))
    near = np.ldexp(vectors, -power)
    return near / np.sqrt((near**2).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a and the same row of b, in double precision."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


# --- one shard's graph ---------------------------------------------------------------------------------------------


def greedy(unit: np.ndarray, links: np.ndarray, entries: np.ndarray, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all targets together: (nearest nodes, those looked at in order), padded with -1.

    From the entries on, the nearest node of the beam not yet looked at offers its links, until all of a beam have been.
    """
    m = len(targets)
    live = np.arange(m)
    near = 1 - targets @ unit[entries].T
    found = np.tile(entries, (m, 1))
    met = np.zeros((m, len(unit)), bool)
    met[:, entries] = True
    if found.shape[1] > beam:
        best = np.argsort(near, 1)[:, :beam]
        found, near = np.take_along_axis(found, best, 1), np.take_along_axis(near, best, 1)
    pad = beam - found.shape[1]
    found = np.pad(found, ((0, 0), (0, pad)), constant_values=-1)
    near = np.pad(near, ((0, 0), (0, pad)), constant_values=np.inf)
    ahead = near.copy()  # infinite where a node has been looked at
    looked: list[np.ndarray] = []
    while True:
        at = ahead[live].argmin(1)
        on = np.isfinite(ahead[live, at])
        live, at = live[on], at[on]
        if not len(live):
            break
        node = found[live, at]
        ahead[live, at] = np.inf
        step = np.full(m, -1)
        step[live] = node
        looked.append(step)
        offered = links[node]
        far = 1 - np.matmul(unit[offered], targets[live][:, :, None])[:, :, 0]
        far[(offered < 0) | met[live[:, None], offered]] = np.inf
        who, slot = np.nonzero(offered >= 0)
        met[live[who], offered[who, slot]] = True
        dist = np.hstack([near[live], far])
        best = np.argpartition(dist, beam - 1, 1)[:, :beam]
        near[live] = np.take_along_axis(dist, best, 1)
        found[live] = np.take_along_axis(np.hstack([found[live], offered]), best, 1)
        ahead[live] = np.take_along_axis(np.hstack([ahead[live], far]), best, 1)
    return np.where(np.isfinite(near), found, -1), np.stack(looked, 1) if looked else np.empty((m, 0), np.int64)


def pruned(unit: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` links of each node from its candidates (-1 pads): the nearest stays, and drops those to which it is a short detour.

    A candidate goes when alpha times its distance from a kept one is no more than its distance from the node.
    """
    out = np.full((len(nodes), degree), -1)
    for at in range(0, len(nodes), TOGETHER):
        p, c = nodes[at : at + TOGETHER], candidates[at : at + TOGETHER]
        order = np.sort(c, 1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        c = np.where(order == p[:, None], -1, order)
        points = unit[c]
        own = np.sqrt(np.maximum(2 - 2 * np.einsum("md,mcd->mc", unit[p], points), 0))
        own[c < 0] = np.inf
        between = np.sqrt(np.maximum(2 - 2 * points @ points.transpose(0, 2, 1), 0))
        rows = np.arange(len(p))
        for slot in range(degree):
            best = own.argmin(1)
            there = np.isfinite(own[rows, best])
            if not there.any():
                break
            out[at + rows[there], slot] = c[rows, best][there]
            gone = alpha * between[rows, best] <= own
            gone[rows, best] = True
            own[gone & there[:, None]] = np.inf
    return out


def graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of a directed graph over the vectors: the first entry is the one nearest to the mean, every node can be reached.

    Points are inserted in a fixed random order, in groups that double, twice: first without, then with relaxed pruning. Each is searched
    for, takes its pruned links from what the search looked at, and offers itself to these, which are pruned when full. Whatever cannot be
    reached from the entries in the end becomes an entry too.
    """
    unit = units(vectors).astype(np.float32)
    n = len(unit)
    room = 2 * degree
    links = np.full((n, room), -1)
    entries = np.array([(unit @ unit.mean(0)).argmax()])
    order = np.random.default_rng(n).permutation(n)
    for strict in (1.0, alpha):
        begin, size = 0, 1 if strict == 1.0 else TOGETHER
        while begin < n:
            batch = order[begin : begin + size]
            begin, size = begin + size, min(2 * size, TOGETHER)
            _, looked = greedy(unit, links, entries, unit[batch], beam)
            links[batch, :degree] = pruned(unit, batch, np.hstack([looked, links[batch]]), degree, strict)
            links[batch, degree:] = -1
            source, goal = np.repeat(batch, degree), links[batch, :degree].ravel()
            source, goal = source[goal >= 0], goal[goal >= 0]
            have = (links[goal] == source[:, None]).any(1)
            source, goal = source[~have], goal[~have]
            by = np.argsort(goal, kind="stable")
            source, goal = source[by], goal[by]
            hubs, first, many = np.unique(goal, return_index=True, return_counts=True)
            offered = np.full((len(hubs), many.max(initial=0)), -1)
            offered[np.repeat(np.arange(len(hubs)), many), np.arange(len(goal)) - np.repeat(first, many)] = source
            links[hubs] = -np.sort(-np.where(links[hubs] < 0, -1, links[hubs]), 1)
            used = (links[hubs] >= 0).sum(1)
            fits = used + many <= room
            to, slot = np.nonzero(offered[fits] >= 0)
            links[hubs[fits][to], used[fits][to] + slot] = offered[fits][to, slot]
            full = hubs[~fits]
            links[full, :degree] = pruned(unit, full, np.hstack([links[full], offered[~fits]]), degree, strict)
            links[full, degree:] = -1
    reached = np.zeros(n, bool)
    edge = entries
    while True:
        while len(edge):
            reached[edge] = True
            edge = np.unique(links[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
        if reached.all():
            return links, entries
        edge = np.array([np.flatnonzero(~reached)[0]])
        entries = np.append(entries, edge)


# --- Spark ---------------------------------------------------------------------------------------------------------


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part; entries are doubles, and -0.0 is 0.0."""
    vector = F.transform(vector_col, lambda c: c.cast("double") + 0.0)
    return rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))


def index(vectors: DataFrame, members: int = K + 1, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """A materialized table of graphs over all of `vectors` (vec_id, v): one row (dims, shard, node, v, ids, links, entry) per distinct vector.

    ids are the `members` least ids of the rows that hold the vector, nulls last: enough for as many neighbours. The window that
    finds them is limited before its shuffle, so a vector of a third of all rows sends a few rows per task. Vectors are dealt by
    hash to shards of about shard_vectors, and each shard's graph is built by one task from its vectors alone.
    """
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    least = vectors.withColumn("at", F.row_number().over(order)).where(F.col("at") <= members)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "vec_id"))), lambda m: m["vec_id"])
    nodes = materialize(least.groupBy("v").agg(ids.alias("ids")).withColumn("dims", F.size("v")))
    shards = max(1, -(-nodes.count() // shard_vectors))

    def build(table: pa.Table) -> pa.Table:
        links, entries = graph(matrix(table.column("v")))
        entry = np.zeros(len(links), bool)
        entry[entries] = True
        lists = pa.array([row[row >= 0] for row in links], pa.list_(pa.int32()))
        return table.append_column("node", pa.array(np.arange(len(links), dtype=np.int32))).append_column("links", lists).append_column("entry", pa.array(entry))

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(2 * shards, "dims", "shard")
    table = materialize(dealt.groupBy("dims", "shard").applyInArrow(build, "v array<double>, ids array<long>, dims int, shard int, node int, links array<int>, entry boolean"))
    discard(nodes)
    return table


def search(table: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row of `queries` (key long, v) the k best vectors of each shard of an index: key, score, ids.

    Blocks of queries meet shards: a task holds one graph and one block, so neither side grows with the tables. The beam's vectors are
    scored anew in double precision; the best go on, ties to the smaller least id, nulls last.
    """
    shards = table.select("dims", "shard").distinct()
    n_shards = shards.count()
    blocks = max(1, -(-queries.count() // query_block))
    if not n_shards:
        return table.sparkSession.createDataFrame([], "key long, score double, ids array<long>")

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        keys, scores, members = [], [], []
        if shard.num_rows and block.num_rows:
            shard = shard.sort_by("node")
            vectors, targets = matrix(shard.column("v")), matrix(block.column("v"))
            unit, wanted = units(vectors).astype(np.float32), units(targets).astype(np.float32)
            lists = shard.column("links").combine_chunks()
            many = np.diff(lists.offsets.to_numpy())
            links = np.full((len(vectors), max(1, many.max())), -1)
            links[np.arange(links.shape[1]) < many[:, None]] = lists.flatten().to_numpy()
            entries = np.flatnonzero(shard.column("entry").to_numpy())
            ids = shard.column("ids").to_pylist()
            least = np.array([np.iinfo(np.int64).max if i[0] is None else i[0] for i in ids])
            for at in range(0, len(targets), TOGETHER):
                found, _ = greedy(unit, links, entries, wanted[at : at + TOGETHER], beam)
                who, slot = np.nonzero(found >= 0)
                node = found[who, slot]
                score = cosines(targets[at + who], vectors[node])
                order = np.lexsort((least[node], -score, who))
                who, node, score = who[order], node[order], score[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                best = place < k
                keys.append(block.column("key").take(pa.array(at + who[best])).to_numpy())
                scores.append(score[best])
                members += [ids[x] for x in node[best].tolist()]
        empty = [np.empty(0)]
        return pa.table({"key": pa.array(np.concatenate(keys or empty), pa.int64()), "score": pa.array(np.concatenate(scores or empty), pa.float64()), "ids": pa.array(members, pa.list_(pa.int64()))})

    tile, tasks = ["dims", "shard", "block"], 2 * n_shards * blocks
    left = table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *tile)
    asked = queries.select("key", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(table.agg(F.max("shard")).first()[0])))).repartition(tasks, *tile)
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, "key long, score double, ids array<long>")


def nearest(rows: DataFrame, wanted: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """The k nearest other rows by cosine of each row of `rows` for which `wanted` (over vec_id) holds: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller vec_id (nulls last); fewer than k where there are fewer other rows. Score is the cosine of the
    original vectors in double precision. The index holds every row; its searches are approximate (recall in README), but
    shards no larger than the beam are searched whole.

    Vectors that are null or zero or hold null or non-finite entries take no part. Vectors of different lengths do not meet.
    Equal vectors are one node of a graph, whatever their number; a query leaves out itself, not other rows of its id or vector. Rows
    repeated with id and vector are queries of their own with equal rows. A null id is never a query. An empty table gives no rows.
    """
    vectors = clean(rows, id_col, vector_col)
    asked = materialize(vectors.where(wanted).withColumn("key", F.monotonically_increasing_id()))
    found = search(index(vectors, k + 1), asked, k + 1)
    own = asked.select("key", F.col("vec_id").alias("query_id"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.expr("ids[0]").asc_nulls_last())
    few = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).join(own, "key")
    exact = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node", "pos"))
    each = few.select("key", "query_id", "score", F.col("at").alias("node"), F.posexplode("ids").alias("pos", "vec_id"))
    itself = F.row_number().over(Window.partitionBy("key", F.col("vec_id") == F.col("query_id")).orderBy(F.desc("score"), "node", "pos"))
    others = each.withColumn("itself", itself).where(~(F.coalesce(F.col("vec_id") == F.col("query_id"), F.lit(False)) & (F.col("itself") == 1)))
    return others.withColumn("rank", exact).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
