"""Jaccard self-join of word shingles by chosen paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import components, discard, fresh, materialize
from signalframe.llm.tokens import ODD, mix, shingle_sets, slices

SETS = "row binary, doc_id {id}, set_key binary, n long, sketch binary"
ROWS = "path long, run int, key long, sketch binary"
EDGES = "a long, b long, run int"


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of the SHA-256 of a row's id and text; rows that share them are the same row repeated."""
    content = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.when(F.col(id_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(text_col), F.lit("")))
    return F.unhex(F.substring(F.sha2(content, 256), 1, 32))


def sketched(source: DataFrame, id_type: str, words: int, sketch: int) -> DataFrame:
    """row, doc_id, the digest of its shingle set, the set's size and 32 bits of each of its `sketch` smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, 2):
                sets = list(shingle_sets(data, offsets, words))
                columns = [pa.array([sha256(x).digest()[:16] for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[:sketch].astype(np.uint32).tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names=["row", "doc_id", "set_key", "n", "sketch"])

    return source.mapInArrow(run, SETS.format(id=id_type))


def choose(rows: DataFrame, runs: range | None, branches: float) -> DataFrame:
    """Follow each row's path by the tokens of its sketch that the path samples, about `branches` of them.

    Rows of one path sample alike, so sets that share a sampled token stay together. At the root, `runs` are the numbers
    of the independent runs to start; further down a row goes on in its own run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            index, found, of = [], [], []
            for i, (path, number, raw) in enumerate(zip(paths, batch.column(1).to_pylist(), batch.column(3), strict=True)):
                tokens = np.frombuffer(raw.as_py(), np.uint32).astype(np.uint64)
                share = min(1.0, branches / max(1, len(tokens)))
                numbers = np.array([number] if runs is None else runs, np.int32)
                starts = mix(path + numbers.astype(np.uint64) * ODD + ODD)
                new = mix(mix(tokens * ODD)[None, :] ^ starts[:, None])
                hit = (new >> np.uint64(11)) < np.uint64(share * 2**53) if share < 1 else np.ones(new.shape, bool)
                found.append(mix(new[hit] * ODD))
                of.append(numbers[np.nonzero(hit)[0]])
                index.append(np.full(len(found[-1]), i))
            if index:
                take = pa.array(np.concatenate(index))
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(of)), batch.column(2).take(take), batch.column(3).take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "run", "key", "sketch"])

    return rows.select("path", "run", "key", "sketch").mapInArrow(run, ROWS)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(links)
    left, out = np.ones(n, bool), []
    for root in np.flatnonzero(links.any(1)).tolist():
        if left[root]:
            left[root] = False
            queue = [root]
            while queue:
                at = queue.pop()
                near = np.flatnonzero(links[at] & left)
                left[near] = False
                out += [(at, int(x)) for x in near]
                queue += near.tolist()
    return out


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of rows with each of columns (rows again if None), `width` tokens at a time."""
    sides = [rows] if columns is None else [rows, columns]
    flat = [np.concatenate(side) for side in sides]
    if columns is None:
        token, count = np.unique(flat[0], return_counts=True)
        shared = token[count > 1]
    else:
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(rows), len(sides[-1])), np.float32)
    if not len(shared):
        return out
    placed = []
    for side, tokens in zip(sides, flat, strict=True):
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        keep = shared[at] == tokens
        at, owner = at[keep], np.repeat(np.arange(len(side)), [len(x) for x in side])[keep]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], owner[order], len(side)))
    for a in range(0, len(shared), width):
        parts = []
        for at, owner, n in placed:
            lo, hi = np.searchsorted(at, (a, a + width))
            part = np.zeros((n, min(width, len(shared) - a)), np.float32)
            part[owner[lo:hi], at[lo:hi] - a] = 1
            parts.append(part)
        out += parts[0] @ parts[-1].T
    return out


def likely(buckets: DataFrame, packs: int, least: float) -> DataFrame:
    """Edges (a, b, run) that join, within each bucket (path), the sets whose sketches overlap by `least` or more: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        paths, keys, runs = (table.column(c).to_numpy() for c in ("path", "key", "run"))
        order = np.argsort(paths, kind="stable")
        sketches = table.column("sketch").to_pylist()
        seen: set[tuple[int, int, int]] = set()
        for members in np.split(order, np.flatnonzero(np.diff(paths[order])) + 1):
            sets = [np.frombuffer(sketches[i], np.uint32) for i in members]
            size = np.array([len(x) for x in sets], np.float32)
            inter = overlaps(sets)
            links = inter >= least * (size[:, None] + size[None, :] - inter)
            np.fill_diagonal(links, False)
            for i, j in forest(links):
                a, b = sorted((int(keys[members[i]]), int(keys[members[j]])))
                if a != b:
                    seen.add((a, b, int(runs[members[0]])))
        return pa.table({c: pa.array([x[i] for x in seen], k) for i, (c, k) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("run", pa.int32())))})

    return buckets.withColumn("pack", F.pmod(F.xxhash64("path"), F.lit(packs))).groupBy("pack").applyInArrow(run, EDGES)


def against_pivot(big: DataFrame, bucket: int) -> DataFrame:
    """Rows of paths with many sets, each with its path's pivot and the overlap of the two sketches.

    The pivot is the set of the least hash, so the paths of one group of near copies, in all runs, mostly have the same one.
    The sets of a path are dealt to slices of about `bucket`, and each slice gets a copy of the pivot, so no task joins a whole path.
    """
    pivots = big.groupBy("path").agg(F.min(F.struct(F.xxhash64("key"), "key", "sketch")).alias("pivot"), F.sequence(F.lit(0).cast("long"), F.ceil(F.first("sets") / bucket) - 1).alias("slices"))
    pivots = pivots.select(F.col("path").alias("_path"), F.col("pivot.key").alias("pivot"), F.col("pivot.sketch").alias("with"), F.explode("slices").alias("_slice"))
    schema = "path long, run int, key long, sketch binary, sets long, pivot long, overlap double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for own, other in zip(batch.column(3), batch.column(6), strict=True):
                a, b = np.unique(np.frombuffer(own.as_py(), np.uint32)), np.unique(np.frombuffer(other.as_py(), np.uint32))
                both = len(np.intersect1d(a, b, assume_unique=True))
                shares.append(both / max(1, len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(shares, pa.float64())], names=["path", "run", "key", "sketch", "sets", "pivot", "overlap"])

    own_slice = F.pmod(F.xxhash64("key"), F.ceil(F.col("sets") / bucket))
    return big.join(pivots, (F.col("path") == F.col("_path")) & (own_slice == F.col("_slice"))).select("path", "run", "key", "sketch", "sets", "pivot", "with").mapInArrow(run, schema)


def tiled(rows: DataFrame, bucket: int) -> DataFrame:
    """The rows of each path dealt to tiles of about `bucket` sets, and each tile to its pairs with all tiles of the path."""
    tiles = F.ceil(F.col("sets") / bucket).cast("int")
    dealt = rows.withColumns({"tile": F.pmod(F.xxhash64("key"), tiles), "other": F.explode(F.sequence(F.lit(0), tiles - 1))})
    return dealt.select(F.xxhash64("path", F.least("tile", "other"), F.greatest("tile", "other")).alias("path"), "run", "key", "sketch")


def run_edges(sets: DataFrame, runs: range, branches: float, bucket: int, most_tiles: int, depth: int, least: float) -> list[DataFrame]:
    """Materialized edges (a, b, run) between sets (key, sketch) whose sketches are alike, from some runs of the recursion.

    run is -1 where the sketches overlap by less than `least`, as those of a set and a pivot may.

    A path with one set ends. A path with up to `bucket` sets is compared by brute force. In a larger one all sets are
    first compared with a pivot. Those whose sketches overlap it by link = least / 2 are joined to it; `far` is the largest
    overlap of the others. 1 - overlap is a distance, so a set that overlaps the pivot by more than far + 1 - least overlaps
    none of the others by `least`: it ends here, and so does a path without others. Of the rest, paths of up to most_tiles
    buckets are compared in pairs of tiles and larger ones are split again, up to `depth` times; what is left then is
    compared in pairs of tiles too, so no case is dropped.
    """
    link, out = least / 2, []
    rows = sets.select(F.lit(0).cast("long").alias("path"), F.lit(0).alias("run"), "key", "sketch")
    done: list[DataFrame] = []
    for level in range(1, depth + 1):
        paths = choose(rows, runs if level == 1 else None, branches)
        paths = materialize(paths.drop("sketch") if level == 1 else paths)
        discard(*done)
        sizes = paths.groupBy("path").agg(F.count("*").alias("sets")).where("sets > 1")
        part = paths.join(sizes, "path")
        part = materialize(part.join(sets, "key") if level == 1 else part)
        discard(paths)
        small, most = part.agg(F.count_if(F.col("sets") <= bucket), F.max("sets")).first()
        if small:
            out.append(materialize(likely(part.where(F.col("sets") <= bucket), -(-small // 8000), least)))
        if (most or 0) <= bucket:
            discard(part)
            return out
        judged = materialize(against_pivot(part.where(F.col("sets") > bucket), bucket))
        discard(part)
        alike = F.when(F.col("overlap") >= least, F.col("run")).otherwise(-1)
        out.append(materialize(judged.where((F.col("overlap") >= link) & (F.col("key") != F.col("pivot"))).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"), alike.alias("run"))))
        others = judged.where(F.col("overlap") < link).groupBy("path").agg(F.max("overlap").alias("far"))
        rows = materialize(judged.join(others, "path").where(F.col("overlap") <= F.col("far") + (1 - least)).select("path", "run", "key", "sketch", "sets"))
        discard(judged)
        ending = rows if level == depth else rows.where(F.col("sets") <= most_tiles * bucket)
        volume = ending.agg(F.sum(F.ceil(F.col("sets") / bucket))).first()[0]
        if volume:
            out.append(materialize(likely(tiled(ending, bucket), -(-volume // 8000), least)))
        rows, done = rows.where(F.col("sets") > most_tiles * bucket), [rows]
        if most <= most_tiles * bucket or level == depth:
            discard(*done)
            return out
    return out


def missed(edges: DataFrame) -> float:
    """Estimated share of the sets with an edge that no run has found, from how many runs found each (Chao's lower bound)."""
    runs = F.bit_or(F.expr("shiftleft(1L, run)"))
    pairs = edges.where("run >= 0").groupBy("a", "b").agg(runs.alias("runs"))
    found = pairs.select("a", "runs").union(pairs.select("b", "runs")).groupBy("a").agg(F.bit_count(F.bit_or("runs")).alias("n"))
    seen, once, twice = found.agg(F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    unseen = once * once / (2 * twice) if twice else once * (once - 1) / 2
    return unseen / max(1, seen + unseen)


def candidate_edges(sets: DataFrame, runs: int, recall: float, branches: float, bucket: int, most_tiles: int, depth: int, least: float, most_batches: int = 8) -> list[DataFrame]:
    """Edges of batches of `runs` runs, repeated until the estimated share of the sets found reaches `recall`."""
    out: list[DataFrame] = []
    for batch in range(most_batches):
        out += run_edges(sets, range(batch * runs, (batch + 1) * runs), branches, bucket, most_tiles, depth, least)
        if not out or missed(reduce(DataFrame.union, out)) <= 1 - recall:
            return out
    raise RuntimeError(f"the recall of {recall} is not reached after {most_batches * runs} runs")


def verified(members: DataFrame, packs: int, threshold: float) -> DataFrame:
    """Rows (a, b, links) from groups (pair of tiles of a candidate component): links of a set (b null) and forests of links."""

    def run(table: pa.Table) -> pa.Table:
        groups = table.column("group").to_numpy()
        order = np.argsort(groups, kind="stable")
        keys, tiles, copies = (table.column(c).to_numpy() for c in ("key", "tile", "copies"))
        raw = table.column("shingles")
        cross = table.column("cross").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            first = tiles[at] == tiles[at].min()
            sides = [at[first], at[~first]] if cross[at[0]] else [at]
            sets = [[np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in side] for side in sides]
            if not all(sets):
                continue
            size = [np.array([len(x) for x in side], np.float64) for side in sets]
            inter = overlaps(*sets).astype(np.float64)
            links = inter >= threshold * (size[0][:, None] + size[-1][None, :] - inter) - 1e-9
            if len(sides) == 1:
                np.fill_diagonal(links, False)
                square, nodes = links, at
            else:
                nodes = np.concatenate(sides)
                n = len(sides[0])
                square = np.zeros((len(nodes), len(nodes)), bool)
                square[:n, n:], square[n:, :n] = links, links.T
            total = square @ copies[nodes].astype(np.float64)
            out += [(int(keys[nodes[i]]), None, int(total[i])) for i in np.flatnonzero(total)]
            out += [(int(keys[nodes[i]]), int(keys[nodes[j]]), 0) for i, j in forest(square)]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("a", "b", "links"))})

    return members.withColumn("pack", F.pmod(F.xxhash64("group"), F.lit(packs))).groupBy("pack").applyInArrow(run, "a long, b long, links long")


def shingles_of(texts: DataFrame, words: int) -> DataFrame:
    """The columns of texts with the sorted shingle hashes in place of text, which comes last."""
    names = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch, len(names)):
                sets = pa.array([x.tobytes() for x in shingle_sets(data, offsets, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(names))], sets], names=[*names, "shingles"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], "shingles binary"]))


def members_of(source: DataFrame, classes: DataFrame, groups: DataFrame, words: int, tile: int, tile_shingles: int) -> DataFrame:
    """The sets of each candidate component with their shingles, once, and their tile: about `tile` sets and tile_shingles shingles at most."""
    placed = groups.select(F.col("node").alias("key"), "component").join(classes.select("key", "n", "copies", F.col("first.row").alias("row")), "key")
    sized = placed.groupBy("component").agg(F.count("*").alias("sets"), F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(tile_shingles) / F.avg("n")))).cast("long").alias("tile_sets"))
    tiles = F.ceil(F.col("sets") / F.col("tile_sets"))
    wanted = placed.join(sized, "component").select("row", "key", "component", "copies", F.pmod(F.xxhash64("key"), tiles).alias("tile"), tiles.alias("tiles"))
    texts = source.select("row", "text").join(wanted, "row").dropDuplicates(["key"]).select("key", "component", "tile", "tiles", "copies", "text")
    return shingles_of(texts, words)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.99,
    runs: int = 6, branches: float = 2.0, bucket: int = 1024, most_tiles: int = 8, depth: int = 4, sketch: int = 128, tile: int = 2048, tile_shingles: int = 1 << 21,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_links, kept, row (see row_key).

    Two documents are linked when the Jaccard similarity of their sets of `words`-word shingles is `threshold` or more.
    A class is a connected component of links; class_id is its smallest id, and that document is the one kept.
    n_links counts the other documents that a document is linked to, copies included.

    Documents of one shingle set are one set in the join. Each run of the chosen-path recursion samples about `branches`
    shared tokens of a set's sketch (its smallest hashes) at each level, so a pair at the threshold meets in a run with
    probability of at least 0.7. Batches of `runs` runs are repeated until the estimated share of linked sets found reaches
    `recall` (see missed). Sketches only choose the candidate components; a link is decided by the whole sets, each of
    which is fetched once. Components larger than a tile are compared in pairs of tiles.

    A text without a word (or null) has no links. A text of fewer than `words` words has one shingle. Rows that repeat
    an id with the same text are counted as copies and kept or not kept alike; rows that repeat an id with another text are
    documents of their own. Null ids come last. Empty input gives no rows. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(sketched(source, id_type, words, sketch))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    classes = sets.where("n > 0").groupBy("set_key").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()))
    edges = candidate_edges(classes.select("key", "sketch"), runs, recall, branches, bucket, most_tiles, depth, sketch_least(threshold))
    none = docs.sparkSession.createDataFrame([], EDGES)
    groups = components(reduce(DataFrame.union, edges, none))
    discard(*edges)
    members = materialize(members_of(source, classes, groups, words, tile, tile_shingles))
    discard(groups)
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select(F.xxhash64("component", low, high).alias("group"), "key", "tile", "copies", "shingles", (low != high).alias("cross"))
    volume = members.agg(F.sum(F.octet_length("shingles") * F.col("tiles"))).first()[0] or 0
    judged = materialize(verified(dealt, max(1, -(-volume // (8 << 20))), threshold))
    discard(members)
    found = components(judged.where("b is not null").select("a", "b"))
    linked = judged.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    per_set = classes.select("set_key", "key", "copies", "first").join(linked, "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    total = per_set.groupBy("component").agg(F.min("first").alias("top"), F.sum("copies").alias("class_size"))
    per_set = materialize(per_set.join(total, "component").select("set_key", "top", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(classes, judged, found)
    alone = F.col("n") == 0
    return sets.select("row", "doc_id", "set_key", "n").join(per_set, "set_key", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"),
        "row",
    )


def sketch_least(threshold: float) -> float:
    """Overlap of two sketches below which their sets cannot plausibly reach the threshold: well under what the worst shape gives."""
    return max(0.1, threshold * threshold - 0.14)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; rows are told apart by id and text."""
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    dropped = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("row").alias(gone)).distinct()
    return docs.withColumn(row, row_key(id_col, text_col)).join(dropped, F.col(row) == F.col(gone), "left_anti").drop(row)
