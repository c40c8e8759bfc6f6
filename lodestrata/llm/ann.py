"""Most similar vectors for every vector: robust-pruned directed graphs in shards, searched with beams.

Vectors go to the shard of their nearest centre and are searched for in the shards of their nearest few. In a shard a directed graph is built
by insertion: a greedy search proposes neighbours, relaxed distance pruning keeps diverse ones, edges are also added backwards. A beam search
over that graph answers each query. Equal vectors are one node, however many rows they have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import Scratch, materialize

K = 5
DIM = 64
#: Edges of a node, width of the beam, nodes opened at once, and the relaxation of the pruning.
DEGREE, BEAM, OPENED, ALPHA = 16, 24, 8, 1.2
#: Vectors of a shard, about, and the most of a batch of insertions.
SHARD, BATCH = 1_200, 256
#: Centres are fitted on a sample of so many vectors each. They come in two levels, some sqrt(n) of each: those of the upper level are fitted
#: in the driver, those below one of them in a task. There are no more than MOST_CELLS, 64 MB of centres of 64 values, which go to the tasks;
#: beyond that shards grow, which their graphs are for.
PER_CELL, MOST_CELLS, LEAST_SAMPLE = 32, 262_144, 8_192
#: Upper cells whose lower cells are looked at for a vector, at least.
LOOKED = 16
PROBES = 2
#: A cell of more than so many shards, which only vectors can fill that no centre tells apart, is split by hash, and all its shards are searched.
SPLIT = 32
#: Where all neighbours count, not only the very similar ones: vectors of a shard, and the cells searched at least.
WIDE_SHARD, LEAST_PROBES = 4_800, 8
SEED = 5

# --- the graph of one shard ------------------------------------------------------------------------------------------------------------------


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int = BEAM, opened_at_once: int = OPENED) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query, best first, with their similarities. ``x`` has one row more than nodes: the node that is none.

    All queries go on together: each opens its best nodes that aren't opened, looks at their edges' ends that it hasn't seen, and keeps the best.
    It ends when everything in its beam has been opened.
    """
    none, b = len(x) - 1, len(queries)
    ids = np.full((b, beam), none, np.int32)
    sims = np.full((b, beam), -2, np.float32)
    seen = np.zeros((b, none + 1), bool)
    seen[:, none] = True
    opened = np.zeros((b, beam), bool)
    fresh, rows = starts.astype(np.int32), np.arange(b)
    while len(rows):
        new = np.where(seen[rows[:, None], fresh], none, fresh)
        seen[rows[:, None], new] = True
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = none
        new.sort(axis=1)
        new = new[:, : int((new < none).sum(axis=1).max(initial=0))]
        if new.shape[1]:
            found = np.matmul(x[new], queries[rows][:, :, None])[:, :, 0]
            found[new == none] = -2
            all_sims = np.concatenate([sims[rows], found], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new], axis=1), order, axis=1)
            sims[rows] = np.take_along_axis(all_sims, order, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros(new.shape, bool)], axis=1), order, axis=1)
        waiting = ~opened[rows] & (sims[rows] > -2)
        pick = waiting & (np.cumsum(waiting, axis=1) <= opened_at_once)
        goes_on = pick.any(axis=1)
        rows, pick = rows[goes_on], pick[goes_on]
        if len(rows):
            opened[rows] |= pick
            at = np.argsort(~pick, axis=1, kind="stable")[:, :opened_at_once]
            from_ = np.where(np.take_along_axis(pick, at, axis=1), np.take_along_axis(ids[rows], at, axis=1), none)
            fresh = edges[from_].reshape(len(rows), -1)
    return ids, sims


def robust_prune(x: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (best first): the nearest stays, and those drop out that are ``alpha`` times nearer to it."""
    none, b = len(x) - 1, len(candidates)
    v = x[candidates]
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    alive, out, each = candidates < none, np.full((b, degree), none, np.int32), np.arange(b)
    for k in range(degree):
        best = alive.argmax(axis=1)
        some = alive[each, best]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[each, best], none)
        alive &= alpha * between[each, best] > 1 - sims
        alive[each, best] = False
    return out


def build_graph(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(x, edges, entry) of the graph over unit vectors, inserted in growing batches in seeded order."""
    n = len(vectors)
    x = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    order = np.random.default_rng(seed).permutation(n)
    edges = np.full((n + 1, DEGREE), n, np.int32)
    entry, done = int(order[0]), 1
    while done < n:
        new = order[done : done + min(done, BATCH)]
        ids, sims = beam_search(x, edges, x[new], np.full((len(new), 1), entry))
        edges[new] = kept = robust_prune(x, ids, sims)
        back, ends = np.repeat(new, DEGREE), kept.ravel()
        back, ends = back[ends < n], ends[ends < n]
        by = np.argsort(ends, kind="stable")
        node, start, count = np.unique(ends[by], return_index=True, return_counts=True)
        more = np.full((len(node), int(count.max())), n, np.int32)
        more[np.repeat(np.arange(len(node)), count), np.arange(len(by)) - np.repeat(start, count)] = back[by]
        both = np.sort(np.concatenate([edges[node], more], axis=1), axis=1)
        full = both[:, DEGREE] < n
        edges[node[~full]] = both[~full, :DEGREE]
        if full.any():
            much = both[full]
            much = much[:, : int((much < n).sum(axis=1).max())]
            near = np.matmul(x[much], x[node[full]][:, :, None])[:, :, 0]
            near[much == n] = -2
            best = np.argsort(-near, axis=1, kind="stable")
            edges[node[full]] = robust_prune(x, np.take_along_axis(much, best, axis=1), np.take_along_axis(near, best, axis=1))
        done += len(new)
    return x, edges, entry


# --- Spark -----------------------------------------------------------------------------------------------------------------------------------


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors). Null, all-zero, non-finite vectors and those of another length have no direction."""
    column = column.cast(pa.list_(pa.float32()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    usable = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(usable)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((flat.astype(np.float64) ** 2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return usable[good], (flat[good] / norm[good, None]).astype(np.float32)


def fit_centres(sample: np.ndarray, cells: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Unit centres of a sample."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        owner = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def growing_probes(cells: int) -> int:
    """How many cells to search of so many: neighbours spread over more cells as a table grows, so a fixed number loses them."""
    return max(LEAST_PROBES, math.ceil(5 * math.sqrt(cells) / 6))


def _upper(centres: np.ndarray, dim: int):
    """(cell, unit): each vector with its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, unit = unit_vectors(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array((unit @ centres.T).argmax(axis=1).astype(np.int32) if len(unit) else np.empty(0, np.int32)), pa.array([u.tobytes() for u in unit], pa.binary())], names=["cell", "unit"])

    return run


def _lower(each: float, dim: int):
    """The centres below one of the upper level: one for each ``each`` vectors of the sample."""

    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("unit"), dim)
        x = x[np.lexsort(x.T[:4])]  # the order in which rows come changes nothing
        centres = fit_centres(x, max(1, round(len(x) / each)))
        return pa.table({"cell": pa.array([group.column("cell")[0].as_py()] * len(centres), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    return run


def fit_cells(source: DataFrame, n: int, cells: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper centres, lower centres, where the lower ones of each upper one begin)."""

    def sample(many: int) -> DataFrame:
        share = min(1.0, 1.2 * max(LEAST_SAMPLE, PER_CELL * many) / max(1, n))
        return source.where(F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("embedding")

    first = math.ceil(math.sqrt(cells))
    drawn = sample(first).limit(2 * max(LEAST_SAMPLE, PER_CELL * first)).toArrow()
    x = unit_vectors(drawn.column(0).combine_chunks(), dim)[1]
    if not len(x):
        one = np.eye(1, dim, dtype=np.float32)
        return one, one, np.array([0, 1])
    upper = fit_centres(x, first)
    each = max(1.0, min(n, 1.2 * max(LEAST_SAMPLE, PER_CELL * cells)) / cells)
    rows = sample(cells).mapInArrow(_upper(upper, dim), "cell int, unit binary").groupBy("cell").applyInArrow(_lower(each, dim), "cell int, centre binary").toArrow()  # one row a cell
    owner, centres = rows.column("cell").to_numpy(), _matrix(rows.column("centre"), dim)
    order = np.lexsort((*centres.T[:4], owner))
    owner, centres = owner[order], centres[order]
    there, starts = np.unique(owner, return_index=True)
    return upper[there], centres, np.append(starts, len(owner))


def nearest_cells(unit: np.ndarray, upper: np.ndarray, lower: np.ndarray, starts: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest lower cells of each vector, nearest first, -1 where there are fewer: those of its nearest upper cells."""
    looked = min(len(upper), max(LOOKED, math.ceil(probes / 4)))
    near = unit @ upper.T
    tops = np.argpartition(-near, looked - 1, axis=1)[:, :looked] if looked < len(upper) else np.broadcast_to(np.arange(len(upper)), near.shape)
    best, found = np.full((len(unit), probes), -2, np.float32), np.full((len(unit), probes), -1, np.int32)
    for c in range(len(upper)):
        rows = np.flatnonzero((tops == c).any(axis=1))
        if len(rows):
            sims = unit[rows] @ lower[starts[c] : starts[c + 1]].T
            ids = np.broadcast_to(np.arange(starts[c], starts[c + 1], dtype=np.int32), sims.shape)
            sims, ids = np.concatenate([best[rows], sims], 1), np.concatenate([found[rows], ids], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            best[rows], found[rows] = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    return found


def _assigned(upper: np.ndarray, lower: np.ndarray, starts: np.ndarray, probes: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = unit_vectors(batch.column(1), dim)
            cells = nearest_cells(unit, upper, lower, starts, min(probes, len(lower)))
            raw = [u.tobytes() for u in unit]
            same = np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "big", signed=True) for r in raw], np.int64)
            counts = (cells >= 0).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(cells[cells >= 0].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(same), pa.array(raw, pa.binary()), lists], names=["row", "same", "unit", "cells"])

    return run


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _compared(k: int, least: float, dim: int):
    """As :func:`_searched`, but every vector of a shard meets all that were inserted."""

    def run(group: pa.Table) -> pa.Table:
        inserted = group.column("inserted").to_numpy(zero_copy_only=False).astype(bool)
        rows, vectors = group.column("row").to_numpy(), _matrix(group.column("unit"), dim)
        own, x, out = rows[inserted], vectors[inserted], []
        for at in range(0, len(rows) if len(own) else 0, 1024):
            sims = vectors[at : at + 1024] @ x.T
            ids = np.argpartition(-sims, k, axis=1)[:, : k + 1] if len(own) > k + 1 else np.broadcast_to(np.arange(len(own)), sims.shape)
            a = np.repeat(np.arange(at, at + len(ids)), ids.shape[1])
            b = ids.ravel()
            other = own[b] != rows[a]
            a, b = a[other], b[other]
            exact = np.einsum("ij,ij->i", vectors[a].astype(np.float64), x[b].astype(np.float64))
            good = exact >= least
            out.append((rows[a[good]], own[b[good]], exact[good]))
        cat = lambda i, t: np.concatenate([o[i] for o in out]) if out else np.empty(0, t)
        return pa.table({"a": pa.array(cat(0, np.int64)), "b": pa.array(cat(1, np.int64)), "sim": pa.array(cat(2, np.float64))})

    return run


def _searched(k: int, least: float, dim: int, beam: int):
    def run(group: pa.Table) -> pa.Table:
        inserted = group.column("inserted").to_numpy(zero_copy_only=False).astype(bool)
        rows, vectors = group.column("row").to_numpy(), _matrix(group.column("unit"), dim)
        order = np.argsort(rows, kind="stable")
        rows, vectors, inserted = rows[order], vectors[order], inserted[order]
        own, out = rows[inserted], []
        if len(own):
            x, edges, entry = build_graph(vectors[inserted])
            nodes = np.flatnonzero(inserted)
            for queries, known in ((nodes, True), (np.flatnonzero(~inserted), False)):
                for at in range(0, len(queries), 1024):
                    some = queries[at : at + 1024]
                    # a node is searched for from its own edges as well
                    starts = np.full((len(some), 1), entry)
                    if known:
                        starts = np.concatenate([starts, edges[at : at + len(some)]], axis=1)
                    ids, sims = beam_search(x, edges, vectors[some], starts, beam)
                    ids = np.minimum(ids, len(own) - 1)
                    good = (sims >= least) & (sims > -2) & (own[ids] != rows[some][:, None])
                    good &= np.cumsum(good, axis=1) <= k
                    q, c = np.nonzero(good)
                    a, b = vectors[some[q]], x[ids[q, c]]
                    exact = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))
                    out.append((rows[some[q]], own[ids[q, c]], exact))
        cat = lambda i, t: np.concatenate([o[i] for o in out]) if out else np.empty(0, t)
        return pa.table({"a": pa.array(cat(0, np.int64)), "b": pa.array(cat(1, np.int64)), "sim": pa.array(cat(2, np.float64))})

    return run


def neighbours(vectors: DataFrame, k: int = K, least: float = -1.5, probes: int | Callable[[int], int] = PROBES, queries: DataFrame | None = None, dim: int = DIM, beam: int | None = BEAM, shard: int | None = None) -> DataFrame:
    """row, neighbour, similarity, rank (1 .. k, ties by smaller row) of each row of ``vectors`` (embedding_row, embedding).

    Neighbours below ``least`` are left out; ``queries`` (embedding_row) restricts whose neighbours come out. Null rows, and vectors that are
    null, all zero, not finite or of another length than ``dim``, neither have neighbours nor are any. Of a repeated row one counts. ``probes``
    is a number of cells, or gives one for how many there are; ``shard`` is how many vectors a shard has, about; without ``beam`` shards are searched whole.
    """
    spark, shard = vectors.sparkSession, shard or SHARD
    scratch = Scratch(spark, "vectors")
    source = vectors.where("embedding_row is not null").select(F.col("embedding_row").cast("bigint").alias("row"), "embedding")
    n = source.count()
    cells = int(min(MOST_CELLS, max(1, n // shard)))
    probes = probes(cells) if callable(probes) else probes
    fitted = fit_cells(source, n, cells, dim)
    placed = scratch.keep(source.mapInArrow(_assigned(*fitted, probes, dim), "row bigint, same bigint, unit binary, cells array<int>"), "placed")
    # equal vectors: the smallest row stands for them; the k + 1 smallest are all that can be among anyone's k nearest
    dups = placed.groupBy("same").agg(F.count("*").alias("n"), F.min("row").alias("rep")).where("n > 1")
    dups = scratch.keep(dups, "equal")
    firsts = placed.select("row", "same").join(dups, "same").distinct().withColumn("r", F.row_number().over(W.partitionBy("same").orderBy("row"))).where(F.col("r") <= k + 1)
    members = scratch.keep(firsts.groupBy("same").agg(F.min("row").alias("rep"), F.sort_array(F.collect_set("row")).alias("members")), "members")
    nodes = placed.join(dups, "same", "left").where("rep is null or rep = row").select("row", "same", "unit", "cells")
    counts = {r[0]: r[1] for r in nodes.groupBy(F.col("cells")[0]).agg(F.count("*")).collect()}  # one row a cell
    large = [(c, -(-m // (SPLIT * shard))) for c, m in counts.items() if m > SPLIT * shard]
    each = nodes.select("row", "same", "unit", F.posexplode("cells").alias("near", "cell"))
    if large:
        each = each.join(spark.createDataFrame(large, "cell int, shards int"), "cell", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        mine = F.when(F.col("near") == 0, F.pmod(F.col("same"), F.col("shards")).cast("int")).otherwise(F.lit(-1))
        each = each.withColumn("mine", mine).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        each = each.select("cell", "shard", "row", "unit", (F.col("mine") == F.col("shard")).alias("inserted"))
    else:
        each = each.select("cell", F.lit(0).alias("shard"), "row", "unit", (F.col("near") == 0).alias("inserted"))
    # a task takes a few shards, at every size of the table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(counts) // 8)
    near = each.repartition(tasks, "cell", "shard").groupBy("cell", "shard").applyInArrow(_searched(k, least, dim, beam) if beam else _compared(k, least, dim), "a bigint, b bigint, sim double")
    # rows for nodes again: both ends, with the members that can matter
    ends = members.select("rep", "members")
    own = placed.select("row", "same").join(members, "same").select(F.col("row").alias("x"), "members", "rep")
    far = near.join(ends.withColumnRenamed("members", "ma"), F.col("a") == F.col("rep"), "left").drop("rep").join(ends.withColumnRenamed("members", "mb"), F.col("b") == F.col("rep"), "left").drop("rep")
    far = far.where(F.coalesce(F.size("ma"), F.lit(1)) <= k).select(F.explode(F.coalesce("ma", F.array("a"))).alias("x"), F.coalesce("mb", F.array("b")).alias("mb"), "sim")
    every = far.select("x", F.explode("mb").alias("y"), "sim").unionByName(own.select("x", F.explode("members").alias("y"), F.lit(1.0).alias("sim"))).where("x <> y")
    every = every.groupBy("x", "y").agg(F.max("sim").alias("sim")).where(F.col("sim") >= least)
    if queries is not None:
        every = every.join(queries.select(F.col("embedding_row").alias("x")).where("x is not null").distinct(), "x", "left_semi")
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy(F.desc("sim"), "y"))).where(F.col("rank") <= k)
    ranked = materialize(ranked.select(F.col("x").alias("row"), F.col("y").alias("neighbour"), F.col("sim").alias("similarity"), "rank"), "neighbours")
    scratch.close()
    return ranked


def found(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """p3_found: row_a, row_b (row_a < row_b) of at least ``least`` similarity where one is among the K most similar of the other. Who is below
    ``least`` can't push anyone of at least ``least`` out of the K, so only those above are ranked."""
    near = neighbours(vectors, least=least)
    return near.select(F.least("row", "neighbour").alias("row_a"), F.greatest("row", "neighbour").alias("row_b")).distinct()
