"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one vector per group.

Equal vectors are first collapsed to one row with a count. Centres are fitted on a
bounded sample; every vector then goes to its nearest few cells, so that a pair
near a border still meets. How many, pairs at the least cosine made from the sample tell: the
more cells there are, the more are needed. A cell is cut into blocks, and each pair of blocks is a group of its
own, so that no task holds a whole cell. A group returns counts of links and a spanning
star per local component, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import size_checked
from .common import stored
from .components import components

#: Cosine from which two vectors are linked.
LEAST = 0.9
#: Vectors that the centres are fitted on, rounds of fitting, and most centres.
SAMPLE, ROUNDS, MOST_CELLS = 32_768, 8, 8_192
#: Nearest cells that a vector goes to at least; more, until so many of the border pairs made for measuring meet in a cell.
PROBES, RECALL, PAIRS = 4, 0.97, 2_000
#: Vectors of a block, and rows multiplied at once.
BLOCK, STRIP = 4_096, 256


def usable(vector: str) -> Column:
    """True for vectors that have a direction: not null, not zero, without null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; first by the largest component, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: centres are the directions of their vectors' sums. Begins with the first k vectors."""
    centres = sample[:k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(strip @ centres.T).argmax(axis=1) for strip in _strips(sample)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def probes_for(vectors: np.ndarray, centres: np.ndarray) -> int:
    """How many nearest cells make ``RECALL`` of the pairs at cosine ``LEAST`` meet.

    The pairs are the last ``PAIRS`` unit vectors and vectors turned from them, once towards
    random directions and once towards other vectors; the harder kind decides.
    """
    if len(centres) <= PROBES or vectors.shape[1] < 2:
        return PROBES
    rng, x, most = np.random.default_rng(1), vectors[-PAIRS:], PROBES
    for towards in (rng.normal(size=x.shape), vectors[rng.integers(0, len(vectors), len(x))]):
        across = towards - (towards * x).sum(axis=1, keepdims=True) * x
        norms = np.linalg.norm(across, axis=1)
        ok = norms > 1e-6
        y = LEAST * x[ok] + (1 - LEAST**2) ** 0.5 * across[ok] / norms[ok, None]
        needed = [_met_at(a @ centres.T, b @ centres.T) for a, b in zip(_strips(x[ok]), _strips(y))]
        if needed:
            needed = np.sort(np.concatenate(needed))
            most = max(most, int(needed[int(np.ceil(RECALL * len(needed))) - 1]))
    return most


def _met_at(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of cosines with all centres, the number of nearest cells from which the two have one in common."""
    ranks = [np.argsort(np.argsort(-side, axis=1), axis=1) for side in (a, b)]
    return np.maximum(*ranks).min(axis=1) + 1


def _strips(rows: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(rows), STRIP):
        yield rows[start : start + STRIP]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _fitted(nodes: DataFrame) -> tuple[int, np.ndarray, int]:
    """The dimension of most vectors, centres for it, and probes; the sample is of the smallest hashes.

    Probes are measured on vectors that the centres are not fitted on, if there are enough.
    """
    dims = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return 0, np.zeros((0, 0)), PROBES
    k = int(min(MOST_CELLS, max(1, 2 * dims["count"] ** 0.5)))
    rows = nodes.where(F.col("dim") == dims["dim"]).select("vector", F.xxhash64("vector").alias("hash"))
    size = max(SAMPLE, 4 * k)
    sample = rows.orderBy("hash", "vector").limit(size + PAIRS).select("vector").toArrow()
    vectors = np.concatenate([_matrix(c, dims["dim"]) for c in sample["vector"].chunks if len(c)])
    units = _units(vectors)
    centres = fit_centres(units[:size], min(k, len(units)))
    return dims["dim"], centres, probes_for(units, centres)


def _assigned(nodes: DataFrame, dim: int, centres, most_probes: int) -> DataFrame:
    """Adds cells: the numbers of the nearest centres; vectors of another dimension meet in cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cells: list[list[int]] = [[-1]] * len(dims)
            rows = np.flatnonzero(dims == dim)
            if len(rows):
                vectors = _units(_matrix(batch.column(3).take(pa.array(rows)), dim))
                probes = min(most_probes, len(centres.value))
                nearest = [np.argpartition(-(s @ centres.value.T), probes - 1, axis=1)[:, :probes] for s in _strips(vectors)]
                for row, found in zip(rows, np.sort(np.concatenate(nearest), axis=1).tolist()):
                    cells[row] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=names)

    rows = nodes.select("node", "copies", "dim", "vector")
    names = [*rows.columns, "cells"]
    return rows.mapInArrow(run, f"node {rows.schema[0].dataType.simpleString()}, copies bigint, dim int, vector array<double>, cells array<int>")


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks: for each vector how many others it is linked with, and its local component's first vector."""
    cell, first, second = (int(group[c].iloc[0]) for c in ("cell", "first", "second"))
    a, b = (group[group["block"] == n].reset_index(drop=True) for n in (first, second))
    units = [_units(np.stack(side["vector"].to_numpy())) if len(side) else np.zeros((0, 1)) for side in (a, b)]
    lists = [_padded(side["cells"]) for side in (a, b)]
    weights = [side["copies"].to_numpy(np.int64) for side in (a, b)]
    counts = [np.zeros(len(side), np.int64) for side in (a, b)]
    links = []
    if len(a) and len(b):
        for start in range(0, len(a), STRIP):
            strip = units[0][start : start + STRIP] @ units[1].T
            i, j = np.nonzero(strip >= LEAST)
            i += start
            if first == second:
                i, j = i[i < j], j[i < j]
            links.append((i, j))
            own = ~_met_before(lists[0], lists[1], i, j, cell)
            np.add.at(counts[0], i[own], weights[1][j[own]])
            np.add.at(counts[1], j[own], weights[0][i[own]])
    if first == second:
        nodes, total, offset = a["node"], counts[0] + counts[1], 0
    else:
        nodes, total, offset = pd.concat([a["node"], b["node"]], ignore_index=True), np.concatenate(counts), len(a)
    ends = [np.concatenate([pair[k] for pair in links]) if links else np.zeros(0, np.int64) for k in (0, 1)]
    roots = _local_roots(len(nodes), ends[0], ends[1] + offset)
    return pd.DataFrame({"node": nodes, "links": total, "root": nodes.to_numpy()[roots]})


def _met_before(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether the pairs (i, j) share a cell of a smaller number: a pair that meets in several cells counts in the first."""
    met = np.zeros(len(i), bool)
    for left in a.T:
        earlier = np.where(left < cell, left, -2).astype(np.int32)[i]
        for right in b.T:
            met |= (earlier == right[j]) & (earlier >= 0)
    return met


def _padded(cells: pd.Series) -> np.ndarray:
    """Cell lists as rows of one length; -3 fills up."""
    result = np.full((len(cells), max(map(len, cells), default=1)), -3, np.int32)
    for row, found in zip(result, cells):
        row[: len(found)] = found
    return result


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches by links."""
    roots = np.arange(n)
    while True:
        low = np.minimum(roots[a], roots[b])
        after = roots.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, roots, after)
        after = after[after]
        if (after == roots).all():
            return roots
        roots = after


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row of ``vectors``.

    Vectors are linked if their cosine in double precision is at least ``LEAST`` and they meet
    in a cell; n_links counts the other rows linked directly, component_id is the smallest
    id that links reach, the row itself included, kept is true for the row of that id.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null id, link with nothing; equal vectors are linked, and rows that repeat an id are
    rows like others. Vectors of different length are never linked. An empty table gives no rows;
    further columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", usable("vector") & F.col("id").isNotNull())
    rows = stored(rows.withColumn("vector", F.when(F.col("usable"), F.col("vector"))), "vectors")
    nodes = rows.where("usable").groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "vector-nodes")

    dim, centres, probes = _fitted(nodes)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    assigned = stored(_assigned(nodes, dim, sent, probes), "cells")
    placed = assigned.withColumn("cell", F.explode("cells"))
    sizes = size_checked(placed.groupBy("cell", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    placed = placed.join(sizes, ["cell", "dim"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = other.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    id_type = nodes.schema["node"].dataType.simpleString()
    found = keyed.select("cell", "dim", "first", "second", "block", "node", "copies", "vector", "cells")
    found = found.groupBy("cell", "dim", "first", "second").applyInPandas(
        _block_links, f"node {id_type}, links bigint, root {id_type}"
    )
    found = stored(found, "vector-links")

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(linked, "node", "left").join(joined, "node", "left")
    named = named.select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    result = rows.join(named, "vector", "left")
    result = result.select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
