"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.sessions import checkpointed

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _stars(arcs: DataFrame, larger: bool) -> DataFrame:
    """Hangs the neighbours of every node a on the smallest node among them and a: those larger than a if larger, else
    those smaller than a, and a itself."""
    own = F.least(F.col("low"), F.col("a"))
    if not larger:
        arcs = arcs.where("b < a")
    lows = arcs.groupBy("a").agg(F.min("b").alias("low"))
    joined = arcs.join(lows, "a")
    if larger:
        made = joined.where("b > a").select(F.col("b").alias("a"), own.alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), own.alias("b")).union(lows.select("a", F.col("low").alias("b")))
    return made.where("a <> b").distinct()


def _lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that these edges connect each with."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return ids, ids[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the edges (a, b) of a task, CHUNK of them at a time: a node comes once for each chunk that has it."""

    def made(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in kept]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _lowest(a, b)], ["node", "root"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(r.num_rows for r in kept) >= CHUNK:
            yield made(kept)
            kept = []
    if kept:
        yield made(kept)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b of one ordered type) can reach, but for those that are
    their own.

    Where nodes are numbers, edges whose lower ends are near go to one task, which contracts them in chunks of a fixed
    size. What is left to rounds are links between the chunks' roots, at nodes that several chunks have. Edges with a null
    end and loops are ignored; an empty table gives no rows.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if dict(given.dtypes) != {"a": "bigint", "b": "bigint"}:
        return _by_rounds(given, most_rounds)
    stars = checkpointed(checkpointed(given).repartitionByRange("b").mapInArrow(_contracted, "node long, root long"))
    nodes = checkpointed(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    shared = nodes.where("root <> other").select("node", F.col("root").alias("b"))
    if shared.isEmpty():
        return nodes.where("node <> root").select("node", "root")
    links = stars.join(shared, "node").select(F.col("root").alias("a"), "b").where("a <> b")
    ends = _by_rounds(links, most_rounds).select(F.col("node").alias("root"), F.col("root").alias("end"))
    return nodes.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")).where("node <> root")


def _by_rounds(given: DataFrame, most_rounds: int) -> DataFrame:
    """The same from edges of a larger and a smaller node: rounds of large and small stars, each kept in the checkpoint
    folder, until two agree. A node of any degree is spread over tasks: its smallest neighbour is found by partial
    aggregates and joined back by a join that Spark can split."""
    now = checkpointed(given.distinct())
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).alias("m")
    before = now.agg(mark).first()["m"]
    for _ in range(most_rounds):
        if not before["n"]:
            break
        now = checkpointed(_stars(_both_ways(_stars(_both_ways(now), True)), False))
        after = now.agg(mark).first()["m"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
