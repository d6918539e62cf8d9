"""Random walks over a graph: every draw follows from a hash of walk and step, so that walks repeat alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.hashing import draw
from folioflow.operators.graph import nodes_of

#: Simulations hold the graph in every worker; graphs of more edges are refused there (walk() has no bound).
MAX_EDGES = 1_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, next): distinct neighbours in order."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("next"))


def walk(edges: DataFrame, starts: DataFrame, steps: int, return_probability: float = 0.0, seed: str = "42") -> DataFrame:
    """(walk_id, step, node): walks of steps + 1 nodes from ``starts`` (walk_id, node), as one join a step.

    At a node without neighbours the walk stays and still counts. With a return probability, a step goes back to the
    start when its draw says so.
    """
    near = adjacency(edges).withColumnRenamed("src", "at")
    w = starts.select("walk_id", F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    for step in range(1, steps + 1):
        pick = F.element_at("next", (draw(F.size("next"), seed, F.col("walk_id"), F.lit(step)) + 1).cast("int"))
        w = w.join(near, "at", "left").withColumn("to", F.when(F.col("next").isNull(), F.col("at")).otherwise(pick))
        if return_probability:
            back = draw(F.lit(1_000_000), seed, F.lit("back"), F.col("walk_id"), F.lit(step)) < int(return_probability * 1_000_000)
            w = w.withColumn("to", F.when(back, F.col("start")).otherwise(F.col("to")))
        w = w.select("walk_id", "start", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    return w.select("walk_id", F.posexplode("path").alias("step", "node"))


def analyze(walks: DataFrame, n_nodes: int) -> DataFrame:
    """Per walk: length, distinct nodes, coverage."""
    d = F.count_distinct("node")
    return walks.groupBy("walk_id").agg(F.count("*").alias("length"), d.alias("unique_nodes"), (d / F.lit(n_nodes)).alias("coverage"))


def mean_coverage(walks: DataFrame, n_nodes: int) -> DataFrame:
    """One row: how many walks, and the means of their coverage and distinct nodes."""
    return analyze(walks, n_nodes).agg(F.count("*").alias("sessions"), F.avg("coverage").alias("mean_coverage"), F.avg("unique_nodes").alias("mean_unique_nodes"))


def visits(walks: DataFrame, n: int = 10) -> DataFrame:
    """(node, visits, frequency): the most visited nodes over all walks."""
    total = walks.agg(F.count("*").alias("total"))
    top = walks.groupBy("node").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "node").limit(n)
    return top.crossJoin(F.broadcast(total)).select("node", "visits", (F.col("visits") / F.col("total")).alias("frequency"))  # one row


def walk_recommendations(edges: DataFrame, node: str, n: int = 5, walks: int = 100, steps: int = 10, seed: str = "42") -> DataFrame:
    """(node, visits): where walks from a node come most, itself left out."""
    starts = edges.sparkSession.range(walks).select(F.col("id").alias("walk_id"), F.lit(node).alias("node"))
    w = walk(edges, starts, steps, seed=seed)
    return w.where(F.col("node") != node).groupBy("node").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "node").limit(n)


def _graph(edges: DataFrame) -> tuple[list, list[np.ndarray]]:
    rows = edges.select("src", "dst").distinct().limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"simulations are for graphs of up to {MAX_EDGES} edges")
    names = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for r in rows:
        near[at[r["src"]]].append(at[r["dst"]])
    return names, [np.array(sorted(x)) for x in near]


def _trials(edges: DataFrame, trials: int, simulate, schema: str, seed: int) -> DataFrame:
    """Rows of ``simulate(graph, generator)`` for numbered trials, spread over the tasks; the graph is broadcast, of checked size."""
    spark = edges.sparkSession
    graph = spark.sparkContext.broadcast(_graph(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(t), *simulate(graph.value, np.random.default_rng([seed, int(t)]))) for t in b["id"]]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return spark.range(0, trials, 1, min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)


def _step(near: list[np.ndarray], at: int, r: np.random.Generator) -> int:
    return int(near[at][r.integers(len(near[at]))]) if len(near[at]) else at


def hitting_time(edges: DataFrame, start: str, target: str, trials: int = 1000, max_steps: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean steps of the trials that reach the target (infinite if none does), and how many did."""

    def one(graph, r):
        names, near = graph
        at, goal = names.index(start), names.index(target)
        for step in range(max_steps + 1):
            if at == goal:
                return (step,)
            at = _step(near, at, r)
        return (None,)

    t = _trials(edges, trials, one, "trial long, steps double", seed)
    return t.agg(F.coalesce(F.avg("steps"), F.lit(float("inf"))).alias("hitting_time"), F.count("steps").alias("reached"))


def cover_time(edges: DataFrame, start: str | None = None, trials: int = 100, max_steps: int = 100_000, seed: int = 42) -> DataFrame:
    """One row: mean steps until all nodes were visited, over the trials that did; infinite if none did."""

    def one(graph, r):
        names, near = graph
        at = names.index(start) if start else int(r.integers(len(names)))
        seen = {at}
        for step in range(max_steps):
            if len(seen) == len(names):
                return (step,)
            at = _step(near, at, r)
            seen.add(at)
        return (max_steps if len(seen) == len(names) else None,)

    t = _trials(edges, trials, one, "trial long, steps double", seed)
    return t.agg(F.coalesce(F.avg("steps"), F.lit(float("inf"))).alias("cover_time"), F.count("steps").alias("covered"))


def mixing_time(edges: DataFrame, start: str | None = None, num_steps: int = 1000, tolerance: float = 0.01, seed: int = 42) -> DataFrame:
    """One row: the first length t < num_steps of a fresh walk whose visits are within the tolerance of equal shares (L1); num_steps if none."""

    def one(graph, r):
        names, near = graph
        at = names.index(start) if start else int(r.integers(len(names)))
        length = int(r.bit_generator.seed_seq.entropy[1]) + 1  # the trial's number is the walk's length
        counts = np.zeros(len(names))
        counts[at] += 1
        for _ in range(length):
            at = _step(near, at, r)
            counts[at] += 1
        return (float(np.abs(counts / counts.sum() - 1 / len(names)).sum()),)

    t = _trials(edges, num_steps - 1, one, "trial long, distance double", seed)
    return t.agg(F.coalesce(F.min(F.when(F.col("distance") < tolerance, F.col("trial") + 1)), F.lit(num_steps)).alias("mixing_time"))


def navigation_study(edges: DataFrame, sessions: int = 100, clicks: int = 30, return_probability: float = 0.1, seed: str = "42") -> DataFrame:
    """Walks with returns from starts drawn among the first ten nodes in order: (walk_id, step, node)."""
    first = nodes_of(edges).orderBy("id").limit(10).agg(F.sort_array(F.collect_list("id")).alias("all"))
    starts = edges.sparkSession.range(sessions).crossJoin(F.broadcast(first)).select(F.col("id").alias("walk_id"), F.element_at("all", (draw(F.size("all"), seed, F.lit("start"), F.col("id")) + 1).cast("int")).alias("node"))  # ten ids
    return walk(edges, starts, clicks, return_probability, seed)
