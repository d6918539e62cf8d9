"""Document networks: tag network, PageRank, graph statistics, node reports, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.shared import written

#: Rounds of PageRank between two written tables.
ROUNDS = 4
#: Edges of a component search for each file of its rounds.
EDGES_A_TASK = 200_000
#: Documents of a tag that are dealt to a task, and the most tags of a document whose subsets are listed.
TAG_DOCS, MOST_TAGS = 2048, 8
#: Edges of a tag network that are written for its PageRank at most.
EDGES = 2_000_000
#: Ids whose trees a task holds; with more, it gives them out and begins anew.
IDS_A_TASK = 500_000


def _tagged(docs: DataFrame) -> DataFrame:
    """(id, tags): the sorted distinct tags of each id that has any."""
    t = docs.where("_id is not null").select(F.col("_id").alias("id"), F.explode("tags").alias("tag")).where("tag is not null")
    return t.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tag_network(docs: DataFrame) -> DataFrame:
    """(src, dst) of documents that share a tag (case counts), both directions, each pair once.

    The pairs of a tag are its meaning, so the result grows with the square of a tag's documents; nothing is collected.
    A pair comes from its first common tag, so pairs are not shuffled; a tag's documents are dealt in parts.
    """
    t = written(_tagged(docs).select("id", F.posexplode("tags").alias("at", "tag"), "tags").select("id", "tag", F.slice("tags", 1, F.col("at")).alias("before")))
    parts = t.groupBy("tag").agg(F.ceil(F.count("*") / TAG_DOCS).alias("parts"))
    t = t.join(parts, "tag")
    every = t.select("tag", F.col("id").alias("src"), "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = t.select("tag", F.col("id").alias("dst"), F.col("before").alias("other"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    return every.join(dealt, ["tag", "part"]).where("src <> dst and not arrays_overlap(before, other)").select("src", "dst")


def tag_pagerank(docs: DataFrame, damping: float = 0.85, fixed: int = 20) -> DataFrame:
    """(id, score): ``pagerank(tag_network(docs), fixed=fixed)`` without the network's edges.

    What a document is given is a sum over all that share a tag with it, and that is a signed sum over the subsets of its
    tags of what all documents with the whole subset give. Documents of the same tags are one row with their number. So
    a round is two sums over at most 2 ** tags rows a document. Networks of up to ``EDGES`` edges, and documents of over
    ``MOST_TAGS`` tags, have their edges written instead.
    """
    sets = written(_tagged(docs))
    most = sets.agg(F.max(F.size("tags"))).first()[0] or 0
    if most > MOST_TAGS:
        return pagerank(written(tag_network(docs)), damping=damping, fixed=fixed)
    kinds = written(sets.groupBy("tags").agg(F.count("*").alias("m")).withColumn("t", F.monotonically_increasing_id()))
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(tags)) - 1), k -> struct(filter(tags, (x, i) -> shiftright(k, i) % 2 = 1) as subset, if(bit_count(k) % 2 = 1, 1, -1) as sign))")
    parts = written(kinds.select("t", "m", F.explode(subsets).alias("x")).select("t", "m", "x.*"))
    names = written(parts.groupBy("subset").agg(F.count("*").alias("kinds")).select("subset", F.monotonically_increasing_id().alias("s")))
    links = written(parts.join(names, "subset").select("t", "s", "m", "sign"))
    degree = links.join(links.groupBy("s").agg(F.sum("m").alias("n")), "s").groupBy("t").agg((F.sum(F.col("sign") * F.col("n")) - 1).alias("degree"))
    nodes = written(kinds.select("t", "m").join(degree.where("degree > 0"), "t"))
    n, edges = nodes.agg(F.sum("m"), F.sum(F.col("m") * F.col("degree"))).first()
    if (edges or 0) <= EDGES:
        return pagerank(written(tag_network(docs)), damping=damping, fixed=fixed)
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    for k in range(fixed):
        all_ = links.join(ranks.select("t", (F.col("score") / F.col("degree")).alias("share")), "t").groupBy("s").agg(F.sum(F.col("m") * F.col("share")).alias("given"))
        given = links.join(all_, "s").groupBy("t").agg(F.sum(F.col("sign") * F.col("given")).alias("given"))
        score = (1 - damping) / n + damping * (F.col("given") - F.col("score") / F.col("degree"))
        ranks = ranks.join(given, "t").select("t", "m", "degree", score.alias("score"))
        ranks = written(ranks) if k % 2 else ranks
    total = ranks.agg(F.sum(F.col("m") * F.col("score")).alias("total"))
    of_kind = ranks.crossJoin(F.broadcast(total)).select("t", (F.col("score") / F.col("total")).alias("score"))  # one row is broadcast
    return sets.join(kinds.select("tags", "t").join(of_kind, "t"), "tags").select("id", "score")


def edges_from_map(graph: DataFrame, column: str = "graph") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows with a map from node to array of targets; nodes are the keys only."""
    pairs = graph.select(F.explode(column).alias("id", "targets"))
    return pairs.select("id").distinct(), pairs.select(F.col("id").alias("src"), F.explode("targets").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """(id, score): ranks that sum to 1.

    A node's out-degree counts all its edges, parallel ones and those to unknown nodes; a target gets a source's share
    once. Nodes without edges share their rank with all. Stops at an L1 change under the tolerance, or after
    ``fixed`` rounds (then without convergence checks).
    """
    nodes = written((nodes_of(edges) if nodes is None else nodes).select("id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    degrees = written(nodes.join(degree, "id", "left"))
    links = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = written(links.join(degree.withColumnRenamed("id", "src"), "src"))
    sinks = degrees.where("degree is null").count() > 0
    ranks = degrees.select("id", "degree", F.lit(1.0 / n).alias("score"))
    left = fixed if fixed is not None else max_iterations
    while left > 0:
        rounds = min(ROUNDS, left)
        left -= rounds
        new = ranks.withColumn("s0", F.col("score")).drop("score")
        for k in range(rounds):  # one job for several rounds, one join and one shuffle by id in each
            kept = ["degree", *[f"s{j}" for j in range(k + 1)]]
            given = links.join(new.select(F.col("id").alias("src"), F.col(f"s{k}").alias("score")), "src").select(F.col("dst").alias("id"), (F.col("score") / F.col("degree")).alias("given"))
            sums = given.unionByName(new.withColumn("given", F.lit(0.0)), allowMissingColumns=True).groupBy("id").agg(F.sum("given").alias("given"), *[F.max(c).alias(c) for c in kept])
            if sinks:
                lost = new.where("degree is null").agg(F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias("lost"))
                sums = sums.crossJoin(F.broadcast(lost))  # one row is broadcast
            new = sums.withColumn(f"s{k + 1}", (1 - damping) / n + damping * (F.col("given") + (F.col("lost") / n if sinks else F.lit(0.0)))).select("id", *kept, f"s{k + 1}")
        new = written(new)
        last = rounds
        if fixed is None:
            changes = new.agg(*[F.sum(F.abs(F.col(f"s{k + 1}") - F.col(f"s{k}"))) for k in range(rounds)]).first()
            last = next((k + 1 for k, c in enumerate(changes) if c < tolerance), rounds)
            left = left if changes[last - 1] >= tolerance else 0
        ranks = new.select("id", "degree", F.col(f"s{last}").alias("score"))
    total = ranks.agg(F.sum("score").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("score") / F.col("total")).alias("score"))


def top_nodes(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(n)


def statistics(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: nodes, edges, scores (mean, maximum, minimum, population deviation), mean degrees.

    Out-degrees average over all nodes, in-degrees over nodes with an edge in.
    """
    s = scores.agg(F.count("*").alias("num_nodes"), F.avg("score").alias("avg_pagerank"), F.max("score").alias("max_pagerank"), F.min("score").alias("min_pagerank"), F.stddev_pop("score").alias("std_pagerank"))
    e = edges.agg(F.count("*").alias("num_edges"), F.count_distinct("dst").alias("targets"))
    both = s.crossJoin(e)  # one row each
    return both.select("num_nodes", "num_edges", "avg_pagerank", "max_pagerank", "min_pagerank", "std_pagerank", F.coalesce(F.try_divide(F.col("num_edges"), F.col("num_nodes")), F.lit(0.0)).alias("avg_out_degree"), F.coalesce(F.try_divide(F.col("num_edges"), F.col("targets")), F.lit(0.0)).alias("avg_in_degree"))


def degree_statistics(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, distinct edges, mean, largest and smallest out-degree, nodes without edges included."""
    e = edges.select("src", "dst").distinct()
    degree = (nodes_of(edges) if nodes is None else nodes).join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.count("*").alias("num_nodes"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("num_edges"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("avg_degree"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"))


def node_reports(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Per node: score, distinct documents that refer to it, and references it makes."""
    into = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("referenced_by"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("references"))
    d = scores.join(into, "id", "left").join(out, "id", "left")
    return d.select("id", "score", F.coalesce("referenced_by", F.lit(0)).alias("referenced_by"), F.coalesce("references", F.lit(0)).alias("references"))


def importance(edges: DataFrame, scores: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """The n most important documents with title and category (empty and 'unknown' where missing); edges are not looked at."""
    top = top_nodes(scores, n)
    return top.join(docs.select(F.col("_id").alias("id"), "title", "category"), "id", "left").select("id", "score", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("unknown")).alias("category"))


def neighbour_recommendations(edges: DataFrame, scores: DataFrame, node: str, n: int = 5) -> DataFrame:
    """(id, score): a node's neighbours of best score (0 without one)."""
    near = edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()
    return near.join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of one task's edges; a root is the smallest id of its tree."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    ids = list(up)
    if ids:
        yield pd.DataFrame({"id": ids, "component": [root(x) for x in ids]})


def forest(pairs: DataFrame) -> DataFrame:
    """(id1, id2, w): what each task leaves of its pairs (id1, id2, w): trees of equal components, with w = 0, and for each id1 the sum of w as (id1, id1, sum)."""

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}
        sums: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def given() -> Iterator[pd.DataFrame]:
            trees = [(root(x), x, 0) for x in up if up[x] != x]
            rows = trees + [(x, x, w) for x, w in sums.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["id1", "id2", "w"])
            up.clear()
            sums.clear()

        for batch in batches:
            for a, b, w in zip(batch["id1"], batch["id2"], batch["w"], strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
                sums[a] = sums.get(a, 0) + int(w)
            if len(up) > IDS_A_TASK:
                yield from given()
        yield from given()

    return pairs.mapInPandas(left, pairs.schema)


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every id in ``pairs`` (id1, id2); components are named by their smallest id.

    Smallest neighbour labels with pointer jumping; every round is written to the shared folder. A graph of up to
    ``EDGES_A_TASK`` edges is one task's, by union-find.
    """
    both = written(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).union(pairs.select("id2", "id1")).where("a <> b").distinct())
    tasks = max(1, -(-both.count() // EDGES_A_TASK))  # small graphs are not written in many tiny files, round after round
    if tasks == 1:
        kind = both.schema["a"].dataType.simpleString()
        return both.where("a < b").coalesce(1).mapInPandas(_union_find, f"id {kind}, component {kind}")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).withColumnRenamed("a", "v").coalesce(tasks))
    while True:
        seen = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("p").alias("q"))
        hooked = written(labels.join(seen, F.col("v") == F.col("a"), "left").select("v", F.least("p", "q").alias("p"), F.col("p").alias("old")).coalesce(tasks))
        up = hooked.select(F.col("v").alias("w"), F.col("p").alias("up"))
        jumped = written(hooked.join(up, F.col("p") == F.col("w")).select("v", F.col("up").alias("p"), "old").coalesce(tasks))
        labels = jumped.select("v", "p")
        if not jumped.where("p <> old").count():
            return labels.select(F.col("v").alias("id"), F.col("p").alias("component"))
