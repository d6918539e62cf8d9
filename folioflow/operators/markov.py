"""Markov chains over document states: transitions, stationary distribution, powers, flags, hitting times, trajectories.

Chains are long tables (from_state, to_state, prob). States are few by nature; dense algebra on the driver is only for
chains of up to MAX_STATES states, which is checked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.hashing import priority

MAX_STATES = 1000


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.where("from_state is not null and to_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def transition_matrix(pairs: DataFrame) -> DataFrame:
    """(from_state, to_state, prob) for all pairs of states; states that nothing follows get equal shares."""
    c = transition_counts(pairs)
    states = c.select(F.col("from_state").alias("s")).union(c.select("to_state")).distinct()
    grid = states.select(F.col("s").alias("from_state")).crossJoin(states.select(F.col("s").alias("to_state")))  # of states, not rows
    w = Window.partitionBy("from_state")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(w)
    return grid.join(c, ["from_state", "to_state"], "left").select("from_state", "to_state", F.when(total > 0, n / total).otherwise(1.0 / F.count("*").over(w)).alias("prob"))


def normalized(matrix: DataFrame) -> DataFrame:
    """Rows scaled to sum 1; rows of zeros get equal shares."""
    w = Window.partitionBy("from_state")
    total = F.sum("prob").over(w)
    return matrix.withColumn("prob", F.when(total > 0, F.col("prob") / total).otherwise(1.0 / F.count("*").over(w)))


def dense(matrix: DataFrame) -> tuple[list, np.ndarray]:
    """States in order and the matrix, for chains of checked size."""
    rows = matrix.limit(MAX_STATES**2 + 1).collect()
    states = sorted({r["from_state"] for r in rows} | {r["to_state"] for r in rows})
    if len(states) > MAX_STATES or len(rows) > MAX_STATES**2:
        raise ValueError(f"dense algebra is for chains of up to {MAX_STATES} states")
    at = {s: i for i, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    for r in rows:
        p[at[r["from_state"]], at[r["to_state"]]] = r["prob"]
    return states, p


def stationary_vector(p: np.ndarray, method: str = "eigenvalue", max_iterations: int = 1000) -> np.ndarray:
    if method == "eigenvalue":
        values, vectors = np.linalg.eig(p.T)
        k = int(np.argmin(np.abs(values - 1)))
        if abs(values[k] - 1) > 1e-8:
            raise ValueError("no eigenvalue 1: the rows must sum to 1")
        v = np.real(vectors[:, k])
        return v / v.sum()
    if method == "power":
        v = np.full(len(p), 1 / max(1, len(p)))
        for _ in range(max_iterations):
            new = v @ p
            if np.allclose(new, v, rtol=1e-5, atol=1e-8):
                return new / new.sum()
            v = new
        raise ValueError(f"no convergence in {max_iterations} rounds")
    raise ValueError(f"unknown method {method}")


def _frame(matrix: DataFrame, rows: list, schema: str) -> DataFrame:
    return matrix.sparkSession.createDataFrame(rows, schema)


def stationary(matrix: DataFrame, method: str = "eigenvalue") -> DataFrame:
    states, p = dense(matrix)
    return _frame(matrix, [(s, float(x)) for s, x in zip(states, stationary_vector(p, method) if states else [], strict=True)], "state string, probability double")


def power_iterated(matrix: DataFrame, rounds: int = 20) -> DataFrame:
    """(state, probability) after fixed rounds from equal shares, as joins: for chains too large for the driver."""
    v = matrix.select(F.col("from_state").alias("state")).distinct()
    v = v.withColumn("probability", 1.0 / F.count("*").over(Window.partitionBy(F.lit(1))))
    for _ in range(rounds):
        v = matrix.join(v, F.col("from_state") == F.col("state")).groupBy("to_state").agg(F.sum(F.col("prob") * F.col("probability")).alias("probability")).withColumnRenamed("to_state", "state")
    return v


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select(F.col("from_state"), F.col("to_state").alias("mid"), F.col("prob").alias("p"))
    y = b.select(F.col("from_state").alias("mid"), "to_state", F.col("prob").alias("q"))
    return x.join(y, "mid").groupBy("from_state", "to_state").agg(F.sum(F.col("p") * F.col("q")).alias("prob"))


def n_step(matrix: DataFrame, n: int) -> DataFrame:
    """The n-th power, by squaring."""
    if n < 1:
        raise ValueError("at least one step")
    out, square = None, matrix
    while n:
        if n & 1:
            out = square if out is None else multiply(out, square)
        n >>= 1
        if n:
            square = multiply(square, square)
    return out


def chain_flags(matrix: DataFrame) -> DataFrame:
    """One row: states, irreducible (by P^(10 n) > 0 everywhere, which is primitivity), aperiodic (some state keeps itself)."""
    states, p = dense(matrix)
    irreducible = bool(states) and bool((np.linalg.matrix_power(p, 10 * len(states)) > 0).all())
    return _frame(matrix, [(len(states), irreducible, bool((np.diag(p) > 0).any()))], "num_states long, is_irreducible boolean, is_aperiodic boolean")


def hitting_times(matrix: DataFrame, target: str) -> DataFrame:
    """(state, steps): expected steps to the target from each state, exact; 0 at the target, infinite where it may never be reached."""
    states, p = dense(matrix)
    if target not in states:
        raise ValueError(f"no state {target}")
    t, n = states.index(target), len(states)
    reach = np.zeros(n, bool)
    reach[t] = True
    for _ in range(n):
        reach |= (p[:, reach] > 0).any(1)
    lost = ~reach  # cannot reach it, and so does whoever may come here on the way
    for _ in range(n):
        lost |= (p[:, lost] > 0).any(1) & (np.arange(n) != t)
    open_states = [i for i in range(n) if i != t and not lost[i]]
    h = np.where(lost, np.inf, 0.0)
    h[t] = 0
    if open_states:
        q = p[np.ix_(open_states, open_states)]
        h[open_states] = np.linalg.solve(np.eye(len(open_states)) - q, np.ones(len(open_states)))
    return _frame(matrix, [(s, float(x)) for s, x in zip(states, h, strict=True)], "state string, steps double")


def expected_time(matrix: DataFrame, target: str, from_state: str | None = None) -> float:
    """Expected steps from a state, or the mean over all starts (the target itself counts as 0)."""
    h = {r["state"]: r["steps"] for r in hitting_times(matrix, target).collect()}
    return h[from_state] if from_state else sum(h.values()) / len(h)


def initial_distribution(weights: DataFrame) -> DataFrame:
    """(state, prob): weights of states scaled to a sum of 1; null and negative weights count as 0, equal states add up, none has a row if the sum is 0."""
    w = weights.groupBy("state").agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
    total = w.agg(F.sum("weight").alias("total"))
    return w.crossJoin(F.broadcast(total)).where("total > 0").select("state", (F.col("weight") / F.col("total")).alias("prob"))  # one row


def _drawn_starts(at: DataFrame, initial: DataFrame, seed: str) -> DataFrame:
    """A state for each walk: the cumulative distribution, inverted at a hash draw."""
    upper = F.sum("prob").over(Window.orderBy("state"))  # one row a state
    all_states = initial.where("prob > 0").select(upper.alias("upper"), "state").agg(F.sort_array(F.collect_list(F.struct("upper", "state"))).alias("all"))
    u = F.conv(F.substring(priority(seed, "start", F.col("walk_id")), 1, 8), 16, 10).cast("long") / float(2**32)
    first = F.element_at(F.filter("all", lambda x: x["upper"] > F.col("u")), 1)["state"]
    return at.withColumn("u", u).crossJoin(F.broadcast(all_states)).select("walk_id", F.coalesce(first, F.element_at("all", -1)["state"]).alias("state"))


def trajectories(matrix: DataFrame, start: str | None, steps: int, walks: int = 1, seed: str = "42", initial: DataFrame | None = None) -> DataFrame:
    """(walk_id, step, state): paths of ``steps`` states, start included; each step inverts the row's cumulative probabilities at a hash draw.

    Without a start, walks start by ``initial`` (see ``initial_distribution``), or anywhere alike.
    """
    spark = matrix.sparkSession
    w = Window.partitionBy("from_state").orderBy("to_state")
    upper = F.sum("prob").over(w)
    rows = matrix.where("prob > 0").withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("prob"))
    top = rows.groupBy("from_state").agg(F.sort_array(F.collect_list(F.struct("upper", "to_state"))).alias("next"))  # as long as a row of the chain
    top = F.broadcast(top) if top.limit(MAX_STATES + 1).count() <= MAX_STATES else top
    at = spark.range(walks).select(F.col("id").alias("walk_id"))
    if start is None and initial is not None:
        at = _drawn_starts(at, initial, seed)
    elif start is None:
        states = matrix.select("from_state").distinct().agg(F.sort_array(F.collect_list("from_state")).alias("all"))
        at = at.crossJoin(F.broadcast(states)).select("walk_id", F.element_at("all", (F.conv(F.substring(priority(seed, "start", F.col("walk_id")), 1, 8), 16, 10).cast("long") % F.size("all") + 1).cast("int")).alias("state"))
    else:
        at = at.withColumn("state", F.lit(start))
    at = at.withColumn("path", F.array("state"))
    for step in range(1, steps):
        u = F.conv(F.substring(priority(seed, F.col("walk_id"), F.lit(step)), 1, 8), 16, 10).cast("long") / float(2**32)
        pick = F.coalesce(F.element_at(F.filter("next", lambda x: x["upper"] > F.col("u")), 1)["to_state"], F.element_at("next", -1)["to_state"])
        at = at.withColumn("u", u).join(top, F.col("state") == F.col("from_state"), "left").withColumn("state", F.coalesce(pick, "state")).withColumn("path", F.concat("path", F.array("state"))).select("walk_id", "state", "path")
    return at.select("walk_id", F.posexplode("path").alias("step", "state"))


def simulated_time(matrix: DataFrame, target: str, start: str | None = None, runs: int = 1000, steps: int = 100, seed: str = "42") -> DataFrame:
    """One row: mean steps to the target over the simulated runs that reach it (infinite if none does), and how many did."""
    first = trajectories(matrix, start, steps, runs, seed).where(F.col("state") == target).groupBy("walk_id").agg(F.min("step").alias("steps"))
    return first.agg(F.coalesce(F.avg("steps"), F.lit(float("inf"))).alias("expected_time"), F.count("*").alias("reached"))


def with_probability(matrix: DataFrame, from_state: str, to_state: str, probability: float) -> DataFrame:
    """The matrix with one entry set; ``normalized`` then scales its row."""
    here = (F.col("from_state") == from_state) & (F.col("to_state") == to_state)
    return matrix.withColumn("prob", F.when(here, F.lit(float(probability))).otherwise(F.col("prob")))


def matrix_view(matrix: DataFrame) -> DataFrame:
    """The matrix as one row per state, a column per next state."""
    return matrix.groupBy("from_state").pivot("to_state").agg(F.first("prob")).orderBy("from_state")
