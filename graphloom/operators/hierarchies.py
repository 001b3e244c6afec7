"""Single-parent hierarchies by doubling: roots, depths, cycles and inherited values in a logarithmic number of rounds.

In a round every node jumps to where the node that it points to points; so a chain of a hundred thousand nodes takes seventeen rounds of one
join each, with one row a node in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.staging import stage


def _parents(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of nodes with one parent or none, parents included; and (node, code) of what is no hierarchy."""
    rows = nodes.select("node", "parent").filter("node IS NOT NULL").distinct()
    named = rows.filter("parent IS NOT NULL")
    several = named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", F.lit("SEVERAL_PARENTS").alias("code"))
    loops = named.filter("node = parent").select("node", F.lit("SELF_LOOP").alias("code"))
    faults = stage(several.unionByName(loops).distinct(), "hierarchy-faults")
    one = named.join(faults.select("node").distinct(), "node", "left_anti")
    others = rows.select("node").unionByName(named.select(F.col("parent").alias("node"))).distinct().join(one.select("node"), "node", "left_anti")
    return stage(one.unionByName(others.withColumn("parent", F.lit(None).cast(dict(rows.dtypes)["parent"]))), "hierarchy-parents"), faults


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, root, depth), (node, code)) of (node, parent) rows: every node below its root, and what is wrong.

    A node with several parents, or its own parent, has no parent here and is named (SEVERAL_PARENTS, SELF_LOOP). Nodes on a cycle of several, and below
    one, reach no root: they have no row and are named (CYCLE). Repeated rows count once; a null node is none; a null parent makes a root.
    """
    parents, faults = _parents(nodes)
    state = parents.select("node", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "node").alias("root"))
    reach, n = 1, max(1, parents.count())
    while reach <= n:
        there = state.select(F.col("node").alias("t_node"), F.col("at").alias("t_at"), F.col("depth").alias("t_depth"), F.col("root").alias("t_root"))
        state = stage(state.join(there, F.col("at") == F.col("t_node"), "left").select(
            "node", F.col("t_at").alias("at"), (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"), F.coalesce("t_root", "root").alias("root")), "hierarchy-round")
        reach *= 2
        if not state.filter("at IS NOT NULL").limit(1).count():
            break
    cycles = state.filter("at IS NOT NULL").select("node", F.lit("CYCLE").alias("code"))
    return state.filter("at IS NULL").select("node", "root", "depth"), faults.unionByName(cycles)


def inherited(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value, origin, scope, code): each node's own value, or else that of the nearest node above that has one.

    ``values`` (node, value) are what scopes say. A node with several different values has none that may be taken (SCOPE_AMBIGUOUS, itself or for
    those below it). A node whose own value differs from what it would inherit keeps its own (LOCAL_CONFLICT says so). origin: LOCAL, INHERITED or MISSING;
    scope: the node whose value it is. Nulls say nothing; nodes without a way to a root inherit as far as they reach (CYCLE if that is round).
    """
    parents, _ = _parents(nodes)
    said = values.filter("value IS NOT NULL").groupBy(F.col("node").alias("v_node")).agg(F.min("value").alias("own"), F.count_distinct("value").alias("said"))
    state = parents.join(said, F.col("node") == F.col("v_node"), "left").select("node", F.col("parent").alias("at"), "own", F.coalesce("said", F.lit(0)).alias("said"))
    state, n, reach = stage(state.withColumn("scope", F.lit(None).cast(dict(parents.dtypes)["node"])), "context-round"), max(1, parents.count()), 1
    while reach <= 2 * n:
        there = state.select(F.col("node").alias("t_node"), F.col("at").alias("t_at"), F.col("scope").alias("t_scope"), F.col("said").alias("t_said"))
        joined = state.join(there, F.col("at") == F.col("t_node"), "left")
        # Where the node that is pointed to says something, the way ends; else it goes on where that one's does.
        scope = F.coalesce("scope", F.when(F.col("t_said") > 0, F.col("t_node")).otherwise(F.col("t_scope")))
        state = stage(joined.select("node", F.when(scope.isNull(), F.col("t_at")).alias("at"), "own", "said", scope.alias("scope")), "context-round")
        reach *= 2
        if not state.filter("at IS NOT NULL").limit(1).count():
            break
    above = state.select(F.col("node").alias("s_node"), F.col("own").alias("s_own"), F.col("said").alias("s_said"))
    both = state.join(above, F.col("scope") == F.col("s_node"), "left")
    local, context = F.col("said") == 1, F.col("s_said") == 1
    code = (
        F.when((F.col("said") > 1) | ((F.col("said") == 0) & (F.col("s_said") > 1)), "SCOPE_AMBIGUOUS")
        .when(local & context & (F.col("own") != F.col("s_own")), "LOCAL_CONFLICT").when((F.col("said") == 0) & F.col("at").isNotNull(), "CYCLE")
    )
    take = (F.col("said") == 0) & context
    return both.select(
        "node", F.when(local, F.col("own")).when(take, F.col("s_own")).alias("value"), F.when(local, "LOCAL").when(take, "INHERITED").otherwise("MISSING").alias("origin"),
        F.when(local, F.col("node")).when(take, F.col("scope")).alias("scope"), code.alias("code"))
