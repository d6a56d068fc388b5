"""PageRank (personalised and global), weak components, node tables.

A graph is a table (id, adj array<bigint>); duplicate edges count twice, edges to unknown nodes lose their mass.
Ranks stay in linear space. The structure is dealt by id once, to a bucketed table in the checkpoint folder, and so are each
round's ranks: they are joined where they lie, and a round shuffles messages alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import cut, cut_by

ALPHA = 0.15


def build_ranked_nodes(nodes: DataFrame, sources: Sequence[int] | None) -> DataFrame:
    """(id, adj, p): p is 1/|S| on the distinct sources, or 1/n on all nodes if ``sources`` is None."""
    if sources is None:
        return nodes.select("id", "adj", (1.0 / nodes.agg(F.count("*")).scalar()).alias("p"))
    distinct = sorted(set(sources))
    if not distinct:
        raise ValueError("no sources")
    start = F.when(F.col("id").isin(distinct), F.lit(1.0 / len(distinct))).otherwise(F.lit(0.0))
    return nodes.select("id", "adj", start.alias("p"))


def dealt(nodes: DataFrame) -> DataFrame:
    """(id, adj) in a table dealt by id; a second record of a node is an error."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut_by(nodes.select("id", "adj").repartition(partitions, "id"), "id", partitions)
    twice = table.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"node {twice[0]['id']} has {twice[0]['n']} records")
    return table


def _messages(structure: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, mass) that arrives over links; structure and ranks lie together, and the partial aggregate combines before the shuffle."""
    sent = structure.where(F.size("adj") > 0).join(ranks.where("p > 0"), "id")
    arrived = sent.select(F.explode_outer("adj").alias("id"), (F.col("p") / F.size("adj")).alias("m")).where("id is not null")
    return arrived.groupBy("id").agg(F.sum("m").alias("mass"))


def _round(structure: DataFrame, ranks: DataFrame, update) -> DataFrame:
    """The next ranks: the mass that arrives is written, dealt by id, and the ranks follow from it and from what ``update`` sums up."""
    partitions = int(structure.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrived = ranks.select("id").join(_messages(structure, ranks), "id", "left").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    arrived = cut_by(arrived, "id", partitions)
    return arrived.select("id", update(structure, ranks, arrived).alias("p"))


def _iterate(nodes: DataFrame, sources: Sequence[int] | None, iterations: int, update, tolerance: float | None = None) -> DataFrame:
    """(id, adj, p) after the rounds, or earlier once ranks move by at most ``tolerance`` in sum."""
    structure = dealt(nodes)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = cut_by(build_ranked_nodes(structure, sources).select("id", "p"), "id", partitions)
    for _ in range(iterations):
        before, ranks = ranks, _round(structure, ranks, update)
        if tolerance is not None:
            moved = ranks.join(before.withColumnRenamed("p", "was"), "id").agg(F.sum(F.abs(F.col("p") - F.col("was")))).first()[0]
            if (moved or 0.0) <= tolerance:
                break
    return structure.join(ranks, "id").select("id", "adj", "p")


def personalized_pagerank(nodes: DataFrame, sources: Sequence[int], iterations: int, alpha: float = ALPHA, tolerance: float | None = None) -> DataFrame:
    """(id, adj, p) after the iterations. Jumps and dangling mass go to the sources; total mass stays 1 unless edges leave the graph."""
    distinct = sorted(set(sources))

    def update(structure: DataFrame, ranks: DataFrame, _: DataFrame) -> Column:
        dangling = structure.where(F.size("adj") == 0).select("id").join(ranks, "id").agg(F.sum("p")).first()[0] or 0.0
        jump = F.when(F.col("id").isin(distinct), F.lit((alpha + (1 - alpha) * dangling) / len(distinct))).otherwise(F.lit(0.0))
        return (1 - alpha) * F.col("mass") + jump

    return _iterate(nodes, distinct, iterations, update, tolerance)


def pagerank(nodes: DataFrame, iterations: int, alpha: float = ALPHA, tolerance: float | None = None) -> DataFrame:
    """(id, adj, p): p' = alpha/n + (1-alpha) * (mass + missing/n), where missing is what dangling nodes and dead edges lose.

    With a ``tolerance`` the iterations are a limit, and the ranks are those at which a round moves less than that in sum.
    """

    def update(_structure: DataFrame, _ranks: DataFrame, arrived: DataFrame) -> Column:
        n, known = arrived.agg(F.count("*"), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
        missing = max(0.0, 1.0 - known)
        return F.lit(alpha / max(n, 1)) + (1 - alpha) * (F.col("mass") + F.lit(missing / max(n, 1)))

    return _iterate(nodes, None, iterations, update, tolerance)


def message_counters(ranked: DataFrame) -> DataFrame:
    """One row for a round over (id, adj, p): nodes that send, the messages they send, and those that combining by receiver saves."""
    active = ranked.where((F.size("adj") > 0) & (F.col("p") > 0))
    received = active.select(F.explode("adj").alias("id")).agg(F.countDistinct("id")).scalar()
    sent = F.coalesce(F.sum(F.size("adj")), F.lit(0)).cast("bigint")
    return active.agg(F.count("*").alias("n_active"), sent.alias("n_messages")).withColumn("n_saved", F.col("n_messages") - received)


def ranked_order(ranked: DataFrame) -> DataFrame:
    """(id, p, log_p): every node by descending rank, ties by id; log_p is the natural logarithm."""
    return ranked.select("id", "p", F.log("p").alias("log_p")).orderBy(F.desc("p"), "id")


def top_nodes(ranked: DataFrame, n: int = 100) -> DataFrame:
    """The n highest ranks, ties by id."""
    return ranked.select("id", "p").orderBy(F.desc("p"), "id").limit(n)


def dump_nodes(ranked: DataFrame) -> DataFrame:
    """(id, record): ``{id rank [neighbours]}``, of which the first ten neighbours are shown."""
    shown = F.array_join(F.slice("adj", 1, 10).cast("array<string>"), ", ")
    return ranked.select("id", F.format_string("{%d %.4f [%s]}", "id", "p", shown).alias("record"))


def partition_nodes(nodes: DataFrame, partitions: int, by_range: bool = False, node_count: int | None = None) -> DataFrame:
    """Nodes with the partition they are dealt to: hash of id, or the id range floor(id / node_count * partitions)."""
    if by_range:
        if not node_count:
            raise ValueError("range partitioning needs node_count")
        part = F.pmod(F.floor(F.col("id") / F.lit(float(node_count)) * partitions), F.lit(partitions))
    else:
        part = F.pmod(F.hash("id"), F.lit(partitions))
    dealt = nodes.withColumn("part", part.cast("int"))
    return dealt.repartitionById(partitions, F.col("part"))


def graph_counters(nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, dangling nodes and messages to nodes without a record."""
    edges = nodes.select(F.explode("adj").alias("id"))
    missing = edges.join(nodes.select("id"), "id", "left_anti").agg(F.count("*")).scalar()
    return nodes.agg(
        F.count("*").alias("n_nodes"),
        F.coalesce(F.sum(F.size("adj")), F.lit(0)).cast("bigint").alias("n_edges"),
        F.count_if(F.size("adj") == 0).alias("n_dangling"),
    ).withColumn("n_missing", missing)


def weak_components(nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges. Nodes without edges are components of their own.

    Edges to unknown nodes don't count.
    """
    edges = nodes.select(F.col("id").alias("a"), F.explode("adj").alias("b")).where("a <> b").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    return component_labels(edges.select("a", "b"), nodes.select("id"))


def _renamed(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``rows`` with the column's ids replaced by what they hook onto."""
    found = hooks.select(F.col("id").alias(column), "up")
    return rows.join(found, column, "left").withColumn(column, F.coalesce("up", column)).select(*rows.columns)


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks (id, up), up < id, each led to the end of its chain: chains double their reach each time."""
    while True:
        after = hooks.select(F.col("id").alias("up"), F.col("up").alias("further"))
        longer = cut(hooks.join(after, "up", "left").select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if not longer.where("moved").limit(1).count():
            return hooks
        hooks = longer.drop("moved")


def component_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) from undirected edges (a, b); without ``nodes``, for the edges' ends alone. Null ids have no label.

    Each round every root hooks onto the smallest of its smaller neighbours, hooks are followed to their ends, and the edges are
    drawn anew between roots, without copies. Two rounds at least halve the roots that have edges: roots that a round leaves are
    local minima, and of these the next leaves at most one for each root hooked before. So rounds grow with the logarithm of the
    number of nodes, whatever the shape and the order of ids; every round is written to the checkpoint folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if nodes is None:
        nodes = both.select(F.col("a").alias("id")).distinct()
    labels, live = nodes.where("id is not null").select("id", F.col("id").alias("component")), both.where("a <> b")
    while live.limit(1).count():
        hooks = _followed(cut(live.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).where("up < id")))
        labels = cut(_renamed(labels, "component", hooks))
        live = cut(_renamed(_renamed(live, "a", hooks), "b", hooks).where("a <> b").distinct())
    return labels


def part_sequence_graph(lineitem: DataFrame, part: DataFrame, before: str = "1996-01-01") -> DataFrame:
    """A graph over part keys: each part points to the next part of the same order, for items shipped before a day."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = lineitem.where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edges = items.select(F.col("l_partkey").alias("id"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null and id <> dst").distinct()
    adj = edges.groupBy("id").agg(F.sort_array(F.collect_list("dst")).alias("adj"))
    none = F.array().cast("array<bigint>")
    return part.select(F.col("p_partkey").alias("id")).join(adj, "id", "left").select("id", F.coalesce("adj", none).alias("adj"))
