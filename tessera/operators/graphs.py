"""Connected components and ordered leader clustering, both as rounds of joins and aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, discard


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component), the component being named by its smallest node.

    ``nodes`` has ``node``, ``edges`` has ``a`` and ``b`` (longs). Alternating large-star and small-star
    rounds (Kiveris et al., SoCC 2014). Neighbour minima are aggregates joined back to the edges, so a
    node with very many neighbours is never gathered in one place. Each round is checkpointed.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e)
    while not _all_stars(e):
        e = cut_lineage(_small_star(_large_star(e)))
    labels = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _all_stars(e: DataFrame) -> bool:
    """True when every node has one edge, and it points at a node without an edge of its own."""
    forks = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    chains = e.select("v").join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("v")
    return forks.union(chains).isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest one around that node."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    out = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (edges point from u down to v)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _chain_ends(links: DataFrame) -> DataFrame:
    """(node, at, turns) for links (node, before): the end of each node's chain of links, and whether it is an odd way off.

    Pointers are doubled, so a chain of n links takes log2(n) rounds. ``before`` is smaller than ``node``.
    """
    at = cut_lineage(links.select("node", F.col("before").alias("at"), F.lit(1).alias("turns")))
    while True:
        onward = at.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("turns").alias("more"))
        far = at.join(onward, "at", "left").select(
            "node", F.coalesce("next", "at").alias("at"), ((F.col("turns") + F.coalesce("more", F.lit(0))) % 2).alias("turns"), F.col("next").isNotNull().alias("moved")
        )
        far = cut_lineage(far)
        discard(at)
        at = far.drop("moved")
        if far.filter("moved").isEmpty():
            return at


def _decided_by_chains(links: DataFrame, state: DataFrame) -> DataFrame:
    """(node, leads) of the nodes whose chain of ``links`` ends at a decided node.

    A link (node, before) says that ``before`` is all that ``node`` still waits for: it leads exactly if ``before`` does not.
    """
    if links.isEmpty():
        return state.limit(0)
    ends = _chain_ends(links)
    return ends.join(state.select(F.col("node").alias("at"), "leads"), "at").select("node", ((F.col("leads") + F.col("turns")) % 2).cast("int").alias("leads"))


def leaders_by_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered greedy clustering over a similarity graph: (node, leader).

    Scanning nodes in ascending order, a node with no earlier leader neighbour leads; any other joins
    its earliest leader neighbour. The leaders are thus the first maximal independent set in order.
    ``nodes`` has ``node`` (its value is its place in the scan), ``pairs`` has ``a`` < ``b``.

    A round decides every node whose earlier neighbours are all decided, and then whole chains: nodes
    with one open earlier neighbour are the opposite of it, and such links are followed by doubling
    pointers. All work is joins and aggregates; a component is never gathered in one place.
    """
    pairs = cut_lineage(pairs.select("a", "b"))
    # state: 1 leads, 0 follows; nodes without an earlier neighbour lead from the start
    firsts = pairs.select(F.col("a").alias("node")).distinct().join(
        pairs.select(F.col("b").alias("node")).distinct(), "node", "left_anti"
    )
    state = cut_lineage(firsts.select("node", F.lit(1).alias("leads")))
    open_pairs = pairs
    while True:
        # what the earlier node of each open pair is known to be
        seen = open_pairs.join(state, open_pairs["a"] == state["node"], "left").select("a", "b", "leads")
        verdict = seen.groupBy("b").agg(
            F.max("leads").alias("any_leader"),
            F.count_if(F.col("leads").isNull()).alias("unknown"),
            F.min(F.when(F.col("leads").isNull(), F.col("a"))).alias("before"),
        )
        verdict = cut_lineage(verdict.withColumnRenamed("b", "node"))
        done = "any_leader = 1 or unknown = 0"
        fresh = verdict.filter(done).select("node", F.when(F.col("any_leader") == 1, 0).otherwise(1).alias("leads"))
        known = cut_lineage(state.unionByName(fresh))
        chained = _decided_by_chains(verdict.filter(f"not coalesce({done}, false) and unknown = 1").select("node", "before"), known)
        grown = cut_lineage(known.unionByName(chained))
        left = cut_lineage(open_pairs.join(grown, open_pairs["b"] == grown["node"], "left_anti"))
        discard(state, known, verdict, *([open_pairs] if open_pairs is not pairs else []))
        state, open_pairs = grown, left
        if open_pairs.isEmpty():
            break
    followers = state.filter("leads = 0").select("node")
    lead = nodes.select("node").join(followers, "node", "left_anti")
    first_leader = (
        pairs.join(lead.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    )
    return lead.select("node", F.col("node").alias("leader")).unionByName(followers.join(first_leader, "node"))


def leaders_by_keys(keys: DataFrame) -> DataFrame:
    """Ordered greedy clustering where two nodes are neighbours when they share a key.

    ``keys`` has (node, priority, key), one row per key of a node; ``key`` must differ between kinds of
    key. Returns (node, leader) for nodes with keys: a node whose keys are all free when its turn comes
    leads and takes them; any other joins the owner of its first taken key by priority.

    Pairs are never built: a round finds each key's first two open nodes by an aggregate, so a key
    shared by a third of all rows costs one row per task. A node that is first or second on all its
    open keys, and second behind one node only, is the opposite of that node; chains of such nodes are
    decided at once, by doubling pointers.
    """
    keys = cut_lineage(keys.select("node", "priority", "key").distinct())
    open_keys = keys
    owners: DataFrame | None = None
    while True:
        first = open_keys.groupBy("key").agg(F.min("node").alias("first"))
        later = open_keys.join(first, "key")
        second = later.filter("node > first").groupBy("key").agg(F.min("node").alias("second"))
        place = later.join(second, "key", "left").groupBy("node").agg(
            F.min(F.expr("if(node > first, first, null)")).alias("before"),
            F.max(F.expr("if(node > first, first, null)")).alias("last_before"),
            F.max(F.expr("node > first and node > second")).alias("waits"),
        )
        place = cut_lineage(place)
        leads = place.filter("before is null").select("node", F.lit(1).alias("leads"))
        links = place.filter("before = last_before and not coalesce(waits, false)").select("node", "before")
        leads = cut_lineage(leads.unionByName(_decided_by_chains(links, leads)))
        fresh_leaders = leads.filter("leads = 1").select("node")
        fresh = cut_lineage(open_keys.join(fresh_leaders, "node", "left_semi").select("key", F.col("node").alias("owner")))
        owners = fresh if owners is None else cut_lineage(owners.unionByName(fresh))
        # leaders and every node holding a key that is now taken are decided
        decided = open_keys.join(fresh, "key").filter("node >= owner").select("node").distinct()
        left = cut_lineage(open_keys.join(decided, "node", "left_anti"))
        discard(place, leads, *([open_keys] if open_keys is not keys else []))
        open_keys = left
        if open_keys.isEmpty():
            break
    # an owner later in the scan took the key after this node was decided, so it does not count
    choices = keys.join(owners, "key").filter("owner <= node")
    return choices.groupBy("node").agg(F.min_by("owner", "priority").alias("leader"))
