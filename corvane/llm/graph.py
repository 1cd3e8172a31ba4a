"""Connected components of an edge table, and of the links within buckets without forming their pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import saved, small, tasks_for

#: Leaders of a bucket, and of one whose members' texts are fetched.
LEADERS, LEADERS_WITH_TEXTS = 4, 2


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    edges = edges.coalesce(tasks)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    joined = both.filter("v > u").join(_least(both), "u").coalesce(tasks)
    return joined.select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined = down.join(_least(down), "u").coalesce(tasks)
    pairs = joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("p"))
    return pairs.select("p.a", "p.b").filter("a <> b").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) for every node of the edges (a, b: long).

    Large and small stars alternate until the edges stay as they are.
    Each round costs two aggregations and two joins of the edges, which become fewer; hubs are
    aggregated before the shuffle and their joins are split by adaptive execution. The number of
    rounds grows with the logarithm of the longest path. Few edges run in few tasks, however many
    partitions a shuffle has: a round has some ten stages, and each task leaves files. An edge from a node to itself adds nothing.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        tasks = tasks_for(edges.sparkSession, now[0])
        edges = saved(_small_star(_large_star(edges, tasks), tasks))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def linked(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], alike: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of a saved table whose a and b have bodies that are alike; each body is fetched once."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    bodies = texts(ends)
    both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    both = both.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return both.filter(alike(F.col("x"), F.col("y"))).select(*pairs.columns)


def _led_by_joins(members: DataFrame, n_leaders: int) -> DataFrame:
    """Distinct members of buckets of several, with size and leaders of their bucket: the one in most buckets, others by hashes."""
    members = saved(members)
    weights = members.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    entry, rank = F.struct("node", "sign"), F.struct("weight", "node")
    others = (F.min_by(entry, F.xxhash64("node", F.lit(i))) for i in range(1, n_leaders))
    leaders = F.array_distinct(F.array(F.max_by(entry, rank), *others)).alias("leaders")
    buckets = members.join(weights, "node").groupBy("key").agg(F.count(F.lit(1)).alias("size"), leaders)
    buckets = saved(buckets.filter("size > 1"))
    return members.join(small(buckets, 2 * F.size("leaders")), "key")


def _led_by_windows(members: DataFrame, n_leaders: int) -> DataFrame:
    """As ``_led_by_joins``; the first leader is the one whose buckets are the largest taken together."""
    whole = Window.partitionBy("key")
    members = saved(members.withColumn("size", F.count(F.lit(1)).over(whole)).filter("size > 1"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    entry, rank = F.struct("node", "sign"), F.struct("weight", "node")
    first = F.max_by(entry, rank).over(whole)
    others = (F.min_by(entry, F.xxhash64("node", F.lit(i))).over(whole) for i in range(1, n_leaders))
    return members.join(weights, "node").withColumn("leaders", F.array_distinct(F.array(first, *others)))


def bucket_components(
    members: DataFrame,
    close: Callable[[Column, Column], Column] | None = None,
    texts: Callable[[DataFrame], DataFrame] | None = None,
    alike: Callable[[Column, Column], Column] | None = None,
    across: Callable[[DataFrame], DataFrame] | None = None,
    by_window: bool = False,
) -> DataFrame:
    """node, component over the links of nodes that meet in buckets.

    ``members`` has rows (key, node, sign) of buckets of several nodes. Two are linked if
    ``close`` (of their signs) and ``alike`` (of what ``texts`` gives as node, body for a table of
    nodes) both hold; what is None holds always.

    In each bucket a few members are leaders: the one in most buckets,
    as a text is from which others were made, and some by hashes. All members are compared with
    those first, and components of these links are found. Then only members of buckets that still hold several
    components are compared, across components alone. ``across`` does so, if it is given: it takes those nodes
    as node, own (their component) and returns their links a, b. Otherwise members outside of a bucket's main
    component are compared with the rest of it within the join, so that no unlinked pair leaves it. No link is lost: two members that are linked are in one
    component, or were compared. A bucket's size and leaders come from partial aggregates, one row a bucket, that
    its members are joined to; or, ``by_window``, from windows, which move and keep fewer bytes where nodes have wide signs and many keys, but hold a
    bucket in one task.
    """
    n_leaders = LEADERS_WITH_TEXTS if texts else LEADERS
    members = (_led_by_windows if by_window else _led_by_joins)(members.select("key", "node", "sign").distinct(), n_leaders)

    def fits(leader: Column) -> Column:
        other = leader["node"] != F.col("node")
        return other & close(leader["sign"], F.col("sign")) if close else other

    near = F.transform(F.filter("leaders", fits), lambda x: x["node"])
    members = saved(members.select("key", "node", "sign", "size", F.size("leaders").alias("led"), near.alias("near")))
    # a node's leaders over all its buckets are as few as its keys, so they are made distinct by node
    near = members.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    stars = near.select(F.col("node").alias("a"), F.explode("near").alias("b"))
    if texts and alike:
        stars = linked(saved(stars), texts, alike)
    first = saved(components(stars))

    # where all members but one are leaders, every pair has been compared
    known = members.filter("led < size - 1").select("key", "node", "sign").join(first, "node", "left")
    known = saved(known.select("key", "node", "sign", F.coalesce("component", "node").alias("own")))
    main = known.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("own", F.struct("n", "own")).alias("main"), (F.count(F.lit(1)) > 1).alias("several")
    )
    mixed = saved(known.join(main.filter("several").select("key", "main"), "key"))
    if across:
        bridges = saved(across(mixed.select("node", "own").distinct()).distinct())
        return _bridged(first, bridges)
    rest = mixed.withColumn("body", F.lit(0))
    if texts and alike:
        if close:
            # texts are fetched only of members that fit one of another component; no pair leaves this join
            other = mixed.select(F.col("key").alias("at"), F.col("sign").alias("signed"), F.col("own").alias("part"))
            fit = (F.col("at") == F.col("key")) & (F.col("part") != F.col("own")) & close(F.col("signed"), F.col("sign"))
            mixed = saved(mixed.join(other, fit, "left_semi"))
        rest = mixed.join(texts(mixed.select("node").distinct()), "node")
    rest = saved(rest.select("key", "node", "sign", "own", "main", "body"))
    apart = rest.filter("own <> main").select(
        F.col("key").alias("at"), F.col("node").alias("other"), F.col("sign").alias("signed"), F.col("own").alias("part"), F.col("body").alias("against")
    )
    meets = (F.col("at") == F.col("key")) & (F.col("part") != F.col("own"))
    # of two members that are both apart, one comes second
    meets = meets & ((F.col("own") == F.col("main")) | (F.col("part") < F.col("own")))
    meets = meets & close(F.col("signed"), F.col("sign")) if close else meets
    meets = meets & alike(F.col("against"), F.col("body")) if texts and alike else meets
    found = apart.join(rest, meets).select(F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b"))
    bridges = saved(found.distinct())
    return _bridged(first, bridges)


def _bridged(first: DataFrame, bridges: DataFrame) -> DataFrame:
    """The components of links a, b besides those of ``first``."""
    if bridges.isEmpty():
        return first
    return components(bridges.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))
