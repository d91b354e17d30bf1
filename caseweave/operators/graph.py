"""Graph measures per case on (nodes, edges) DataFrames.

nodes: (case_id, id, …); edges: (case_id, source, target, …).  Measures use the
undirected simple graph; isolates stay nodes.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import connections, neighbor_pairs, undirected_pairs
from .iteration import cut, dealt, settle
from .windows import top_k

EDGES_PER_SALT = 100_000
DENSE_NODES = 1_000_000
SPLIT_NODES = 2_000
PART_LINKS = 8_000_000
SOURCES_PER_TASK = 256  # that are followed at once
BLOCK_CELLS = 4_000_000  # (node, source) cells of them, 32 MB an array
BROAD_LINKS, BROAD_CELLS = 8, 32_768  # a node's links and the cells of parts that a search covers in a few broad layers
TASK_VISITS = 2_000_000_000  # sources times links of a task
TASKS_PER_PART = 256  # each gets the part's links
NODE_BITS = 31
ROUND_ROWS = 2_000_000_000


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and distinct unordered pairs whose ends are nodes."""
    from .joins import drop_dangling
    vertices = nodes.select("case_id", "id").distinct()
    return vertices, undirected_pairs(drop_dangling(edges, vertices))


def _as_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select("case_id", F.col("a").alias("source"), F.col("b").alias("target"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """(case_id, id, neighbor); self-loops left out."""
    return neighbor_pairs(_as_edges(pairs.filter("a <> b")))


def degree_centrality(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """degree / (n - 1); a single node has centrality 1."""
    sizes = nodes.groupBy("case_id").agg(F.count("*").alias("n"))
    degree = connections(nodes, _as_edges(pairs)).join(sizes, "case_id")
    return degree.select("case_id", "id", "connections", F.when(F.col("n") > 1, F.col("connections")
                         / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("degree"))


def pagerank(nodes: DataFrame, pairs: DataFrame, alpha: float = 0.85, tol: float | None = 1e-6,
             max_iter: int = 100, check_every: int = 5) -> DataFrame:
    """PageRank by power iteration, all cases at once.

    A hub's links are spread over several salts (its node row is repeated per
    salt), so no join key exceeds EDGES_PER_SALT rows.  Isolated nodes all hold
    the same rank, hence their redistributed mass is a row-local recurrence and
    an iteration needs one join and one sum.  Ranks that still move by more than ``tol`` a node after ``max_iter``
    iterations are an error; without ``tol`` exactly ``max_iter`` iterations are made.
    """
    loops = pairs.filter("a = b").select("case_id", F.col("a").alias("id"), F.col("a").alias("neighbor"))
    links = both_directions(pairs).unionByName(loops)
    out_degree = links.groupBy("case_id", "id").agg(F.count("*").alias("out"))
    known = nodes.join(out_degree, ["case_id", "id"], "left").withColumn("out", F.coalesce("out", F.lit(0)))
    sizes = known.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("out") == 0).alias("n_iso"))
    base = cut(known.join(sizes, "case_id"))
    salts = F.ceil(F.col("out") / EDGES_PER_SALT)
    adjacency = (links.join(base.select("case_id", "id", "out"), ["case_id", "id"])
                 .select("case_id", "id", "neighbor", F.pmod(F.hash("neighbor"), salts).alias("salt")))
    adjacency = dealt(adjacency, ["case_id", "id", "salt"])
    ranks = base.withColumns({"rank": 1.0 / F.col("n"), "floor": 1.0 / F.col("n"), "previous": F.lit(0.0)})
    for step in range(1, max_iter + 1):
        shares = (ranks.filter("out > 0")
                  .select("case_id", "id", (F.col("rank") / F.col("out")).alias("share"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt")))
        received = (adjacency.join(shares, ["case_id", "id", "salt"])
                    .groupBy("case_id", F.col("neighbor").alias("id")).agg(F.sum("share").alias("received")))
        floor = (alpha * F.col("n_iso") * F.col("floor") + (1 - alpha)) / F.col("n")
        ranks = (ranks.join(received, ["case_id", "id"], "left")
                 .select("case_id", "id", "out", "n", "n_iso",
                         (floor + alpha * F.coalesce("received", F.lit(0.0))).alias("rank"),
                         floor.alias("floor"), F.col("rank").alias("previous")))
        if step % check_every == 0 or step == max_iter:
            ranks = cut(ranks)
            if tol is not None and not _moving(ranks, tol):
                break
    else:
        if tol is not None:
            raise RuntimeError(f"ranks still move by more than {tol} a node after {max_iter} iterations")
    return ranks.select("case_id", "id", F.col("rank").alias("pagerank"))


def _moving(ranks: DataFrame, tol: float) -> bool:
    drift = ranks.groupBy("case_id").agg(F.sum(F.abs(F.col("rank") - F.col("previous"))).alias("e"),
                                         F.max("n").alias("n"))
    return bool(drift.filter(F.col("e") >= F.col("n") * tol).limit(1).count())


def components(pairs: DataFrame) -> DataFrame:
    """(case_id, id, component): the smallest node that each end of pairs (case_id, a, b) reaches; pairs with a = b say nothing.

    Links move to the smallest neighbour of their smaller end, then to that of their larger one, until all are stars.  A
    round is two joins; the first one shrinks the links to about the nodes, and the rounds rise with the logarithm of the nodes.
    """
    stars = pairs.filter("a <> b").select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        least = neighbor_pairs(_as_edges(stars)).groupBy("case_id", F.col("id").alias("a")).agg(F.min(F.least("id", "neighbor")).alias("m"))
        up = settle(stars.join(least, ["case_id", "a"]).select("case_id", F.col("m").alias("a"), "b").distinct(), "stars")
        lowest = up.groupBy("case_id", "b").agg(F.min("a").alias("m"))
        stars = settle(up.join(lowest, ["case_id", "b"]).select("case_id", "m", F.explode(F.array("a", "b")).alias("b"))
                       .filter("m <> b").select("case_id", F.col("m").alias("a"), "b").distinct(), "stars")
        ends = stars.select("case_id", F.col("a").alias("id"), F.lit(0).alias("under")).unionByName(
            stars.select("case_id", F.col("b").alias("id"), F.lit(1).alias("under")))
        if ends.groupBy("case_id", "id").agg(F.sum("under").alias("n"), F.min("under").alias("top")).filter(
                (F.col("n") > 1) | ((F.col("n") > 0) & (F.col("top") == 0))).isEmpty():
            break
    leaves = stars.select("case_id", F.col("b").alias("id"), F.col("a").alias("component"))
    return leaves.unionByName(stars.select("case_id", F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _block_betweenness(pdf: pd.DataFrame) -> pd.DataFrame:
    """Path counting from a task's share of a part's nodes; code is a link's two nodes, or minus one minus a node to start from.

    Nodes are numbered from 0, each with a link.  Some SOURCES_PER_TASK of the task's sources are followed at once, as far as
    BLOCK_CELLS holds them (few where links are many, so that what is summed over stays in the processor's cache), then the
    next ones: memory follows the links and not their product with the sources.
    """
    code = pdf["code"].to_numpy()
    sources, links = -1 - code[code < 0], code[code >= 0]
    a, b = (links >> NODE_BITS).astype(np.int32), (links & ((1 << NODE_BITS) - 1)).astype(np.int32)
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    neighbor = other[np.argsort(ends, kind="stable")].astype(np.int64)
    degree = np.bincount(ends)
    del code, links, a, b, ends, other
    raw, squares = np.zeros(len(degree)), np.zeros(len(degree))
    cells = BROAD_CELLS if len(neighbor) >= BROAD_LINKS * len(degree) else BLOCK_CELLS
    most = max(1, min(SOURCES_PER_TASK, cells // len(degree)))
    for i in range(0, len(sources), most):
        credit = _credits(neighbor, degree, sources[i:i + most])
        raw += credit.sum(axis=0)
        squares += np.einsum("ij,ij->j", credit, credit)
    found = np.flatnonzero(raw > 0)
    return pd.DataFrame({"part": pdf["part"].iloc[0], "place": found.astype(np.int32), "raw": raw[found], "squares": squares[found]})


def _credits(neighbor: np.ndarray, degree: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What the shortest paths of each source owe to each node (source, node).

    Layers are kept as places (source * nodes + node).  A thin layer walks its own links, a broad one is reached from the
    nodes that are still open where those have few links, else it sums over all, a source after the other.  So long paths
    cost what they hold and dense graphs no more than their links.
    """
    n, k = len(degree), len(sources)
    starts, full = np.cumsum(degree) - degree, len(neighbor) * k
    level = np.full(n * k, -1, np.int32)
    paths, credit = np.zeros(n * k), np.zeros(n * k)

    def walk(places, reach):
        """Places at the far ends of the links of places."""
        node = places % n
        first = np.repeat(starts[node] - (np.cumsum(reach) - reach), reach)
        return neighbor[first + np.arange(len(first))] + np.repeat(places - node, reach)

    def pulled(places, values, wanted):
        """Sums at wanted over the links to places, which hold values."""
        whole = np.zeros(n * k)
        whole[places] = values
        reach = degree[wanted % n]
        if reach.sum() * 4 < full:
            return np.add.reduceat(whole[walk(wanted, reach)], np.cumsum(reach) - reach) if len(wanted) else np.zeros(0)
        out = whole.reshape(k, n)
        for s in np.unique(places // n):
            out[s] = np.add.reduceat(out[s][neighbor], starts)
        return whole[wanted]

    layers = [np.arange(k) * n + sources.astype(np.int64)]
    paths[layers[0]], level[layers[0]] = 1.0, 0
    reached = k
    while reached < n * k:
        last = layers[-1]
        reach = degree[last % n]
        if reach.sum() * 8 < full:
            to = walk(last, reach)
            new = level[to] < 0
            np.add.at(paths, to[new], np.repeat(paths[last], reach)[new])
            place = np.unique(to[new])
        else:
            rest = np.flatnonzero(level < 0)
            given = pulled(last, paths[last], rest)
            place = rest[given > 0]
            paths[place] = given[given > 0]
        if not len(place):
            break
        level[place] = len(layers)
        layers.append(place)
        reached += len(place)
    for depth in range(len(layers) - 1, 0, -1):
        place, before = layers[depth], layers[depth - 1]
        share = (1.0 + credit[place]) / paths[place]
        reach = degree[place % n]
        if reach.sum() * 8 < full:
            to = walk(place, reach)
            back = level[to] == depth - 1
            np.add.at(credit, to[back], np.repeat(share, reach)[back])
            credit[before] *= paths[before]
        else:
            credit[before] = pulled(place, share, before) * paths[before]
    credit[layers[0]] = 0.0
    return credit.reshape(k, n)


def parts(proper: DataFrame, sizes: DataFrame, dense_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Linked nodes (case_id, id, part, place) of the parts that a task can hold, and the linked nodes (case_id, id) of all others.

    A part is what hangs together in a case of over SPLIT_NODES nodes, else the case: no path leaves it.
    """
    ends = proper.select("case_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = ends.join(sizes.filter(F.col("n") <= SPLIT_NODES), "case_id", "left_semi").withColumn("part", F.lit(None).cast("string"))
    big = sizes.filter(F.col("n") > SPLIT_NODES)
    if not big.isEmpty():
        split = components(proper.join(big.select("case_id"), "case_id", "left_semi"))
        whole = whole.unionByName(split.select("case_id", "id", F.col("component").cast("string").alias("part")))
    whole = settle(whole, "parts")
    links = proper.select("case_id", F.col("a").alias("id")).join(whole, ["case_id", "id"]).groupBy("case_id", "part").agg(F.count("*").alias("links"))
    held = whole.groupBy("case_id", "part").agg(F.count("*").alias("size")).withColumn("p", F.coalesce("part", F.lit("")))
    held = settle(held.join(links.select("case_id", F.coalesce("part", F.lit("")).alias("p"), "links"), ["case_id", "p"])
            .filter((F.col("size") <= dense_nodes) & (F.col("links") <= PART_LINKS)).select("case_id", "p", "size", "links", F.monotonically_increasing_id().alias("part")), "held")
    known = whole.select("case_id", "id", F.coalesce("part", F.lit("")).alias("p")).join(held, ["case_id", "p"], "left")
    order = Window.partitionBy("part").orderBy("id")  # at most dense_nodes rows a part
    small = settle(known.filter("size is not null").select("case_id", "id", "part", "size", "links", (F.row_number().over(order) - 1).alias("place")), "small")
    return small, settle(known.filter("size is null").select("case_id", "id"), "large")


def betweenness(nodes: DataFrame, pairs: DataFrame, dense_nodes: int = DENSE_NODES,
                source_rounds: int | None = None, pivots: int | None = None) -> DataFrame:
    """Normalized shortest-path betweenness, endpoints excluded.

    Cases fall into parts without links between them.  A part of at most ``dense_nodes`` nodes and PART_LINKS links is some
    tasks, each with the part's links and a share of its nodes to start from; larger ones run level-synchronously over
    distributed (source, node) tables, their sources split in rounds so that one round holds about ROUND_ROWS rows.  Both
    give the same.  With ``pivots`` only that many sources per case, those of the smallest hash, are followed and their sum
    is scaled up: an estimate for cases whose n squared is too large.
    """
    sizes = settle(nodes.groupBy("case_id").agg(F.count("*").alias("n")), "sizes")
    vertices = nodes.select("case_id", "id").distinct()
    sources = vertices if pivots is None else settle(top_k(vertices, ["case_id"], [F.md5("id"), F.col("id")], pivots), "sources")
    proper = pairs.filter("a <> b")
    raws = []
    if dense_nodes:
        proper = settle(proper.select("case_id", "a", "b"), "pairs")
        small, large = parts(proper, sizes, dense_nodes)
        raws.append(task_dependencies(small, proper, sources).drop("squares"))
        sources = sources.join(large, ["case_id", "id"], "left_semi")
        proper = proper.join(large.withColumnRenamed("id", "a"), ["case_id", "a"], "left_semi")
        if large.isEmpty():
            sources = None
    if sources is not None:
        large_nodes = settle(sources.join(sizes, "case_id").select("case_id", "id", "n"), "sources")
        volume = large_nodes.agg(F.sum(F.col("n").cast("double"))).first()[0]
        if volume:
            source_rounds = source_rounds or int(-(-volume // ROUND_ROWS))
            links = settle(both_directions(proper).select("case_id", "id", "neighbor"), "links")
            raws += [layered_dependencies(large_nodes.filter(F.pmod(F.hash("id"), F.lit(source_rounds)) == r), links).drop("squares")
                     for r in range(source_rounds)]
    if not raws:
        return nodes.select("case_id", "id", F.lit(0.0).alias("betweenness"))
    raw = reduce(lambda a, b: a.unionByName(b), raws).groupBy("case_id", "id").agg(F.sum("raw").alias("raw"))
    scale = F.lit(1.0) if pivots is None else F.col("n") / F.least(F.col("n"), F.lit(pivots))
    pairs_of = (F.col("n") - 1) * (F.col("n") - 2)
    return (nodes.select("case_id", "id").join(sizes, "case_id").join(raw, ["case_id", "id"], "left")
            .select("case_id", "id", F.when(F.col("n") > 2, F.coalesce("raw", F.lit(0.0)) * scale / pairs_of)
                    .otherwise(F.lit(0.0)).alias("betweenness")))


def task_dependencies(small: DataFrame, proper: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, id, raw, squares) of parts that a task can hold, each dealt to as many tasks as its sources times links ask for."""
    own = small.join(sources.select("case_id", "id"), ["case_id", "id"], "left_semi")
    wanted = F.ceil(F.count("*") * F.max("links").cast("double") / TASK_VISITS)
    blocks = settle(own.groupBy("part").agg(F.least(F.lit(TASKS_PER_PART), wanted).cast("int").alias("blocks")), "blocks")
    starts = own.join(blocks, "part").select("part", F.pmod(F.col("place"), F.col("blocks")).alias("block"),
                                             (-1 - F.col("place")).cast("bigint").alias("code"))
    at = lambda c, *more: small.select("case_id", F.col("id").alias(c), F.col("place").cast("bigint").alias(f"at_{c}"), *more)
    links = (proper.join(at("a", "part"), ["case_id", "a"]).join(at("b"), ["case_id", "b"]).join(blocks, "part")
             .select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                     (F.shiftleft("at_a", NODE_BITS) + F.col("at_b")).alias("code")))
    raw = links.unionByName(starts).groupBy("part", "block").applyInPandas(_block_betweenness, "part long, place int, raw double, squares double")
    return raw.join(small.select("case_id", "part", "place", "id"), ["part", "place"]).select("case_id", "id", "raw", "squares")


def layered_dependencies(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, id, raw, squares): sums over the given sources (case_id, id) of what each one's shortest paths owe to a
    node, and of its square, layer by layer.  A layer holds the (source, node) pairs it reaches and no others."""
    frontier = settle(sources.select("case_id", F.col("id").alias("s"), F.col("id").alias("v"),
                                  F.lit(1.0).alias("paths")))
    layers, seen = [frontier], frontier.select("case_id", "s", "v")
    edges = links.select("case_id", F.col("id").alias("v"), F.col("neighbor").alias("w"))
    while True:
        reached = (frontier.join(edges, ["case_id", "v"])
                   .groupBy("case_id", "s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths")))
        frontier = settle(reached.join(seen, ["case_id", "s", "v"], "left_anti"))
        if not frontier.limit(1).count():
            break
        layers.append(frontier)
        # two layers suffice to exclude earlier ones: a neighbour is at most one layer back
        seen = layers[-1].select("case_id", "s", "v").unionByName(layers[-2].select("case_id", "s", "v"))
    deeper = layers[-1].withColumn("credit", F.lit(0.0))
    parts = [deeper]
    for layer in reversed(layers[:-1]):
        back = edges.select("case_id", F.col("v").alias("w"), F.col("w").alias("v"))
        given = (deeper.withColumnRenamed("v", "w").withColumn("each", (1.0 + F.col("credit")) / F.col("paths"))
                 .select("case_id", "s", "w", "each").join(back, ["case_id", "w"])
                 .groupBy("case_id", "s", "v").agg(F.sum("each").alias("each")))
        deeper = settle(layer.join(given, ["case_id", "s", "v"], "left")
                     .select("case_id", "s", "v", "paths",
                             (F.coalesce("each", F.lit(0.0)) * F.col("paths")).alias("credit")))
        parts.append(deeper)
    every = reduce(lambda a, b: a.unionByName(b), parts).filter("s <> v")
    return every.groupBy("case_id", F.col("v").alias("id")).agg(F.sum("credit").alias("raw"), F.sum(F.col("credit") ** 2).alias("squares"))


def ego(nodes: DataFrame, edges: DataFrame, entity_id: str) -> DataFrame:
    """Edges that touch an entity with the other end's label and type."""
    touching = edges.filter((F.col("source") == entity_id) | (F.col("target") == entity_id))
    other = F.when(F.col("source") == entity_id, F.col("target")).otherwise(F.col("source"))
    labels = nodes.select("case_id", F.col("id").alias("neighbor"), F.col("label").alias("neighbor_label"),
                          F.col("type").alias("neighbor_type"))
    return touching.withColumn("neighbor", other).join(labels, ["case_id", "neighbor"])


def ordered_triangles(links: DataFrame) -> DataFrame:
    """(case_id, u, v, w, way): triangles of distinct links (case_id, a, b, way), a <> b, u before v before w in order of degree.

    way says how a link runs: 0 without direction, else 1 from a to b and -1 from b to a.  Links then run as in a circle:
    u to v, v to w and w to u where way is 1, all against that where it is -1.

    Links point from the lower to the higher degree, so an out-list holds at most sqrt(2m) ids however large a hub is.  The
    list of a link's higher end travels to the lower one: hubs have few or none above them, and links to those that have
    none end there.  Triangles never come from listing the pairs around a node.
    """
    held = settle(links.select("case_id", "a", "b", "way"), "links")
    degree = settle(held.select("case_id", F.explode(F.array("a", "b")).alias("id")).groupBy("case_id", "id").agg(F.count("*").alias("d")), "degree")
    lo = degree.select("case_id", F.col("id").alias("a"), F.col("d").alias("da"))
    hi = degree.select("case_id", F.col("id").alias("b"), F.col("d").alias("db"))
    forward = F.struct("da", "a") < F.struct("db", "b")
    oriented = settle(held.join(lo, ["case_id", "a"]).join(hi, ["case_id", "b"]).select(
        "case_id", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"),
        F.when(forward, F.col("way")).otherwise(-F.col("way")).alias("way")), "oriented")
    out = oriented.groupBy("case_id", "u", "way").agg(F.collect_list("v").alias("out"))
    above = out.select("case_id", F.col("u").alias("v"), "way", F.col("out").alias("out_v"))
    below = out.select("case_id", "u", F.col("way").alias("back"), "out")
    met = oriented.join(above, ["case_id", "v", "way"]).withColumn("back", -F.col("way")).join(below, ["case_id", "u", "back"])
    return met.select("case_id", "u", "v", F.explode(F.array_intersect("out", "out_v")).alias("w"), "way")


def common_neighbors(pairs: DataFrame) -> DataFrame:
    """(case_id, a, b, common) for every existing edge and every shared neighbour."""
    triangles = ordered_triangles(pairs.filter("a <> b").withColumn("way", F.lit(0)))
    side = lambda x, y, c: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(c).alias("common"))
    return triangles.select("case_id", F.explode(F.array(
        side("u", "v", "w"), side("u", "w", "v"), side("v", "w", "u"))).alias("t")).select("case_id", "t.*")


def split_isolates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    from .filters import endpoints
    ends = endpoints(edges, "case_id")
    return nodes.join(ends, ["case_id", "id"], "left_semi"), nodes.join(ends, ["case_id", "id"], "left_anti")


def centralities(nodes: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """Degree, exact betweenness and PageRank of every node."""
    return (degree_centrality(nodes, pairs).join(betweenness(nodes, pairs), ["case_id", "id"])
            .join(pagerank(nodes, pairs, **options), ["case_id", "id"]))
