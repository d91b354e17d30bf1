"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import components, cut

BLOCK = 1024
GROUPS = 4096


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """k unit centres of unit points; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def fit_cells(reps: DataFrame, sample: int = 32_768) -> dict[tuple, np.ndarray]:
    """Centres of every (label, dim) of more than two blocks, fitted on the `sample` rows of the smallest hash.

    Both the sample and the number of groups (the 4096 largest) are bounded; other groups are one cell. Cells decide
    only which blocks meet, so the fit does not change the result.
    """
    sizes = (reps.groupBy("label", "dim").count().where(F.col("count") > 2 * BLOCK)
             .orderBy(F.desc("count"), "label", "dim").limit(GROUPS).collect())
    if not sizes:
        return {}
    rows = (reps.select("label", "dim", "embedding", "h").orderBy("h").limit(sample)
            .select("label", "dim", "embedding").toPandas())
    cells = {}
    groups = {key: np.stack(part["embedding"].to_numpy()).astype(float) for key, part in rows.groupby(["label", "dim"])}
    for row in sizes:
        points = groups.get((row["label"], row["dim"]))
        k = min(row["count"] // BLOCK, 0 if points is None else len(points) // 8)
        if k > 1:
            cells[(row["label"], row["dim"])] = spherical_kmeans(points / np.linalg.norm(points, axis=1, keepdims=True), k)
    return cells


def near_vectors(vectors: DataFrame, threshold: float = 0.93, margin: float | None = None, sample: int = 32_768) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label link at a cosine of `threshold` or more, in double precision; n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable and kept marks it. Vectors that are null, zero, hold
    a null or non-finite number or have a null label link with nothing, nor do vectors of different lengths. Rows that
    repeat a vec_id are one node with the links of all of them; a null vec_id takes part, and is the component_id only
    where a component has no other, so that all its rows are kept. Other columns are not read; no rows give no rows.

    Equal vectors are compared once, with their number. Each vector goes to the cell of its nearest centre and meets
    the vectors of another cell only if it is within `margin` of the plane between both centres. The default margin,
    sin(arccos(threshold)), cannot lose a link: the point where two cells part lies between both vectors of a linked
    pair. A smaller margin compares less and may lose links near the planes. Cells are cut into blocks of about 1024
    vectors; a task compares two blocks and returns counts and one link per vector, never its pairs.
    """
    margin = math.sin(math.acos(threshold)) + 1e-9 if margin is None else margin
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(
        "embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          "label").withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h", F.xxhash64("embedding"))
    reps = cut(rows.where("fine").groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
               .withColumnRenamed("rep", "low").withColumn("own", F.monotonically_increasing_id())
               .withColumn("dim", F.size("embedding")))
    # rep only names a node: distinct vectors of one smallest vec_id are one, and so is each without any
    node = reps.where("low is not null").groupBy("low").agg(F.min("own").alias("rep"))
    reps = cut(reps.where("low is not null").join(node, "low").unionByName(reps.where("low is null").withColumn("rep", F.col("own"))).drop("own"))
    kind = dict(reps.dtypes)["label"]
    centres = vectors.sparkSession.sparkContext.broadcast(fit_cells(reps, sample))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(["label", "dim"]):
                found = centres.value.get(key)
                part = part.copy()
                if found is None:
                    part["cell"], part["others"] = 0, [[]] * len(part)
                else:
                    x = np.stack(part["embedding"].to_numpy()).astype(float)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    score = x @ found.T
                    own = score.argmax(axis=1)
                    gap = np.linalg.norm(found[:, None] - found[None], axis=2)
                    near = score[np.arange(len(x)), own][:, None] - score <= margin * gap[own] + 1e-12
                    near[np.arange(len(x)), own] = False
                    part["cell"], part["others"] = own, [np.flatnonzero(n).tolist() for n in near]
                yield part[["rep", "label", "dim", "embedding", "copies", "cell", "others"]]

    placed = cut(reps.select("rep", "label", "dim", "embedding", "copies").mapInPandas(
        assign, f"rep long, label {kind}, dim int, embedding array<double>, copies long, cell int, others array<int>"))
    blocks = cut(placed.groupBy("label", "dim", "cell").count().select(
        "label", "dim", F.col("cell").alias("to"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    own = placed.join(blocks.withColumnRenamed("to", "cell"), ["label", "dim", "cell"]).withColumn(
        "sub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    meets = own.withColumn("to", F.explode(F.array_union("others", F.array("cell")))).join(blocks, ["label", "dim", "to"])
    meets = meets.withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here, there = F.struct(F.col("cell").alias("c"), F.col("sub").alias("s")), F.struct(F.col("to").alias("c"), F.col("to_sub").alias("s"))
    tasks = meets.select("label", "dim", F.least(here, there).alias("lo"), F.greatest(here, there).alias("hi"), (here <= there).alias("left"),
                         "rep", "embedding", "copies")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        group = group.sort_values("rep")
        x = np.stack(group["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rep, copies, left = group["rep"].to_numpy(), group["copies"].to_numpy(), group["left"].to_numpy(bool)
        alone = first["lo"] == first["hi"]
        a, b = (np.arange(len(x)),) * 2 if alone else (np.flatnonzero(left), np.flatnonzero(~left))
        near = x[a] @ x[b].T >= threshold
        if alone:
            np.fill_diagonal(near, False)
        links = np.zeros(len(x), np.int64)
        links[a] = near @ copies[b]
        if not alone:
            links[b] = near.T @ copies[a]
        a, b, near = a[near.any(axis=1)], b[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        root = np.arange(len(x))
        while len(a):
            before = root.copy()
            root[b] = np.minimum(root[b], np.where(near, root[a][:, None], len(x)).min(axis=0))
            root[a] = np.minimum(root[a], np.where(near, root[b][None], len(x)).min(axis=1))
            if (root == before).all():
                break
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[hit], "links": links[hit], "root": rep[root[hit]]})

    found = cut(tasks.groupBy("label", "dim", "lo", "hi").applyInPandas(compare, "rep long, links long, root long"))
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    grouped = cut(reps.select("label", "h", "embedding", "rep", "low", "copies").join(totals, "rep", "left")
                  .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("label", "h", "embedding", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                          F.coalesce("component", "rep").alias("component")))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "component").select("label", "h", "embedding", "n_links", "component_id")
    good = rows.where("fine").join(named, ["label", "h", "embedding"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
