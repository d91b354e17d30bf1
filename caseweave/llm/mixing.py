"""Mixing sources to target weights by balanced (cube-method) sampling."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut, fresh, text_key

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 2048


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """source, source_size, target: all sizes shared by weights 1..cycle, repeating over the sources by code point
    (null last); a target stops at cap times its source's size and the excess is shared again by weight.

    sizes: (source, size). The table has one row per source; each round of sharing is an aggregate over it.
    """
    from pyspark.sql import Window
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    state = cut(per.withColumn("weight", ((rank - 1) % cycle + 1).cast("double")).withColumn("full", F.lit(False)))
    limit = F.col("source_size") * F.lit(cap)
    while True:
        total = F.sum("source_size") - F.coalesce(F.sum(F.when(F.col("full"), limit)), F.lit(0.0))
        got = state.agg(total.alias("rest"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weights"),
                        F.sum(F.col("full").cast("int")).alias("full")).first()
        level = got["rest"] / got["weights"] if got["weights"] else 0.0
        share = F.when(F.col("full"), limit).otherwise(F.col("weight") * F.lit(level))
        grown = cut(state.withColumn("full", F.col("full") | (share > limit)))
        if grown.agg(F.sum(F.col("full").cast("int"))).first()[0] in (got["full"], None):
            return state.select("source", "source_size", share.cast("double").alias("target"))
        state = grown


def flight(size: np.ndarray, chance: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Cube flight: move chances to 0 or 1, three at a time along the null space of (count, size), until two are left.

    Both totals, of chances and of chances times sizes, are kept to rounding. draw: a number in [0, 1) per item that
    decides the direction in proportion, so every item's expectation is kept.
    """
    p = chance.astype(float).tolist()
    s = size.astype(float).tolist()
    u = draw.tolist()
    eps = 1e-9
    live: list[int] = []
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            if s[a] == s[b]:
                v = (1.0, -1.0, 0.0)
            elif s[b] == s[c]:
                v = (0.0, 1.0, -1.0)
            else:
                v = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
                top = max(abs(x) for x in v)
                v = (v[0] / top, v[1] / top, v[2] / top)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, v) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, v) if x)
            step = up if u[i] * (up + down) < down else -down
            for k, x in zip(live, v):
                p[k] += step * x
                if p[k] <= eps or p[k] >= 1 - eps:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0.0 < p[k] < 1.0]
            if step == 0:
                break
    return np.array(p)


def land(size: np.ndarray, chance: np.ndarray, promise: float) -> np.ndarray:
    """Round the few chances that a flight leaves so that the total size comes nearest to `promise`.

    Should the open items be too large to come near, up to three settled ones change sides, each the one that brings
    the total nearest.
    """
    out = chance.copy()
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    settled = float(np.dot(np.where((chance > 0) & (chance < 1), 0.0, chance), size))
    if len(open_):
        choices = [[(m >> k) & 1 for k in range(len(open_))] for m in range(1 << len(open_))]
        out[open_] = min(choices, key=lambda c: abs(settled + float(np.dot(c, size[open_])) - promise))
    for _ in range(3):
        miss = float(np.dot(out, size)) - promise
        left = np.abs(miss + np.where(out > 0.5, -size, size))
        best = int(left.argmin())
        if left[best] >= abs(miss):
            break
        out[best] = 1.0 - out[best]
    return out


def mix(docs: DataFrame, cap: float = 3.0, cycle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, text_key, rows, size (words), source_size, target, copies, taken.

    A source at ratio target / source_size takes every document floor(ratio) times, and once more with the fractional
    rest as its chance; the cube method fixes those draws so that each source's count and words stay balanced. Null
    texts have no words; a document without words is taken as others are and adds nothing. A null source is a source
    of its own, last in order. Rows that repeat doc_id, source and text are one document of `rows` rows (all are taken
    equally often; size and taken are those of one of them). Reruns agree: draws and blocks are hashes of doc_id, source and text.
    Columns other than doc_id, source and text are not read.

    Flights run on blocks of about 2048 documents of one source; each leaves two undecided at most, which meet in
    blocks again until a source has one block, where the landing decides. A hot source is many blocks.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                           text_key(F.col("text")).alias("text_key"), size.alias("size"))
               .groupBy("doc_id", "source", "text_key").agg(F.first("size").alias("size"), F.count("*").alias("rows"))
               .withColumn("row", F.monotonically_increasing_id()))
    targets = cut(source_targets(base.select("source", (F.col("size") * F.col("rows")).alias("size")), cap, cycle))
    ratio = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(cap))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(1 << 52)) / float(1 << 52)
    state = cut(base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
                .withColumn("whole", F.floor(ratio).cast("int")).withColumn("chance", ratio - F.floor(ratio))
                .withColumn("draw", draw))
    decided = state.where("chance <= 0").select("row", F.lit(0.0).alias("p"))
    # row only joins the outcome back: it is dealt anew by every run, so blocks and ties go by what names the document
    live = state.where("chance > 0").select("row", "source", (F.col("size") * F.col("rows")).alias("size"),
                                            F.col("chance").alias("p"), "draw", F.col("doc_id").isNull().alias("nameless"),
                                            F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    out = "row long, source string, size long, p double, draw double, nameless boolean, id long, text_key long"
    level = 0
    while True:
        counts = cut(live.groupBy("source").count().withColumnRenamed("source", "of"))
        most = counts.agg(F.max("count")).first()[0]
        if most is None:
            break
        blocks = F.ceil(F.col("count") / BLOCK)

        def fly(group: pd.DataFrame) -> pd.DataFrame:
            last = group["last"].iloc[0]
            group = group.sort_values(["draw", "nameless", "id", "text_key"]).reset_index(drop=True)
            words = group["size"].to_numpy()
            before = group["p"].to_numpy()
            p = flight(words, before, group["draw"].to_numpy())
            group["p"] = land(words, p, float(np.dot(words, before))) if last else p
            return group[["row", "source", "size", "p", "draw", "nameless", "id", "text_key"]]

        here = (live.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
                .withColumn("block", F.pmod(F.xxhash64(F.lit(level), "nameless", "id", "source", "text_key"), blocks)).withColumn("last", blocks == 1)
                .drop("count"))
        flown = cut(here.groupBy("source", "block").applyInPandas(fly, out))
        decided = decided.unionByName(flown.where("p <= 0 or p >= 1").select("row", "p"))
        live = flown.where("p > 0 and p < 1")
        level += 1
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return (state.join(decided, "row").withColumn("copies", copies)
            .select("doc_id", "source", "text_key", "rows", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def apply_mix(docs: DataFrame, cap: float = 3.0, cycle: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    own_id, own_source, own_key, times = fresh(docs, "__mix_id", "__mix_source", "__mix_key", "__mix_times")
    taken = mix(docs, cap, cycle, seed).where("copies > 0").select(
        F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("text_key").alias(own_key),
        F.col("copies").alias(times))
    match = (F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.col("source").cast("string").eqNullSafe(F.col(own_source))
             & (text_key(F.col("text")) == F.col(own_key)))
    return docs.join(taken, match).withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
