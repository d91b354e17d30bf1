"""Flows of money or calls over time: structuring, coordinated senders, chains in order of time.

transfers: (case_id, id, source, target, at, …) with ``at`` in whole seconds.  Windows that look back over ``within``
seconds are cut into buckets of that length, and a row is also shown to the next bucket, so an account with a third of
all rows is as many tasks as it has buckets.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iteration import settle
from .patterns import latest_before
from .windows import running_sum


def in_buckets(events: DataFrame, within: int) -> DataFrame:
    """events twice: in their own bucket of time (``carried`` false) and in the next one (true)."""
    own = F.expr(f"at div {within}")
    copies = F.explode(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("carried")),
                               F.struct((own + 1).alias("bucket"), F.lit(True).alias("carried"))))
    return events.withColumn("__c", copies).select(*events.columns, "__c.*")


def trailing(events: DataFrame, keys: list[str], within: int, totals: dict) -> DataFrame:
    """events with aggregates over the rows of the same keys from ``within`` seconds before up to their own second."""
    window = Window.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(-within, 0)
    seen = in_buckets(events, within).withColumns({name: c.over(window) for name, c in totals.items()})
    return seen.filter("not carried").drop("bucket", "carried")


def structuring(transfers: DataFrame, below: float, total: float, within: int, least: int = 3, side: str = "source") -> DataFrame:
    """Transfers that complete a run of small ones: each under ``below``, at least ``least`` of one account within
    ``within`` seconds, together at least ``total``.  (case_id, account, id, at, transfers, amount); amounts may be decimals.

    ``side`` says whose account counts, the source's (paid out in parts) or the target's (paid in in parts).
    """
    small = transfers.filter(F.col("amount") < below).select("case_id", F.col(side).alias("account"), "id", "at", "amount")
    seen = trailing(small.withColumnRenamed("amount", "own"), ["case_id", "account"], within,
                    {"transfers": F.count("*"), "amount": F.sum("own")})
    return seen.filter((F.col("transfers") >= least) & (F.col("amount") >= total)).select(
        "case_id", "account", "id", "at", "transfers", "amount")


def coordinated(transfers: DataFrame, within: int, least: int = 3) -> DataFrame:
    """(case_id, target, at, senders): seconds in which a target is paid and has been by at least ``least`` different
    senders within the last ``within`` seconds, its own second included.

    A sender counts from a transfer on until ``within`` seconds after the last of those that follow each other that
    closely; these spells are found per sender, and their starts and ends summed over the time of the target.
    """
    sent = transfers.select("case_id", "target", "source", "at").distinct()
    order = Window.partitionBy("case_id", "target", "source", "bucket").orderBy("at")
    seen = in_buckets(sent, within + 1).withColumns({"before": F.lag("at").over(order), "after": F.lead("at").over(order)})
    starts = seen.filter(~F.col("carried") & (F.col("before").isNull() | (F.col("at") - F.col("before") > within)))
    ends = seen.filter(F.col("carried") & (F.col("after").isNull() | (F.col("after") - F.col("at") > within)))
    steps = [starts.select("case_id", "target", "at", F.lit(1).alias("step"), F.lit(False).alias("paid")),
             ends.select("case_id", "target", (F.col("at") + within + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("paid")),
             sent.select("case_id", "target", "at", F.lit(0).alias("step"), F.lit(True).alias("paid"))]
    points = (reduce(lambda a, b: a.unionByName(b), steps).groupBy("case_id", "target", "at")
              .agg(F.sum("step").alias("step"), F.max("paid").alias("paid")))
    counted = running_sum(points, ["case_id", "target"], "at", {"senders": F.col("step")}, block=1 << 21)
    return counted.filter(F.col("paid") & (F.col("senders") >= least)).select("case_id", "target", "at", "senders")


def receipts_before(transfers: DataFrame, within: int) -> DataFrame:
    """(case_id, account, id, prior_id): every receipt of an account at most ``within`` seconds before a transfer out of it.

    Both sides meet by account and bucket of time, a receipt in its own bucket and the next one.
    """
    out = transfers.select("case_id", F.col("source").alias("account"), "id", "at", F.expr(f"at div {max(within, 1)}").alias("bucket"))
    into = in_buckets(transfers.select("case_id", F.col("target").alias("account"), F.col("id").alias("prior_id"), "at"), max(within, 1))
    met = out.join(into.withColumnRenamed("at", "prior_at"), ["case_id", "account", "bucket"])
    return met.filter((F.col("prior_at") <= F.col("at")) & (F.col("at") - F.col("prior_at") <= within)).select("case_id", "account", "id", "prior_id")


def returning_flows(transfers: DataFrame, most: int, within: int) -> DataFrame:
    """(case_id, account, id, length, closed_at): transfers after which money may have come back to the account that sent it.

    A chain of at most ``most`` transfers starts with ``id``, goes on from where each one arrived, later than it, and ends at
    the sender at most ``within`` seconds after ``id``. Length is the fewest transfers that do so and closed_at the earliest
    end of a chain of that length. Transfers of an account to itself are no part of it.

    What is kept of a start is its earliest arrival at each place, and nothing that reaches a place later than fewer transfers
    did. The last transfer is found by place and account together, so the widest round is never listed. Places meet transfers
    by bucket of time, so a hot account is many tasks.
    """
    width = max(within, 1)
    every = transfers.filter("source <> target").select("case_id", "id", "source", "target", "at")
    # a circle's transfers have an account before and one after
    ends = lambda side, name: every.select("case_id", F.col(side).alias(name)).distinct()
    lively = every.join(ends("target", "source"), ["case_id", "source"], "left_semi").join(
        ends("source", "target"), ["case_id", "target"], "left_semi").select(*every.columns)
    own = F.expr(f"at div {width}")
    moves = settle(lively.select("case_id", F.col("source").alias("place"), F.col("target").alias("next"), F.col("at").alias("leaves"),
                                 F.explode(F.array(own, own - 1)).alias("bucket"), "id"), "moves")
    start = ["case_id", "id", "account", "until"]
    front = settle(moves.filter(f"bucket = leaves div {width}").select(
        "case_id", "id", F.col("place").alias("account"), (F.col("leaves") + within).alias("until"), F.col("next").alias("place"), F.col("leaves").alias("arrives")))
    by_time = moves.select("case_id", "place", "bucket", "next", "leaves")
    later = (F.col("leaves") > F.col("arrives")) & (F.col("leaves") <= F.col("until"))
    seen, found = front, []
    for length in range(2, most + 1):
        there = front.withColumn("bucket", F.expr(f"arrives div {width}"))
        back = there.join(by_time.withColumnRenamed("next", "account"), ["case_id", "place", "account", "bucket"]).filter(later)
        closed = settle(back.groupBy("case_id", "account", "id").agg(F.min("leaves").alias("closed_at")))
        found.append(closed.select("case_id", "account", "id", F.lit(length).alias("length"), "closed_at"))
        if length == most:
            break
        onward = there.join(closed.select("case_id", "id"), ["case_id", "id"], "left_anti").join(by_time, ["case_id", "place", "bucket"])
        reached = (onward.filter(later & (F.col("next") != F.col("account"))).groupBy(*start, F.col("next").alias("place"))
                   .agg(F.min("leaves").alias("arrives")))
        known = seen.groupBy("case_id", "id", "place").agg(F.min("arrives").alias("earlier"))
        front = settle(reached.join(known, ["case_id", "id", "place"], "left").filter("earlier is null or arrives < earlier")
                       .select(*start, "place", "arrives"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return reduce(lambda a, b: a.unionByName(b), found)


def call_paths(calls: DataFrame, most: int, within: int | None = None) -> DataFrame:
    """(case_id, id, length, prior_id): for every call and length up to ``most`` such that a chain of so many calls ends in
    it, each made by whom the one before reached, later and at most ``within`` seconds later; prior_id is the call before.

    Of the calls that can come before, only the latest one that ends a chain of the length needed is kept: it is as good
    as any other for what follows, so a round is one pass over the calls and no pairs are listed.
    """
    out = calls.select("case_id", F.col("source").alias("place"), "at", "id")
    into = calls.select("case_id", F.col("target").alias("place"), (F.col("at") + 1).alias("at"), "id")
    none = F.lit(None).cast(dict(calls.dtypes)["id"])
    rounds = [out.select("case_id", "id", F.lit(1).alias("length"), none.alias("prior_id"))]
    reach = None if within is None else within - 1
    for length in range(2, most + 1):
        step = settle(latest_before(out, into, ["case_id", "place"], reach).select("case_id", "id", F.lit(length).alias("length"), "prior_id"))
        if step.isEmpty():
            break
        rounds.append(step)
        into = into.join(step.select("case_id", "id"), ["case_id", "id"], "left_semi")
    return reduce(lambda a, b: a.unionByName(b), rounds)


def path_members(paths: DataFrame, least: int = 3) -> DataFrame:
    """(case_id, path, place, id): the calls, first to last, of the longest chain that ends in each call and has ``least``
    calls or more; the chain is named by its last call."""
    longest = paths.groupBy("case_id", "id").agg(F.max("length").alias("length")).filter(F.col("length") >= least)
    front = settle(longest.select("case_id", F.col("id").alias("path"), "id", F.col("length").alias("place")))
    prior = paths.select("case_id", "id", F.col("length").alias("place"), "prior_id")
    members = [front]
    while not front.isEmpty():
        front = settle(front.join(prior, ["case_id", "id", "place"]).filter("place > 1")
                       .select("case_id", "path", F.col("prior_id").alias("id"), (F.col("place") - 1).alias("place")))
        members.append(front)
    return reduce(lambda a, b: a.unionByName(b), members).select("case_id", "path", "place", "id")
