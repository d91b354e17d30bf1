"""Trie of conversation prefixes by fixed-length blocks of turns, refined to turns where siblings diverge.

A conversation is cut into blocks of BLOCK turns. The digest of a prefix of whole blocks (and of the whole conversation,
whose last block may be short) groups the conversations that share it, so a block is looked at once per distinct prefix
and not once per conversation. Only where two or more different blocks follow the same prefix are their turns compared
one by one; a block that alone follows its prefix gives its nodes as they are.

A node is named by its smallest member and its depth. The nodes of one conversation are a chain from where it becomes
the smallest member down to its end, and every chain hangs on a node of another, so sums over subtrees are sums along
chains plus sums over the tree of chains, which pointer jumping finds in as many rounds as the logarithm of its height.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import cut

#: Turns of a block, and blocks (or turns of a chain) whose running values one task finds in a row.
BLOCK, STRETCH = 4, 4096
#: A key with over this share of the rows is met by broadcast: there are at most so many of them.
HOT_KEYS, HOT_ROWS = 4096, 2_000
WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one piece of text when a node's list of conversations is hashed.
PIECE_IDS = 4096


def meet(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with ``one``, which has each key once, without sending a frequent key of ``many`` to one task.

    Keys with more than 1/HOT_KEYS of the rows (and more than HOT_ROWS), at most HOT_KEYS of them, meet their rows of
    ``one`` by broadcast; all others are joined as usual. ``how`` is inner or left; keys are not null.
    """
    counts = many.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = many.count()
    hot = cut(counts.where(F.col("__n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys))
    if hot.isEmpty():
        return many.join(one, keys, how)
    few = cut(one.join(F.broadcast(hot), keys, "left_semi"))
    warm = many.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    return many.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how).unionByName(warm)


def running(df: DataFrame, keys: list[str], place: str, sums: list[str], xors: list[str] = (), down: bool = False) -> DataFrame:
    """df with the columns of ``sums`` and ``xors`` running from the first place of their key to each row's, or from the
    last place with ``down``. A key with many places is many tasks: stretches of STRETCH places, and a row per stretch."""
    part, (order, kinds) = "__part", (F.desc if down else F.asc, {n: F.sum for n in sums} | {n: F.bit_xor for n in xors})
    tagged = df.withColumn(part, F.expr(f"{place} div {STRETCH}"))
    own = Window.partitionBy(*keys, part).orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(order(part)).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, part).agg(*[kind(n).alias(n) for n, kind in kinds.items()])
    before = totals.select(*keys, part, *[kind(n).over(earlier).alias(f"__{n}") for n, kind in kinds.items()])
    both = tagged.withColumns({n: kind(n).over(own) for n, kind in kinds.items()}).join(before, [*keys, part])
    none = F.lit(0).cast("long")
    return both.withColumns(
        {n: F.col(n) + F.coalesce(f"__{n}", none) for n in sums} | {n: F.col(n).bitwiseXOR(F.coalesce(f"__{n}", none)) for n in xors}
    ).drop(part, *[f"__{n}" for n in kinds])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, runs): the turns with digest and words, dealt by ranges of their order, and what each range holds of each
    conversation: conv_id, part, low, n and ``before``, the number of its turns in earlier ranges.

    A conversation of any length is spread over many tasks. Turns of equal number are in order of their digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = (conversations.where("conv_id is not null")
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                     F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("nth")))
    order = ["conv_id", "turn", "digest", "nth"]
    dealt = cut(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def as_they_are(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): conv_id and length of each conversation; conv_id, place, length, digest, words of each turn."""
    dealt, runs = ordered_turns(conversations)
    runs = cut(runs)
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("length"))
    where = runs.join(convs, "conv_id").select("conv_id", "part", (F.col("before") - F.col("low")).alias("shift"), "length")
    turns = dealt.join(where, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "length", "digest", "words")
    return cut(convs), turns


def with_shared_openings(conversations: DataFrame, family: int = 20, openings: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, with each conversation c opened by the first h turns of conversation c - c % family (all if
    there are fewer, none if there is none) in place of its own first h; h = crc32(c in decimal) % openings."""
    dealt, runs = ordered_turns(conversations)
    runs = cut(runs)
    lead = F.col("conv_id") - F.col("conv_id") % family
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns(
        {"lead": lead, "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(openings)).cast("long")})
    leads = sizes.where("conv_id = lead").select("lead", F.col("n").alias("lead_n"))
    opened = F.least("h", F.coalesce("lead_n", F.lit(0)))
    convs = cut(sizes.join(leads, "lead", "left").select(
        "conv_id", "lead", "h", opened.alias("opened"), (opened + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    where = runs.join(convs, "conv_id").select("conv_id", "part", (F.col("before") - F.col("low")).alias("shift"), "h", "opened", "length")
    own = (dealt.join(where, ["conv_id", "part"]).withColumn("was", F.col("at") + F.col("shift")).where("was >= h")
           .select("conv_id", (F.col("was") - F.col("h") + F.col("opened")).alias("place"), "length", "digest", "words"))
    # the first turns of the leading conversations: fewer than ``openings`` rows each
    first = (dealt.join(runs.where(F.col("conv_id") == lead).where(F.col("before") < openings), ["conv_id", "part"])
             .select(F.col("conv_id").alias("lead"), (F.col("at") - F.col("low") + F.col("before")).alias("place"), "digest", "words")
             .where(F.col("place") < openings))
    head = convs.join(first, "lead").where("place < opened").select("conv_id", "place", "length", "digest", "words")
    return convs.select("conv_id", "length"), own.unionByName(head)


def digest_ends(ends: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of (rep, depth, conv_id): the hash of the conv_ids, ascending, comma-joined.

    A hash reads its text in order, so one task must see all ids of a node; they reach it as pieces of text of PIECE_IDS
    ids each, written by many tasks, and are read as a stream that keeps no more than a piece.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (rep, depth) != key or len(ids) == PIECE_IDS:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (rep, depth), []
                ids.append(conv)
            yield rows(out, ("rep", "depth", "low", "text"))
            out = []
        if ids:
            yield rows([(*key, ids[0], ",".join(map(str, ids)))], ("rep", "depth", "low", "text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for rep, depth, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (rep, depth) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (rep, depth), hashlib.sha256()
                state.update(text.encode())
            yield rows(out, ("rep", "depth", "ends_sha256"))
            out = []
        if key is not None:
            yield rows([(*key, state.hexdigest())], ("rep", "depth", "ends_sha256"))

    def rows(found: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n in ("text", "ends_sha256") else pa.int64()) for n, c in zip(names, columns)], names=list(names))

    order = ["rep", "depth", "conv_id"]
    texts = (ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(pieces, "rep long, depth long, low long, text string"))
    return (texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "low")
            .mapInArrow(hashes, "rep long, depth long, ends_sha256 string"))


def block_paths(turns: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """(path, last).

    path has a row per distinct block of turns behind a distinct prefix and turn of it: p1, p2 name the block with its
    prefix, rep is its smallest conversation and length that one's, depth the turn's, node the smallest conversation of
    the turn's node, prev that of the node before, words those of the turn and upto those of all turns up to it, last
    whether the block ends here. ``last`` names the last block of each conversation.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.expr(f"place % {BLOCK}").alias("j"), "digest", "words")))
    blocks = (turns.groupBy("conv_id", F.expr(f"place div {BLOCK}").alias("block"))
              .agg(cells.alias("cells"), F.max("length").alias("length")))
    digests = F.transform("cells", lambda c: c["digest"])
    blocks = blocks.withColumns({"b1": F.xxhash64(F.lit(1), "block", digests), "b2": F.xxhash64(F.lit(2), digests, "block"),
                                 "upto": F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["words"])})
    blocks = blocks.withColumns({"p1": F.col("b1"), "p2": F.col("b2")})
    blocks = cut(running(blocks, ["conv_id"], "block", ["upto"], ["p1", "p2"]))
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("p1", "p2"), "block").alias("p")).select("conv_id", "p.*")

    least = F.min(F.struct("conv_id", "length"))
    groups = blocks.groupBy("p1", "p2").agg(least.alias("m"), F.first(F.struct("block", "b1", "b2", "cells", "upto")).alias("g"))
    groups = cut(groups.select("p1", "p2", F.col("m.conv_id").alias("rep"), "m.length", "g.block", "g.cells", "g.upto",
                               F.col("p1").bitwiseXOR(F.col("g.b1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("g.b2")).alias("q2")))
    # blocks that alone follow their prefix, by their own names: no join meets a frequent prefix here
    alone = (groups.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.min(F.struct("p1", "p2")).alias("p")).where("n = 1")
             .select("p.*", F.lit(True).alias("alone")))
    above = groups.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("up"))
    inner = meet(groups.where("block > 0"), above, ["q1", "q2"])
    known = inner.unionByName(groups.where("block = 0").withColumn("up", F.lit(root)))
    known = known.join(alone, ["p1", "p2"], "left")

    size = F.size("cells")
    before = F.col("upto") - F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    steps = known.withColumn("before", before).select(
        "p1", "p2", "q1", "q2", "rep", "length", "block", "up", "before", F.coalesce("alone", F.lit(False)).alias("alone"), "cells",
        F.explode(F.sequence(F.lit(1), size)).alias("j"))
    prefix = F.slice("cells", F.lit(1), F.col("j"))
    hashed = F.transform(prefix, lambda c: c["digest"])
    steps = steps.select(
        "p1", "p2", "q1", "q2", "rep", "length", "up", "alone", "j", (F.col("block") * BLOCK + F.col("j")).alias("depth"),
        (F.col("before") + F.aggregate(prefix, F.lit(0).cast("long"), lambda a, c: a + c["words"])).alias("upto"),
        F.element_at("cells", F.col("j"))["words"].alias("words"), (F.col("j") == size).alias("last"),
        F.xxhash64(F.lit(3), hashed).alias("s1"), F.xxhash64(hashed, F.lit(4)).alias("s2"))
    steps = cut(steps)
    split = steps.where("not alone")
    key = ["q1", "q2", "j", "s1", "s2"]
    nodes = cut(split.groupBy(*key).agg(F.min("rep").alias("node")))
    met = meet(split, nodes, key).unionByName(steps.where("alone").withColumn("node", F.col("rep")))
    along = Window.partitionBy("p1", "p2").orderBy("j")
    path = met.withColumn("prev", F.coalesce(F.lag("node").over(along), "up"))
    return cut(path.select("p1", "p2", "rep", "length", "depth", "node", "prev", "words", "upto", "last")), last


def subtree_sums(chains: DataFrame, names: list[str]) -> DataFrame:
    """(conv_id, names) summed over each chain and all that hang on it. chains: conv_id, ptr (the chain it hangs on, null
    for the root) and the columns to sum. After k rounds each has what lies less than 2^k below it."""
    state = cut(chains.select("conv_id", "ptr", *names))
    while not (live := state.where("ptr is not null")).isEmpty():
        given = live.groupBy("ptr").agg(*[F.sum(n).alias(f"__{n}") for n in names]).withColumnRenamed("ptr", "conv_id")
        further = meet(live.select("conv_id", "ptr"), state.select(F.col("conv_id").alias("ptr"), F.col("ptr").alias("next")), ["ptr"])
        state = cut(state.drop("ptr").join(given, "conv_id", "left").join(further.select("conv_id", F.col("next").alias("ptr")), "conv_id", "left")
                    .select("conv_id", "ptr", *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in names]))
    return state.drop("ptr")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of turns of the given conversations, the empty one included: conv_id (its smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs and turns are those of ``as_they_are`` or ``with_shared_openings``. Null roles and texts count as empty, a null
    turn comes first, turns of equal number come in order of their digest, repeated rows are turns of their own, rows
    without conv_id belong to no conversation. A conversation of any length and a prefix of any number of members is
    spread over many tasks. Without conversations there are no rows. Other columns are not read.
    """
    top = convs.agg(F.min(F.struct("conv_id", "length"))).first()[0]
    if top is None:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                                      "n_leaves long, saved_tokens long, ends_sha256 string")
    root, root_length = top
    path, last = block_paths(turns, root)
    of_blocks = path.where("last").select("p1", "p2", F.col("node").alias("rep"), "depth")
    ends = meet(last, of_blocks, ["p1", "p2"]).select("conv_id", "rep", "depth").unionByName(
        convs.where("length = 0").select("conv_id", F.lit(root).alias("rep"), F.lit(0).cast("long").alias("depth")))
    ends = cut(ends)
    zero = F.lit(0).cast("long")
    own = path.where("node = rep").select("rep", "depth", "length", "prev", "words", "upto").unionByName(
        convs.where(F.col("conv_id") == root).select(F.col("conv_id").alias("rep"), zero.alias("depth"), "length",
                                                     F.lit(None).cast("long").alias("prev"), zero.alias("words"), zero.alias("upto")))
    chain_tops = own.where("prev <> rep").select(F.col("rep").alias("conv_id"), F.col("prev").alias("ptr"), (F.col("depth") - 1).alias("at"))
    chain_tops = cut(chain_tops)
    hung = chain_tops.groupBy(F.col("ptr").alias("rep"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    ended = ends.groupBy("rep", "depth").agg(F.count("*").alias("ended"))
    nodes = own.join(ended, ["rep", "depth"], "left").join(hung, ["rep", "depth"], "left")
    ended, hung = F.coalesce("ended", F.lit(0)), F.coalesce("hung", F.lit(0))
    goes_on = (F.col("depth") < F.col("length")).cast("long")
    nodes = cut(nodes.select("rep", "depth", "prev", "words", "upto", (hung + goes_on).alias("n_children"), ended.alias("ended"),
                             (hung + goes_on == 0).cast("long").alias("leaf"), (ended * F.col("upto")).alias("reach")))
    names = ["ended", "leaf", "reach", "words"]
    chains = nodes.groupBy(F.col("rep").alias("conv_id")).agg(*[F.sum(n).alias(n) for n in names]).join(
        chain_tops.select("conv_id", "ptr"), "conv_id", "left")
    totals = subtree_sums(chains, names).join(chain_tops, "conv_id")
    hanging = totals.groupBy(F.col("ptr").alias("rep"), F.col("at").alias("depth")).agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    full = nodes.withColumn("own_words", F.col("words")).join(hanging, ["rep", "depth"], "left").select(
        "rep", "depth", "prev", "own_words", "upto", "n_children", *[(F.col(n) + F.coalesce(f"t_{n}", F.lit(0))).alias(n) for n in names])
    summed = running(full, ["rep"], "depth", names, down=True)
    # all words on the ways from a node to the ends below it, less one copy of each word below it
    saved = F.col("reach") - F.col("ended") * (F.col("upto") - F.col("own_words")) - F.col("words")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(digest_ends(ends), ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("prev").alias("parent_conv_id"), F.col("ended").alias("n_convs"), "n_children",
        F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of a table of turns (conv_id, turn, role, text) as it is."""
    return prefix_trie(*as_they_are(conversations))
