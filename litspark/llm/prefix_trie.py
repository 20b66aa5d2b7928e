"""The trie of conversations' shared beginnings, from ROLLUPs over positional turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Turns in one block of columns.
WIDTH = 8
#: Ids of conversations joined into one piece before a node's pieces meet.
PIECE_IDS = 10_000
#: The rebuilt conversations take up to this many turns, less one, from the first of their hundred.
HEADS = 6
HUNDRED = 100
NO_ENDS = hashlib.sha256(b"").hexdigest()


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id, chars): each turn's place in its conversation from 0, the SHA-256 of its role and text, its code points.

    Turns are in order of ``turn_col`` (null first; ties by turn_id). Places are prefix sums over range partitions, as
    a conversation may hold any share of the rows; the partitions' counts, one row for each partition in which a conversation
    goes on, are broadcast.
    """
    role = text_or_empty(role_col)
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_or_empty(text_col)), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), name.alias("turn_id"), F.length(text_or_empty(text_col)).cast("long").alias("chars"))
    partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(partitions, "conv_id", F.asc_nulls_first("turn"), "turn_id").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    going_on = counts.select("conv_id", "part", earlier.alias("earlier")).where("earlier is not null")
    nth = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first("turn"), "turn_id"))
    numbered = ranged.withColumn("nth", nth).join(F.broadcast(going_on), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("nth") - 1 + F.coalesce("earlier", F.lit(0))).alias("pos"), "turn_id", "chars")


def with_shared_heads(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversation c rebuilt: the first h turns of the first conversation of its hundred, then its own after its first h; h = crc32(c) % 6."""
    heads = placed.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    there = heads.groupBy("base").agg(F.count("*").alias("there"))
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    plan = plan.join(there, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    first = plan.where("taken > 0").join(heads, "base").where("pos < h").select("conv_id", "pos", "turn_id", "chars")
    own = placed.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "chars")
    return first.unionByName(own)


def _path(columns: list[str]) -> Column:
    return F.concat(*[F.coalesce(F.col(c), F.lit(b"")) for c in columns])


def _rolled(here: DataFrame, width: int, block: int, more: str = "") -> DataFrame:
    """The nodes of a block of columns: every prefix of the turn ids t1.., under the node of the block before (prior).

    ``grouping_id`` tells a prefix's end from the end of a conversation; a prefix that ends in a missing turn is none.
    """
    turns = [f"t{i}" for i in range(1, width + 1)]
    rolled = here.sparkSession.sql(
        f"""select prior, {', '.join(turns)}, {width} - cast(log2(grouping_id() + 1) as int) as level,
              min(conv_id) as owner, count(*) as n_convs, max(length) as longest {more}
            from {{here}} group by prior, rollup({', '.join(turns)})""",
        here=here,
    )
    named = rolled.where("level > 0").where(F.element_at(F.array(*turns), F.col("level")).isNotNull())
    parent = F.concat(*[F.when(F.lit(i) < F.col("level"), F.coalesce(F.col(t), F.lit(b""))).otherwise(F.lit(b"")) for i, t in enumerate(turns, 1)])
    return named.select(F.lit(block).alias("block"), (F.col("level") + block * width).cast("long").alias("depth"), "level", "prior", _path(turns).alias("path"), parent.alias("parent_path"), *[c for c in rolled.columns if c not in {"level", "prior", *turns}])


def _join_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows by (depth, owner, conv_id): pieces of a node's ids, joined by commas."""
    node, ids = None, []
    names = ["depth", "owner", "first", "ids"]
    for frame in frames:
        out = []
        for key in zip(frame["depth"].tolist(), frame["owner"].tolist(), frame["conv_id"].tolist(), strict=True):
            if key[:2] != node or len(ids) >= PIECE_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = key[:2], []
            ids.append(key[2])
        yield pd.DataFrame(out, columns=names)
    if ids:
        yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=names)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pieces by (depth, owner, first id): SHA-256 of each node's ids, a piece at a time."""
    node, sha = None, None
    for frame in frames:
        out = []
        for depth, owner, ids in zip(frame["depth"].tolist(), frame["owner"].tolist(), frame["ids"], strict=True):
            if (depth, owner) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, owner), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "owner", "ends"])
    if node:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["depth", "owner", "ends"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, owner, ends): SHA-256 of the ascending ids of each node, whatever their number.

    Ids are joined into pieces where range partitions hold them; what meets in a node's task is one row a piece, and streams by.
    """
    partitions = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["depth", "owner", "conv_id"]
    pieces = ends.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(_join_ids, "depth long, owner long, first long, ids string")
    return pieces.repartition(partitions, "depth", "owner").sortWithinPartitions("depth", "owner", "first").mapInPandas(_digest, "depth long, owner long, ends string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prefix_trie(placed: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct beginning of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, turn_id.

    ``placed`` has (conv_id, pos, turn_id, chars) as of ``placed_turns``, ``convs`` the distinct conv_ids, also of conversations
    without a turn. A node is named by its smallest member and its depth; turn_id is its last turn's (root: null).

    Turns stand side by side in blocks of ``width`` columns. One ROLLUP over a block's columns gives all its prefixes; conversations
    that go on and are not alone there enter the next block under the node they reached, so there are as many rounds as blocks in
    the longest beginning that two conversations share. What one conversation has alone is a chain of nodes without a rollup.
    A subtree's sums are no walk: with s(c) the depth from which c is the smallest member of its nodes and Q(c) the code points of its
    turns before that one, a node's saved_tokens are the sum of Q over its members, less the smallest member's Q and the code
    points above the node for each other member; its leaves are the members that own one. A second ROLLUP takes these sums.
    All joins have one row a node or a conversation on one side. Rows with a null conv_id belong to no conversation; repeated turns
    are turns; null roles and texts are empty; an empty table gives no rows.
    """
    spark = placed.sparkSession
    convs = cut(convs)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    nodes_schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id binary"
    if not root["n"]:
        return spark.createDataFrame([], nodes_schema)
    placed = cut(placed)
    lengths = placed.groupBy("conv_id").agg(F.count("*").alias("length"))
    at = F.col("pos") % width
    columns = [F.max(F.when(at == i, F.col("turn_id"))).alias(f"t{i + 1}") for i in range(width)] + [F.sum(F.when(at <= i, F.col("chars"))).alias(f"c{i + 1}") for i in range(width)]
    wide = placed.groupBy("conv_id", F.floor(F.col("pos") / width).cast("int").alias("block")).agg(*columns)
    wide = cut(wide.join(lengths, "conv_id").withColumn("path", _path([f"t{i}" for i in range(1, width + 1)])))

    state = lengths.select("conv_id", F.lit(root["conv_id"]).alias("prior"), F.lit(0).cast("long").alias("before"))
    walked, first_nodes, alone = [], [], []
    while True:
        block = len(walked)
        here = cut(wide.where(F.col("block") == block).drop("block").join(state, "conv_id"))
        if here.isEmpty() and walked:
            break
        walked.append(here)
        found = cut(_rolled(here, width, block))
        first_nodes.append(found)
        reached = found.where(F.col("level") == width).select("prior", "path", F.col("owner").alias("to"), "n_convs")
        on = here.where(F.col("length") > width * (block + 1)).join(reached, ["prior", "path"])
        state = on.where("n_convs > 1").select("conv_id", F.col("to").alias("prior"), (F.col("before") + F.col(f"c{width}")).alias("before"))
        alone.append(on.where("n_convs = 1").select("conv_id", F.lit(width * (block + 1)).alias("since"), "length"))
    single = cut(_union(alone))

    nodes = _union(first_nodes)
    starts = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("start"))
    leaves = nodes.where("longest = depth").select(F.col("owner").alias("conv_id")).unionByName(single.select("conv_id")).withColumn("leaf", F.lit(1))
    before_own = F.sum(F.when(F.col("start").isNull() | (F.col("pos") < F.col("start") - 1), F.col("chars")).otherwise(0))
    facts = placed.join(starts, "conv_id", "left").groupBy("conv_id").agg(before_own.alias("q"), F.first("start").alias("start"))
    facts = cut(facts.join(leaves, "conv_id", "left").select("conv_id", "q", "start", F.coalesce("leaf", F.lit(0)).alias("leaf")))

    above = ", ".join(["max(before) as b"] + [f"max(c{i}) as c{i}" for i in range(1, width)])
    summed = _union([_rolled(here.join(facts.select("conv_id", "q", "leaf"), "conv_id"), width, block, f", sum(q) as q_all, sum(leaf) as n_leaves, {above}") for block, here in enumerate(walked)])
    own = facts.select(F.col("conv_id").alias("owner"), "q", "start")
    chars_above = F.col("b") + F.when(F.col("level") == 1, 0).otherwise(F.element_at(F.array(*[f"c{i}" for i in range(1, width)]), F.greatest(F.col("level") - 1, F.lit(1))))
    saved = F.col("q_all") - F.col("q") - (F.col("n_convs") - 1) * chars_above
    summed = cut(
        summed.join(own, "owner").select(
            "block", "depth", "prior", "path", "parent_path", "owner", "n_convs", "n_leaves", saved.alias("saved_tokens"), F.expr("case when start < depth then owner when level = 1 then prior end").alias("parent"), F.expr("substring(path, -32, 32)").alias("turn_id")
        )
    )
    named = summed.select("block", "prior", F.col("path").alias("parent_path"), F.col("owner").alias("parent"))
    shown = ["owner", "depth", "parent", "n_convs", "n_leaves", "saved_tokens", "turn_id"]
    branches = summed.where("parent is null").drop("parent").join(named, ["block", "prior", "parent_path"])
    chains = single.join(placed, "conv_id").where("pos >= since").select(F.col("conv_id").alias("owner"), (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent"), F.lit(1).cast("long").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "turn_id")
    below = cut(_union([summed.where("parent is not null").select(shown), branches.select(shown), chains.select(shown)]))

    sums = facts.agg(F.sum("q").alias("q"), F.sum("leaf").alias("leaf")).first()
    top = spark.createDataFrame([(root["conv_id"], 0, None, root["n"], sums["leaf"] or 1, sums["q"] or 0, None)], "owner long, depth long, parent long, n_convs long, n_leaves long, saved_tokens long, turn_id binary")
    children = below.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    reached = [
        here.where(F.col("length") <= width * (block + 1)).join(found.select("prior", "path", "owner", "depth"), ["prior", "path"]).where("length = depth").select("depth", "owner", "conv_id")
        for block, (here, found) in enumerate(zip(walked, first_nodes, strict=True))
    ]
    turnless = convs.join(lengths, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(root["conv_id"]).alias("owner"), "conv_id")
    ends = id_digests(_union([*reached, single.select(F.col("length").alias("depth"), F.col("conv_id").alias("owner"), "conv_id"), turnless]))
    return below.unionByName(top).join(children, ["owner", "depth"], "left").join(ends, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        "turn_id",
    )


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``prefix_trie`` of a table of turns as they are."""
    placed = cut(placed_turns(turns, conv_col, turn_col, role_col, text_col))
    return prefix_trie(placed, placed.select("conv_id").distinct(), width)


def with_turns(nodes: DataFrame, turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with the role and text of their last turn (root: null), from any table that holds the turns."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    texts = turns.select(name.alias("turn_id"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_id"])
    return nodes.join(texts, "turn_id", "left")
