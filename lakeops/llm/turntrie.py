"""The trie of conversation prefixes, by digests of fixed-length blocks of turns.

A node of depth d is a distinct sequence of the first d turns (role, text) of some conversation; its
members are the conversations that start with it.  The root has depth 0 and all conversations.

1. Every turn has four hashes of 32 bits that depend on its place in the conversation, and the digest
   of a prefix is their sum over its turns.  So digests of blocks of ``block`` turns come from an
   aggregate, those of whole prefixes from a running sum over blocks, and no conversation has to be
   read in order by one task.
2. Conversations are grouped by the digest that they have after each block.  A block group is what
   agrees up to the end of a block; its parent is what agreed before the block.
3. A parent with one block group has no branch inside the block: the turns of one of its members are
   nodes with the group's members.  Only where siblings diverge are turn boundaries refined: the
   prefixes of one member of each sibling are grouped, with the siblings' counts as weights.
   From here on rows are distinct blocks and their turns, not conversations.
4. Sums over subtrees need no walk.  A node is entered at its smallest member, whose blocks lie on
   the path to it: leaves and savings are added up along these blocks, from the end of each
   conversation to its start, and then per block group.

Defined results: null roles and texts are empty; turns are in the order of ``turn`` (null first), equal
ones in the order of role and text.  Repeated rows are turns of their own.  Rows without a conv_id
belong to no conversation and are left out.  Texts are read whole.  An empty table has no node.
Other columns, whatever their names, are ignored.

The digest of a node's ends is a SHA-256 over all its ids in one string, which is one chain of steps.
Ids are joined in pieces of ``PIECE`` by all tasks; then one task per node feeds the pieces to the hash
as they come, so it never holds more than a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators.ordered import row_numbers, running
from lakeops.session import settle

#: Digest columns; sums of 32-bit hashes cannot pass 64 bits below 2^31 turns a conversation.
DIGEST = ["d0", "d1", "d2", "d3"]
PARENT = ["p0", "p1", "p2", "p3"]
#: Ids joined into one piece of text before they are hashed.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation, numbered from 0."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("_has"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    numbered = row_numbers(rows, ["conv_id"], ["_has", "turn", "role", "text"], "_rn")
    return numbered.select("conv_id", (F.col("_rn") - 1).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``turns`` with the first h turns of each conversation taken from the first one of its group.

    h is the conversation's crc32 modulo ``most``; the group's first is ``conv_id - conv_id % group``.
    A conversation without turns gives no row.
    """
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("head")  # at most ``most`` turns
    )
    based = ids.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(heads, "base", "left")
    based = based.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    lent = based.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = turns.join(based.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos >= h")
    return lent.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "role", "text"))


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, d0..d3, chars): each turn's hashes at its place, and its code points."""
    a, b = (F.xxhash64(F.lit(salt), "pos", "role", "text") for salt in (1, 2))
    low = F.lit(2**32 - 1)
    parts = [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]
    return turns.select("conv_id", "pos", *[p.alias(d) for p, d in zip(parts, DIGEST)], F.length("text").cast("long").alias("chars"))


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, n_turns, p0..p3, d0..d3): digests before and after block k of each conversation."""
    own = turns.groupBy("conv_id", F.expr(f"pos DIV {block}").alias("k")).agg(F.count(F.lit(1)).alias("n_turns"), *[F.sum(d).alias(f"own_{d}") for d in DIGEST])
    summed = running(own, ["conv_id"], ["k"], {d: F.col(f"own_{d}") for d in DIGEST}, {"last": F.lit(1).cast("long")}, settle_input=True)
    before = [(F.col(d) - F.col(f"own_{d}")).alias(p) for d, p in zip(DIGEST, PARENT)]
    return summed.select("conv_id", "k", "n_turns", *before, *DIGEST, (F.col("k") + 1 == F.col("last")).alias("ends"))


def keyed(columns: list[str], other: str) -> Column:
    """Equality of ``columns`` with those of the same names behind ``other``."""
    found = F.lit(True)
    for c in columns:
        found &= F.col(c) == F.col(f"{other}{c}")
    return found


def aliased(df: DataFrame, columns: list[str], before: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{before}{c}") if c in columns else F.col(c) for c in df.columns])


def nodes(conversations: DataFrame, ids: DataFrame, block: int = 4) -> DataFrame:
    """One row per node of the trie over ``conversations`` (conv_id, pos, role, text).

    ``ids`` (conv_id) are all conversations, those without turns included.  The columns are
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, code points of each node's last text times its members less one) and
    ends_sha256 (of the ids of the conversations that end there, ascending, joined by commas).
    """
    turns = settle(hashed(conversations), "trie-turns")
    blocks = settle(blocks_of(turns, block), "trie-blocks")
    group_key = ["k", *PARENT, *DIGEST]
    groups = blocks.groupBy(*group_key).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.max("n_turns").alias("n_turns"))
    # A block group whose parent has others beside it has to be refined.
    siblings = groups.groupBy("k", *PARENT).agg(F.count(F.lit(1)).alias("n_siblings"))
    groups = groups.join(aliased(siblings, ["k", *PARENT], "s_"), keyed(["k", *PARENT], "s_")).drop(*[f"s_{c}" for c in ["k", *PARENT]])
    groups = settle(groups.withColumn("split", F.col("n_siblings") > 1).drop("n_siblings"), "trie-groups")

    # The turns of one member of each block group, with the digest after each turn.
    reps = groups.select(F.col("rep").alias("conv_id"), "k", F.col("n").alias("g_n"), "split", *PARENT, *[F.col(d).alias(f"g_{d}") for d in DIGEST])
    inside = Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one block
    steps = turns.withColumn("k", F.expr(f"pos DIV {block}")).join(reps, ["conv_id", "k"])
    after = {d: F.col(p) + F.sum(d).over(inside) for d, p in zip(DIGEST, PARENT)}
    steps = settle(steps.select("*", *[c.alias(f"a_{d}") for d, c in after.items()]).select(
        "conv_id", "k", (F.col("pos") + 1).alias("depth"), "chars", "split", F.col("g_n").alias("n"),
        *[F.col(f"g_{d}") for d in DIGEST], *[F.col(f"a_{d}").alias(d) for d in DIGEST],
        *[(F.col(f"a_{d}") - F.col(d)).alias(p) for d, p in zip(DIGEST, PARENT)],
    ), "trie-steps")
    node_key = ["depth", *DIGEST]
    met = steps.where("split").groupBy(*node_key).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"))
    refined = steps.where("split").join(aliased(met, node_key, "m_"), keyed(node_key, "m_")).drop(*[f"m_{c}" for c in node_key])
    plain = steps.where("NOT split").withColumns({"n_convs": F.col("n"), "first": F.col("conv_id")})
    # Each node's weight is entered at the block group of its smallest member.
    weighed = settle(
        refined.unionByName(plain).withColumn("own", F.when(F.col("first") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(F.lit(0).cast("long"))),
        "trie-weighed",
    )

    children = weighed.where("first = conv_id").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(d) for p, d in zip(PARENT, DIGEST)]).agg(F.count(F.lit(1)).alias("n_children"))
    children = settle(children, "trie-children")
    tops = aliased(children, node_key, "c_")
    placed = weighed.join(tops, keyed(node_key, "c_"), "left").drop(*[f"c_{c}" for c in node_key]).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    placed = settle(placed, "trie-placed")

    # Of each block group: leaves entered at its smallest member, and weights entered in the block.
    entered = placed.groupBy("conv_id", "k").agg(
        F.sum("own").alias("weight"), F.sum(F.when((F.col("n_children") == 0) & (F.col("first") == F.col("conv_id")), 1).otherwise(0)).alias("leaves")
    )
    paths = blocks.select("conv_id", "k", *PARENT, *DIGEST).join(entered.select("conv_id").distinct(), "conv_id", "left_semi").join(entered, ["conv_id", "k"], "left")
    paths = paths.select("conv_id", "k", *PARENT, *DIGEST, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("weight", "leaves")])
    # A leaf is the last node of its conversation, so its block has it or all its ancestors.
    down = running(paths, ["conv_id"], ["-k"], {"weights": F.col("weight"), "leaf": F.col("leaves")}, settle_input=True)
    below = down.groupBy(*group_key).agg(F.sum(F.col("weights") - F.col("weight")).alias("below"), F.sum("leaf").alias("leaves"))
    of_group = aliased(below, ["k", *DIGEST], "b_").drop(*PARENT)
    later = Window.partitionBy("conv_id", "k").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = (F.col("k") == F.col("b_k")) & keyed([f"g_{d}" for d in DIGEST], "of_")
    of_group = of_group.select("b_k", "below", "leaves", *[F.col(f"b_{d}").alias(f"of_g_{d}") for d in DIGEST])
    carried = placed.withColumn("rest", F.sum("own").over(later)).join(of_group, on)
    summed = carried.groupBy(*node_key, *PARENT).agg(
        F.min("first").alias("conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.max("n_children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        (F.sum("rest") + F.sum("below")).alias("saved_tokens"),
    )
    summed = settle(summed, "trie-nodes")
    everyone = ids.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    of_root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    tops = summed.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = of_root.unionByName(tops, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")])
    root = root.where("n_convs > 0").withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0))})
    root = root.withColumns({c: F.lit(0).cast("long") for c in ("depth", *DIGEST, *PARENT)})
    tree = summed.unionByName(root)
    parents = tree.select((F.col("depth") + 1).alias("u_depth"), *[F.col(d).alias(f"u_{d}") for d in DIGEST], F.col("conv_id").alias("parent_conv_id"))
    on = (F.col("depth") == F.col("u_depth")) & F.lit(True)
    for d, p in zip(DIGEST, PARENT):
        on &= F.col(p) == F.col(f"u_{d}")
    ends = aliased(ends_of(everyone, blocks, turns), node_key, "e_")
    named = tree.join(parents, on, "left").join(ends, keyed(node_key, "e_"), "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def ends_of(ids: DataFrame, blocks: DataFrame, turns: DataFrame) -> DataFrame:
    """(depth, d0..d3, ends_sha256) of the nodes at which a conversation ends."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"))
    last = blocks.where("ends").select("conv_id", *DIGEST).join(lengths, "conv_id")
    zero = F.lit(0).cast("long")
    ended = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("depth", *DIGEST)])
    node_key = ["depth", *DIGEST]
    numbered = row_numbers(ended, node_key, ["conv_id"], "_rn", settle_input=True)
    pieces = numbered.groupBy(*node_key, F.expr(f"(_rn - 1) DIV {PIECE}").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")  # PIECE ids
    )
    alone = pieces.groupBy(*node_key).agg(F.max("piece").alias("pieces"), F.any_value("ids").alias("ids"))
    short = alone.where("pieces = 0").select(*node_key, F.sha2("ids", 256).alias("ends_sha256"))
    long = aliased(alone.where("pieces > 0").select(*node_key), node_key, "l_")
    many = pieces.join(long, keyed(node_key, "l_")).drop(*[f"l_{c}" for c in node_key])
    chained = many.repartition(*node_key).sortWithinPartitions(*node_key, "piece").select(*node_key, "ids")
    return short.unionByName(chained.mapInArrow(hash_chains, ", ".join(f"{c} long" for c in node_key) + ", ends_sha256 string"))


def hash_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each run of equal keys; one state at a time."""
    names = ["depth", *DIGEST]
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("ends_sha256", pa.string())])
    held, state = None, None
    for batch in batches:
        done = []
        for row in zip(*[batch[c].to_pylist() for c in (*names, "ids")]):
            if row[:-1] != held:
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = row[:-1], hashlib.sha256(row[-1].encode())
            else:
                state.update(b"," + row[-1].encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, state.hexdigest())], schema=schema)


def tree(conversations: DataFrame, block: int = 4) -> DataFrame:
    """The nodes of all conversations as they are."""
    turns = settle(turns_of(conversations), "trie-source")
    return nodes(turns, turns.select("conv_id").distinct(), block)


def rebuilt_tree(conversations: DataFrame, block: int = 4) -> DataFrame:
    """The nodes after each conversation's first turns were taken from the first one of its group."""
    turns = settle(turns_of(conversations), "trie-source")
    return nodes(rebuilt(turns), turns.select("conv_id").distinct(), block)
