"""Prefix trie of conversations by fixed-length block hashing.

Every conversation is cut into blocks of a fixed number of turns, one row per block. The digest of a block's
end covers all turns up to it, so conversations are grouped by successive block digests with one
aggregate. A block without a sibling has the same members at each of its turns and is written out as it
is; only blocks whose siblings diverge are opened, and their turn digests grouped once more.

Digests of prefixes are sums of position-dependent turn hashes, so they are running sums over chunks of a
conversation: no conversation, node or group of copies has to fit a task. What a node says about its
whole subtree is a sum of one number per member conversation, by the same two aggregates:

* a leaf counts for its smallest member,
* the distinct texts below a node are split among conversations: each node belongs to its smallest member.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import saved

BLOCK_TURNS = 8
CHUNK_BLOCKS = 4096
HASHES = ["s1", "s2", "s3", "s4"]  # halves of two 64-bit hashes: their sums cannot overflow


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1 by ``turn_col``, null first; ties by role and text.

    Rows with a null conversation are left out; null roles and texts become empty; repeated rows are turns
    of their own. Rows are sorted over the whole table and counted by part, so a long conversation is
    spread over tasks.
    """
    keys = ["conv_id", "turn", "role", "text", "place"]
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    parts = saved(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "turn-parts")
    number = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*keys[1:]))
    before = F.sum("n").over(  # one row per part and conversation
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = parts.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    later = sizes.withColumn("before", before).where("before > 0").select("part", "conv_id", "before")
    return (
        parts.withColumn("number", number).join(later, ["part", "conv_id"], "left")
        .select("conv_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")
    )


def rebuilt_turns(
    convs: DataFrame, turns: DataFrame, shared: Column, donor: Column, most_shared: int
) -> DataFrame:
    """(conv_id, pos, role, text): the first ``shared`` turns of the ``donor``, then the own turns after
    that many.

    ``convs`` has a row per conv_id, over which ``shared`` (at most ``most_shared``) and ``donor`` are
    computed; ``turns`` comes from ``ordered_turns``. A donor without turns gives none.
    """
    plan = convs.select("conv_id", shared.alias("shared"), donor.alias("donor"))
    own = (
        turns.join(plan.select("conv_id", "shared"), "conv_id").where("pos > shared")
        .select("conv_id", "pos", "role", "text")
    )
    given = turns.where(F.col("pos") <= most_shared).withColumnRenamed("conv_id", "donor").join(plan, "donor")
    taken = given.where("pos <= shared")
    sizes = taken.groupBy("conv_id").agg(F.max("pos").alias("got"))
    moved = own.join(plan.select("conv_id", "shared"), "conv_id").join(sizes, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.col("shared") + F.coalesce("got", F.lit(0))).alias("pos"), "role", "text"
    )
    return moved.unionByName(taken.select("conv_id", "pos", "role", "text"))


def conversation_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, up, up_bytes, end, end_bytes, turns): one row per block of ``block_turns`` turns, saved.

    ``up`` and ``end`` are the digests of all turns before the block and up to its end, ``up_bytes`` and
    ``end_bytes`` their bytes; ``turns`` has the running digests and bytes within the block.
    """
    pos, hashes = F.col("pos"), []
    for seed in (1, 2):
        whole = F.xxhash64(F.lit(seed), pos, F.length("role"), "role", "text")
        hashes += [whole.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(whole, 32)]
    rows = turns.select(
        "conv_id", pos, F.floor((pos - 1) / block_turns).alias("block"),
        F.octet_length("text").cast("long").alias("bytes"), *[h.alias(n) for h, n in zip(hashes, HASHES)],
    )
    sums = [*HASHES, "bytes"]
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{s}_to": F.sum(s).over(so_far) for s in sums})
    turn = F.struct("pos", "bytes", *[F.col(f"{s}_to").alias(s) for s in HASHES], *[
        (F.col(f"{s}_to") - F.col(s)).alias(f"{s}_before") for s in sums
    ])
    blocks = rows.groupBy("conv_id", "block").agg(
        *[F.sum(s).alias(s) for s in sums], F.sort_array(F.collect_list(turn)).alias("turns"),
    ).withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    blocks = saved(blocks, "conversation-blocks")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = blocks.groupBy("conv_id", "chunk").agg(*[F.sum(s).alias(s) for s in sums])
    across = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "chunk", *[F.sum(s).over(across).alias(f"{s}_0") for s in sums])
    ends = {f"{s}_1": F.sum(s).over(inside) + F.coalesce(f"{s}_0", F.lit(0)) for s in sums}
    rows = blocks.join(before, ["conv_id", "chunk"]).withColumns(ends)
    up = [(F.col(f"{s}_1") - F.col(s)).alias(s) for s in sums]
    end = [F.col(f"{s}_1").alias(s) for s in sums]
    return saved(
        rows.select("conv_id", "block", F.struct(*up[:4]).alias("up"), up[4].alias("up_bytes"),
                    F.struct(*end[:4]).alias("end"), end[4].alias("end_bytes"), "turns"),
        "block-chains",
    )


def _nodes(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """Turn nodes (depth, key, up, bytes, prefix_bytes, conv_id, n, and the sums) of the members' blocks.

    ``key`` and ``up`` are the digests up to a turn and before it. ``sums`` are columns of one number per
    member conversation.
    """
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums]]
    totals = ["n", *sums]
    groups = saved(
        blocks.groupBy("block", "up", "end").agg(
            *members, F.first("turns").alias("turns"), F.first("up_bytes").alias("up_bytes")
        ), "block-groups",
    )
    alone = groups.groupBy("block", "up").agg(F.count("*").alias("siblings"), F.first("end").alias("end"))
    alone = alone.where("siblings = 1").select("block", "end", F.lit(True).alias("alone"))
    marked = saved(groups.join(alone, ["block", "end"], "left"), "marked-groups")

    opened = marked.select("*", F.explode("turns").alias("turn"))
    key = F.struct(*[(F.col(f"up.{h}") + F.col(f"turn.{h}")).alias(h) for h in HASHES])
    before = F.struct(*[(F.col(f"up.{h}") + F.col(f"turn.{h}_before")).alias(h) for h in HASHES])
    turns = opened.select(
        "alone", "conv_id", *totals, F.col("turn.pos").alias("depth"), key.alias("key"), before.alias("up"),
        F.col("turn.bytes").alias("bytes"), (F.col("up_bytes") + F.col("turn.bytes_before")).alias("prefix_bytes"),
    )
    same = ["depth", "key", "up", "bytes", "prefix_bytes"]
    path = turns.where("alone").select(*same, "conv_id", *totals)
    diverged = turns.where("alone is null").groupBy("depth", "key").agg(
        *[F.first(c).alias(c) for c in same[2:]], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in totals],
    )
    return path.unionByName(diverged)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, key, n_ends, ends_sha256): digest of the ids that end at a node, in ascending order.

    The ids of a node pass through a running digest in sorted batches; they are never held together.
    """
    kind = ends.schema["key"].dataType
    keys = [F.col(f"key.{h}").alias(h) for h in HASHES]
    rows = ends.select("depth", *keys, "conv_id").repartition("depth", *HASHES).sortWithinPartitions(
        "depth", *HASHES, "conv_id"
    )
    names = ["depth", *HASHES]

    def run(batches):
        node, digest, count = None, None, 0
        for batch in batches:
            done = []
            ids = batch.column("conv_id").to_pylist()
            tops = list(zip(*[batch.column(n).to_pylist() for n in names]))
            start = 0
            while start < len(ids):
                stop = start + 1
                while stop < len(ids) and tops[stop] == tops[start]:
                    stop += 1
                if tops[start] != node:
                    if node is not None:
                        done.append((*node, count, digest.hexdigest()))
                    node, digest, count = tops[start], hashlib.sha256(), 0
                digest.update(("," * (count > 0) + ",".join(map(str, ids[start:stop]))).encode())
                count += stop - start
                start = stop
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*names, "n_ends", "ends_sha256"])
        if node is not None:
            last = (*node, count, digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], [*names, "n_ends", "ends_sha256"])

    longs = ", ".join(f"{n} long" for n in [*names, "n_ends"])
    found = rows.mapInArrow(run, f"{longs}, ends_sha256 string")
    return found.select("depth", F.struct(*HASHES).cast(kind).alias("key"), "n_ends", "ends_sha256")


def conversation_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the prefix trie: a distinct sequence of the first ``depth`` (role, text) turns.

    ``turns`` has conv_id, pos (1, 2, ... in each conversation), role and text, ``convs`` a row for every
    conv_id, also of those without turns; more columns are ignored. conv_id: smallest member; parent_conv_id:
    its parent's (the root, depth 0, has null); n_convs: members; n_children; n_leaves: childless nodes in its
    subtree, itself included; saved_tokens: over its subtree, (n_convs - 1) times the UTF-8 bytes of a node's
    last text; ends_sha256: of the ascending ids of members without further turns. Repeated conversations are
    members each, repeated rows of ``convs`` one. Without conversations there are no rows.
    """
    convs = saved(convs.where("conv_id is not null").select(F.col("conv_id").cast("long")).distinct(), "convs")
    blocks = conversation_blocks(turns, block_turns)
    last = blocks.groupBy("conv_id").agg(  # the end of a conversation; its digest is that of its last node
        F.max("end_bytes").alias("total"), F.max(F.struct("block", F.size("turns").alias("size"), "end")).alias("e")
    ).select("conv_id", "total", (F.col("e.block") * block_turns + F.col("e.size")).alias("depth"), F.col("e.end").alias("key"))
    last = saved(last, "conversation-ends")
    ends = _end_digests(last)

    members = blocks.join(last.select("conv_id", "total"), "conv_id")
    first = _nodes(members, ["total"]).join(ends, ["depth", "key"], "left")
    first = saved(first.withColumn("n_ends", F.coalesce("n_ends", F.lit(0))), "trie-nodes")

    owned = first.groupBy("conv_id").agg(
        F.sum("bytes").alias("owned"), F.sum(F.when(F.col("n") == F.col("n_ends"), 1).otherwise(0)).alias("leaf")
    )
    shares = saved(
        last.select("conv_id", "total").join(owned, "conv_id", "left").select(
            "conv_id", "total", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")
        ), "shares",
    )
    second = _nodes(blocks.join(shares.select("conv_id", "owned", "leaf"), "conv_id"), ["owned", "leaf"])
    second = second.select("depth", "key", F.col("owned").alias("below"), F.col("leaf").alias("n_leaves"))
    children = first.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(
        F.count("*").alias("n_children")
    )
    # members' texts from here on, less each distinct one once; the smallest member's nodes from here on are its own
    own = shares.select("conv_id", F.col("owned").alias("own"), F.col("total").alias("own_total"))
    after = F.col("total") - F.col("n") * F.col("prefix_bytes")
    distinct = F.col("below") - F.col("own") + F.col("own_total") - F.col("prefix_bytes")
    nodes = (
        first.join(second, ["depth", "key"]).join(children, ["depth", "key"], "left").join(own, "conv_id")
        .select(
            "depth", "key", "up", "conv_id", F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
            (after - distinct).alias("saved_tokens"), "ends_sha256",
        )
    )
    nodes = saved(nodes, "trie")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id")
    )
    root = _root(convs, nodes, shares, last)
    smallest = convs.agg(F.min("conv_id")).first()[0]
    none = F.lit(hashlib.sha256().hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    inner = nodes.where("depth > 1").join(parents, ["depth", "up"])
    return (
        top.select(*columns).unionByName(inner.select(*columns))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none)).unionByName(root.select(*columns))
    )


def _root(convs: DataFrame, nodes: DataFrame, shares: DataFrame, last: DataFrame) -> DataFrame:
    """The root: all conversations, those without turns ending here."""
    kind = last.schema["key"].dataType
    silent = convs.join(last, "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.struct(*[F.lit(0).cast("long").alias(h) for h in HASHES]).cast(kind).alias("key")
    )
    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    sums = shares.agg(
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum("total") - F.sum("owned"), F.lit(0)).alias("saved_tokens"),
    )
    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    ends = _end_digests(silent).select("ends_sha256")
    none = F.lit(hashlib.sha256().hexdigest())
    one = F.lit(1).alias("one")
    row = members.withColumn("one", one)
    for part in (sums, tops, ends):
        row = row.join(part.withColumn("one", one), "one", "left")  # one row each
    return row.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
