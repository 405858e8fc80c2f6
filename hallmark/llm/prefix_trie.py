"""Prefix tries of conversations, built as burst tries.

A node is a distinct beginning of conversations. Conversations under one node, the head,
form a container, which holds what follows the head. A container of too many turns
bursts: its conversations go to containers of their own by their next turn's id, and its
head becomes an inner node. The containers that remain are sorted and swept, each by one
task, into the nodes below their heads; a conversation alone in its container needs no
sweep, as its nodes follow from running sums. Inner nodes add up their children, deepest first.

Equal conversations are one, with a weight, so a conversation that very many share
bursts nothing. No step holds a conversation as one value: turns are rows, and places in
a long conversation are counted across the tasks that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hallmark.llm.tables import settled, step

#: Turns that a container may hold; more burst it.
CONTAINER_TURNS = 20_000
#: Members of an end that one piece of its list names: 2 to this power.
MEMBER_BITS = 12
NONE = hashlib.sha256(b"").hexdigest()

_NODE = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
_NODES = ", ".join(f"{name} long" for name in _NODE)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, size): a turn's id is 128 bits of its role's and text's digest."""
    settled(conversations.sparkSession)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(digest, 1, 32)).alias("tid"),
        F.length(text).cast("long").alias("size"),
    ).where("conv_id is not null")


def placed(rows: DataFrame) -> DataFrame:
    """Add `pos`, a turn's place in its conversation from 0, and `upto`, the sizes until it.

    Turns are sorted by ranges, so a long conversation lies in several tasks; each counts
    its own share, and the shares before it are added.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = step(dealt.select("conv_id", "tid", "size", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")))
    shares = marked.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"), F.sum("size").alias("sizes"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        "conv_id", "part", "low",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("before_size"),
    )
    own = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(shares, ["conv_id", "part"]).select(
        "conv_id",
        (F.col("at") - F.col("low") + F.col("before")).alias("pos"),
        "tid",
        "size",
        (F.sum("size").over(own) + F.col("before_size")).alias("upto"),
    )


def rebuilt(rows: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one.

    Of `rows` as `placed` gives them, each conversation becomes the first `taken` turns
    (`most` at most) of conversation `base`, then its own turns after as many. Both are
    expressions of conv_id. Returns the turns and the table of all conv_id.
    """
    rows = rows.withColumn("h", taken)
    convs = step(rows.groupBy("conv_id", "h").agg(F.sum(F.when(F.col("pos") < F.col("h"), F.col("size")).otherwise(0)).alias("cut")))
    heads = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "tid", "size", "upto")
    first = convs.select("conv_id", "h", base.alias("base")).join(heads, "base").where("pos < h")
    first = step(first.select("conv_id", "pos", "tid", "size", "upto"))
    put = first.groupBy("conv_id").agg(F.count("*").alias("put"), F.sum("size").alias("put_size"))
    moved = convs.join(put, "conv_id", "left").select(
        "conv_id", (F.coalesce("put", F.lit(0)) - F.col("h")).alias("by"), (F.coalesce("put_size", F.lit(0)) - F.col("cut")).alias("by_size")
    )
    rest = rows.where("pos >= h").join(moved, "conv_id").select(
        "conv_id", (F.col("pos") + F.col("by")).alias("pos"), "tid", "size", (F.col("upto") + F.col("by_size")).alias("upto")
    )
    return first.union(rest), convs.select("conv_id")


def trie(rows: DataFrame, convs: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of each node over the conversations `convs` with the turns `rows`.

    A conversation without turns ends at the root. Without conversations there is no
    node. `limit` bounds what a task holds, and changes no result.
    """
    rows = step(rows)
    print_ = ["f1", "f2", "turns"]
    prints = rows.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64("pos", "tid")).alias("f1"), F.bit_xor(F.xxhash64("tid", "pos", F.lit(13))).alias("f2"),
        F.count("*").alias("turns"), F.sum("size").alias("total"),
    )
    zero = F.lit(0).cast("long")
    prints = step(convs.join(prints, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in [*print_, "total"]]))
    classes = step(
        prints.groupBy(print_).agg(F.min("conv_id").alias("end"), F.count("*").alias("weight"), F.max("total").alias("total"))
    )
    own = step(rows.withColumnRenamed("conv_id", "end").join(classes.select("end"), "end", "left_semi"))
    tops, inner, below = _burst(classes, own, limit)
    nodes = below.unionByName(_summed(tops, inner))
    named = _ends(prints, print_).join(classes.select(*print_, "end"), print_).select("end", "ends_sha256")
    ended = nodes.where("end is not null").join(named, "end")
    others = nodes.where("end is null").withColumn("ends_sha256", F.lit(NONE))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return ended.select(columns).union(others.select(columns))


def _burst(classes: DataFrame, rows: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Containers, burst until they fit, and swept.

    Returns the nodes at the containers' heads (with `head`, `parent` and `size`), for each depth
    the burst heads and the conversations that end there, and the nodes below the containers' heads.
    """
    root = F.lit(bytes(16))
    open_ = classes.select("end", "weight", "turns", "total", root.alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    shut: list[DataFrame] = []
    inner: list[DataFrame] = []
    while True:
        depth = len(inner)
        open_ = open_.withColumn("depth", F.lit(depth).cast("long"))
        sizes = open_.groupBy("head").agg(F.count("*").alias("members"), F.sum(F.col("turns") - depth).alias("held"))
        marked = step(open_.join(sizes, "head").withColumn("full", F.expr(f"members > 1 and held > {limit}")))
        shut.append(marked.where("not full"))
        full = marked.where("full")
        if full.isEmpty():
            break
        ends = F.max(F.when(F.col("turns") == depth, F.struct("end", "weight"))).alias("at")
        inner.append(step(full.groupBy("head", "parent", "size", "depth").agg(ends)))
        following = rows.where(F.col("pos") == depth).select("end", "tid", F.col("size").alias("next"))
        open_ = full.join(following, "end").select(
            "end", "weight", "turns", "total",
            F.unhex(F.substring(F.sha2(F.concat("head", "tid"), 256), 1, 32)).alias("head"),
            F.col("head").alias("parent"),
            F.col("next").alias("size"),
        )
    settled_ = shut[0]
    for more in shut[1:]:
        settled_ = settled_.union(more)

    alone = settled_.where("members = 1")
    upto = F.when(F.col("depth") > 0, F.col("upto_head")).otherwise(0)
    heads = rows.select("end", (F.col("pos") + 1).alias("depth"), F.col("upto").alias("upto_head"))
    chain_tops = alone.join(heads, ["end", "depth"], "left").select(
        "head", "parent", "size", "depth", F.col("end").alias("conv_id"), F.col("weight").alias("n_convs"),
        (F.col("turns") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("total") - upto + F.col("size"))).alias("saved_tokens"),
        F.when(F.col("turns") == F.col("depth"), F.col("end")).alias("end"),
    )
    chains = rows.join(alone.select("end", "weight", "turns", "total", "depth"), "end").where("pos >= depth")
    last = F.col("pos") + 1 == F.col("turns")
    chained = chains.select(
        (F.col("pos") + 1).alias("depth"), F.col("end").alias("conv_id"), F.col("end").alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        F.when(last, F.col("end")).alias("end"),
    )
    together = settled_.where("members > 1").select("head", "parent", F.col("size").alias("top"), "depth", "end", "weight")
    kept = together.join(rows.select("end", "pos", "tid", "size"), "end").where("pos >= depth")
    # those that end at the head have no turn there, and one row all the same
    bare = settled_.where("members > 1 and turns = depth").select(
        "head", "parent", F.col("size").alias("top"), "depth", "end", "weight",
        F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), F.lit(None).cast("long").alias("size"),
    )
    held = kept.select(bare.columns).union(bare)
    swept = step(
        held.repartition("head")
        .sortWithinPartitions("head", "end", "pos")
        .mapInArrow(_sweep, f"head binary, parent binary, size long, parent_conv_id long, {_NODES}")
    )
    tops = chain_tops.select("head", "parent", "size", *_NODE).union(
        swept.where("head is not null").select("head", "parent", "size", *_NODE)
    )
    below = swept.where("head is null").select("parent_conv_id", *_NODE).unionByName(chained.select("parent_conv_id", *_NODE))
    return step(tops), inner, below


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows follow each other; only the top has a head."""
    held: list[tuple] = []
    current = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[0] != current and held:
                yield _container(held)
                held = []
            current = row[0]
            held.append(row)
    if held:
        yield _container(held)


def _container(rows: list[tuple]) -> pa.RecordBatch:
    head, parent, top, first = rows[0][:4]
    members: dict[int, tuple[int, list[bytes], list[int]]] = {}
    for _, _, _, _, end, weight, pos, tid, size in rows:
        _, tids, sizes = members.setdefault(end, (weight, [], []))
        if pos is not None:
            tids.append(tid)
            sizes.append(size)
    depth, up, low, convs, children, size_, ends = [first], [-1], [None], [0], [0], [top], [None]
    path, last = [0], []
    for end, (weight, tids, sizes) in sorted(members.items(), key=lambda item: item[1][1]):
        shared = 0
        while shared < min(len(last), len(tids)) and last[shared] == tids[shared]:
            shared += 1
        del path[shared + 1 :]
        for k in range(shared, len(tids)):
            children[path[-1]] += 1
            up.append(path[-1])
            path.append(len(depth))
            depth.append(first + k + 1)
            low.append(None)
            convs.append(0)
            children.append(0)
            size_.append(sizes[k])
            ends.append(None)
        for node in path:
            convs[node] += weight
            low[node] = end if low[node] is None else min(low[node], end)
        ends[path[-1]], last = end, tids
    count = len(depth)
    leaves = [int(not c) for c in children]
    saved = [(n - 1) * s for n, s in zip(convs, size_, strict=True)]
    for node in range(count - 1, 0, -1):
        leaves[up[node]] += leaves[node]
        saved[up[node]] += saved[node]
    above = [None, *[low[k] for k in up[1:]]]
    numbers = [above, depth, low, convs, children, leaves, saved, ends]
    nothing = [None] * (count - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([head, *nothing], pa.binary()), pa.array([parent, *nothing], pa.binary()), *[pa.array(x, pa.int64()) for x in ([top, *nothing], *numbers)]],
        names=["head", "parent", "size", "parent_conv_id", *_NODE],
    )


def _summed(tops: DataFrame, inner: list[DataFrame]) -> DataFrame:
    """Nodes at containers' heads and burst heads, which add up their children."""
    levels: list[DataFrame] = []
    lowest: DataFrame | None = None
    for depth in range(len(inner) - 1, -1, -1):
        children = tops.where(F.col("depth") == depth + 1)
        if lowest is not None:
            children = children.unionByName(lowest)
        sums = children.groupBy(F.col("parent").alias("head")).agg(
            F.min("conv_id").alias("low"), F.sum("n_convs").alias("convs"), F.count("*").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"),
        )
        convs = F.col("convs") + F.coalesce("at.weight", F.lit(0))
        lowest = step(
            inner[depth].join(sums, "head").select(
                "head", "parent", "size", "depth", F.least("low", "at.end").alias("conv_id"), convs.alias("n_convs"), "n_children", "n_leaves",
                (F.col("saved") + (convs - 1) * F.col("size")).alias("saved_tokens"), F.col("at.end").alias("end"),
            )
        )
        levels.append(lowest)
    nodes = tops
    for level in levels:
        nodes = nodes.unionByName(level)
    if not levels:
        return nodes.select("*", F.lit(None).cast("long").alias("parent_conv_id")).drop("head", "parent", "size")
    parents = levels[0]
    for level in levels[1:]:
        parents = parents.unionByName(level)
    parents = parents.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").drop("head", "parent", "size")


def _ends(prints: DataFrame, print_: list[str]) -> DataFrame:
    """Digest of the ascending list of equal conversations' ids.

    Lists are put together by pieces of a few thousand ids, in all tasks; where a list has several pieces
    one task runs through them in order, as the digest demands, and holds one at a time.
    """
    order = [*print_, "conv_id"]
    dealt = prints.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), MEMBER_BITS))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    texts = step(blocks.groupBy(*print_, "block").agg(F.array_join(ids, ",").alias("text")))
    counts = texts.groupBy(print_).agg(F.count("*").alias("pieces"))
    counted = texts.join(counts, print_)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(print_) + 1)]
            for *key, text in zip(*columns, strict=True):
                if key != current:
                    if state:
                        yield _digested(current, state)
                    current, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state:
            yield _digested(current, state)

    def _digested(key: list[int], state) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip(print_, key, strict=True)}, "ends_sha256": [state.hexdigest()]})

    several = (
        counted.where("pieces > 1").repartition(*print_).sortWithinPartitions(*print_, "block").select(*print_, "text")
        .mapInArrow(digest, "f1 long, f2 long, turns long, ends_sha256 string")
    )
    return counted.where("pieces = 1").select(*print_, F.sha2("text", 256).alias("ends_sha256")).union(several)


def shared_prefixes(conversations: DataFrame, most: int = 6, group: int = 100, limit: int = CONTAINER_TURNS) -> DataFrame:
    """The trie of conversations that begin with another one's turns.

    Turns go by `turn`, null first; those of one number by their id, a hash. Conversation c is the
    first h turns of c - c % `group` (all if there are fewer, none if that is absent), then its own turns
    after its first h; h is crc32 of c's decimal digits modulo `most`. Null roles and texts are
    empty; repeated rows are turns as often as they stand there; rows without a conv_id and other columns
    are not read. An empty table has no node.
    """
    conv = F.col("conv_id")
    rows = placed(turns(conversations))
    taken = F.crc32(conv.cast("string").cast("binary")) % most
    return trie(*rebuilt(rows, conv - conv % group, taken, most - 1), limit)
