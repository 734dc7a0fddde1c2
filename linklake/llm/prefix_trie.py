"""Prefix trie of conversations, with subtree figures by the Euler-tour technique.

Method: every distinct sequence of first turns is a node. Each node has an enter and an exit arc; an arc's follower is
found from the node's first child, next sibling or parent, so all arcs form one list, the Euler tour. The tour is
ranked distributedly (``list_rank``), which gives for every arc its position and the sums of leaves and savings at the
positions before it. A subtree's figures are the sum at its exit less the sum at its enter.

Nodes are named by depth and 128 bits: the exclusive-or of a hash of each turn with its place. So a prefix's name
comes from sums over slices of a conversation, and no conversation is ever gathered in one task; ranks within
conversations come from a sort by range. Texts are read once and carried no further than that sort.

Defined results: null roles and texts count as empty; turns go by number, nulls first, then by role and text; equal rows are turns
of their own. Rows without a conversation are left out. An empty table gives the root alone, without members. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage
from .list_rank import END, ranked

SLICE = 1024
NAME = ["depth", "x1", "x2"]


def sorted_rows(df: DataFrame, order: list, keep: list[Column]) -> DataFrame:
    """``keep`` columns with ``part`` and ``at``, which grow in the given order over the whole table."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(placed.select(*keep, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, c1, c2, chars): every turn with its place and 128 bits of its content."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = sorted_rows(rows, order, [F.col("conv_id"), F.length("text").cast("long").alias("chars"), content.alias("content")])
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.min("at").alias("start"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    pos = F.col("at") - F.col("start") + F.col("rows_before") + 1
    c1, c2 = F.xxhash64("content"), F.xxhash64(F.lit(1), "content")
    return cut_lineage(placed.join(parts, ["conv_id", "part"]).select("conv_id", pos.alias("pos"), c1.alias("c1"), c2.alias("c2"), "chars"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and their turns (conv_id, depth, ...) without change."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("total")), turns.withColumnRenamed("pos", "depth")


def shared_heads(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The same after each conversation's first h turns are replaced by those of its block's first conversation.

    h is the checksum of the conversation's id modulo ``most``. A head is as long as that conversation allows; own turns follow it.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    plan = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    plan = plan.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    plan = cut_lineage(plan.withColumn("total", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    what = ["c1", "c2", "chars"]
    heads = turns.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), *what)
    heads = plan.select("conv_id", "base", "head").join(heads, "base").filter("depth <= head").select("conv_id", "depth", *what)
    own = turns.join(plan.select("conv_id", "h", "head"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), *what)
    return plan.select("conv_id", "total"), heads.union(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, chars): the names of the prefix that ends with each turn and of its parent."""
    named = turns.withColumns({"g1": F.xxhash64("depth", "c1", "c2"), "g2": F.xxhash64("c2", "c1", "depth"), "slice": ((F.col("depth") - 1) / SLICE).cast("long")})
    inside = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = named.withColumns({"x1": F.bit_xor("g1").over(inside), "x2": F.bit_xor("g2").over(inside)})
    slices = named.groupBy("conv_id", "slice").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("conv_id", "slice", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")]).filter("slice > 0")
    out = within.join(carried, ["conv_id", "slice"], "left")
    out = out.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(s, F.lit(0))) for x, s in (("x1", "s1"), ("x2", "s2"))})
    return out.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"), "chars")


def trie_nodes(convs: DataFrame, prefix: DataFrame) -> DataFrame:
    """(id, depth, x1, x2, p1, p2, conv_id, n_convs, chars); the root has id 0."""
    zero = lambda x: F.lit(0).cast("long").alias(x)
    nodes = prefix.groupBy(*NAME).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.select(zero("id"), *[zero(x) for x in (*NAME, "p1", "p2")], "conv_id", "n_convs", zero("chars"))
    return cut_lineage(nodes.select((F.monotonically_increasing_id() + 1).alias("id"), *nodes.columns).union(root))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` and their parent's id and conv_id."""
    root = nodes.filter("depth = 0").first().conv_id
    above = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(above, ["depth", "p1", "p2"]).select(*nodes.columns, "parent", "parent_conv_id")
    # the root is known, so that all nodes under it need no join
    top = nodes.filter("depth = 1").select(*nodes.columns, F.lit(0).cast("long").alias("parent"), F.lit(root).cast("long").alias("parent_conv_id"))
    return cut_lineage(deep.union(top))


def next_siblings(children: DataFrame) -> DataFrame:
    """(id, sibling): the child that follows under the same parent by conv_id, null after the last.

    Children stay in the tasks a sort by range dealt them to; only the first child of each task is passed to the one before.
    """
    placed = sorted_rows(children, ["parent", "conv_id"], [F.col("id"), F.col("parent")])
    me = F.struct("parent", "id")
    here = Window.partitionBy("part").orderBy("at")
    firsts = placed.groupBy("part").agg(F.min_by(me, "at").alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("beyond"))  # a row for each task of the sort
    after = F.coalesce(F.lead(me).over(here), F.col("beyond"))
    met = placed.join(firsts, "part").select("id", "parent", after.alias("after"))
    return met.select("id", F.when(F.col("after.parent") == F.col("parent"), F.col("after.id")).alias("sibling"))


def euler_tour(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """The arcs of the tour as a weighted list: a leaf weighs 1 in ``a``, savings are in ``b``, both on enter arcs.

    Node v is entered by arc 2v and left by arc 2v + 1.
    """
    firsts = children.groupBy("parent").agg(F.min_by("id", "conv_id").alias("child")).withColumnRenamed("parent", "id")
    slice_of = F.xxhash64("conv_id", (F.col("depth") / 4096).cast("long"))
    about = [F.coalesce("conv_id", F.lit(0)).alias("near"), F.lit(1).cast("long").alias("n")]
    zero = F.lit(0).cast("long")
    enter = nodes.join(firsts, "id", "left").select(
        (F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"), *about,
        F.when(F.col("child").isNull(), 1).otherwise(0).cast("long").alias("a"), ((F.col("n_convs") - 1) * F.col("chars")).alias("b"), slice_of.alias("together"),
    )
    leave = nodes.join(next_siblings(children), "id", "left").select(
        (F.col("id") * 2 + 1).alias("arc"),
        F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(END)).cast("long").alias("next"), *about,
        zero.alias("a"), zero.alias("b"), slice_of.alias("together"),
    )
    return cut_lineage(enter.union(leave))


def subtree_figures(nodes: DataFrame, children: DataFrame, **how) -> DataFrame:
    """(id, n_leaves, saved_tokens) of every node's subtree."""
    sums = ranked(euler_tour(nodes, children), "together", **how)
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    return sums.groupBy(F.floor(F.col("arc") / 2).cast("long").alias("id")).agg(F.sum(sign * F.col("before_a")).alias("n_leaves"), F.sum(sign * F.col("before_b")).alias("saved_tokens"))


def ends(convs: DataFrame, prefix: DataFrame) -> DataFrame:
    """(depth, x1, x2, conv_id): the node at which each conversation ends."""
    zero = lambda x: F.lit(0).cast("long").alias(x)
    last = prefix.join(convs.select("conv_id", F.col("total").alias("depth")), ["conv_id", "depth"]).select(*NAME, "conv_id")
    return last.union(convs.filter("total = 0").select(*[zero(x) for x in NAME], "conv_id"))


def end_digests(ended: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): SHA-256 of each node's ended conversations, ascending and comma-joined.

    The digest of a sequence can only be worked out in its order; a task streams it and holds no more than a batch of ids.
    """
    schema = T.StructType([ended.schema[x] for x in NAME] + [T.StructField("ends_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made, out = None, None, []
        for batch in batches:
            for *here, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != name:
                    if made is not None:
                        out.append((*name, made.hexdigest()))
                    name, made = here, hashlib.sha256(str(conv).encode())
                else:
                    made.update(b",%d" % conv)
            if len(out) >= 10_000:
                yield rows(out)
                out = []
        if made is not None:
            out.append((*name, made.hexdigest()))
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return ended.repartition(*NAME).sortWithinPartitions(*NAME, "conv_id").select(*NAME, "conv_id").mapInArrow(digest, schema)


def prefix_trie(conversations: DataFrame, rebuild: Callable = as_they_are, **how) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and (depth, x1, x2, conv_id) of the node at which each conversation ends.

    Nodes have id, depth, x1, x2, conv_id (smallest member), parent, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens. ``rebuild`` turns numbered turns into the conversations that the trie holds. ``how`` goes to the list ranking.
    """
    convs, turns = rebuild(numbered_turns(conversations))
    prefix = cut_lineage(prefixes(turns))
    nodes = trie_nodes(convs, prefix)
    children = with_parents(nodes)
    under = children.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    both = nodes.filter("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")}).union(children)
    both = both.join(under, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    both = cut_lineage(both)
    found = both.join(subtree_figures(both, children, **how), "id")
    return found.select("id", *NAME, "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends(convs, prefix)


def digested(conversations: DataFrame, rebuild: Callable = shared_heads, **how) -> DataFrame:
    """The trie's nodes with ``ends_sha256`` in place of names."""
    nodes, ended = prefix_trie(conversations, rebuild, **how)
    nobody = hashlib.sha256(b"").hexdigest()
    found = nodes.join(end_digests(ended), NAME, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
