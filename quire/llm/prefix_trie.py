"""The prefix trie of conversations, family first.

A family is the conversations of one base id. Turns are numbered within their conversation, then the base's
first turns meet the turns of all members in a cogroup by base id, where the members are rebuilt and the
small trie of the family is built. Only its nodes are shuffled, and merged by a 128-bit key that stands for
the sequence of turns: every turn's digest is mixed with its depth, and the key is the exclusive or of these, so it
can be carried over from one piece of a long conversation to the next.

The least member of a node owns it. What a conversation owns is a chain that ends where it ends, so sums
over subtrees are sums over members: of the chains that the members own, and of the rest of the owner's chain.

Nothing is gathered for a whole conversation: turns are numbered across range partitions, and cut into pieces
of PIECE turns, which are families' pieces as well. The ids that end at a node are hashed from pieces of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize

#: Turns that a member of a family may take from the base, at most.
HEAD = 8
#: Turns of a conversation in one piece of a family.
PIECE = 1024
#: Characters of ids in one piece of text.
TEXT = 1 << 16
FAMILY = 5
#: A parent with more than one in so many of all chains below it is hot.
HOT = 1000


def base_id(conv: str = "conv_id") -> Column:
    """Of the family (rounded towards 0)."""
    return F.col(conv) - F.col(conv) % FAMILY


def head_turns(conv: str = "conv_id") -> Column:
    """How many turns of the base a member takes."""
    return F.crc32(F.col(conv).cast("string")) % (HEAD + 1)


def _digested(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps the two apart
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        half(1).alias("a"), half(17).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
    ).where("conv_id IS NOT NULL")


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of turns with their place in the conversation (pos, from 0), and what is known of that: base, h (turns
    asked from the base), m (turns got), size (of the rebuilt conversation); and the table that they are read from."""
    order = ["conv_id", "turn", "role", "a", "b"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    seq = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")
    whole = Window.partitionBy("conv_id")
    parts = seq.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    parts = parts.select(
        "conv_id", "part", base_id().alias("base"), head_turns().alias("h"),
        (F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("n"),
    )
    # the members of a family and their parts; h and the base's length say what is taken over
    based = F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))).over(Window.partitionBy("base")), F.lit(0))
    parts = parts.withColumn("m", F.least(F.col("h"), based))
    parts = parts.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    rows = seq.join(parts, ["conv_id", "part"])
    return rows.select("base", "conv_id", (F.col("seq") + F.col("shift")).alias("pos"), "h", "m", "size", "a", "b", "bytes"), seq


def _entries(placed: DataFrame) -> DataFrame:
    """For pieces after a conversation's first: the key of all rebuilt turns before (base, piece, conv_id, ka, kb)."""
    long = placed.where(f"size > {PIECE - HEAD}")
    kept = long.where("pos >= h OR conv_id = base").groupBy("base", "conv_id", "piece").agg(F.bit_xor("sa").alias("sa"), F.bit_xor("sb").alias("sb"))
    # what a member has from its base counts as before its first piece
    heads = placed.where(f"conv_id = base AND pos < {HEAD}").select("base", F.col("pos").alias("at"), "sa", "sb")
    members = long.where("conv_id != base AND pos = 0").select("base", "conv_id", "m")
    taken = members.join(heads, "base").where("at < m").groupBy("base", "conv_id").agg(F.lit(-1).cast("long").alias("piece"), F.bit_xor("sa").alias("sa"), F.bit_xor("sb").alias("sb"))
    before = Window.partitionBy("base", "conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.unionByName(taken)
        .select("base", "conv_id", "piece", F.bit_xor("sa").over(before).alias("ka"), F.bit_xor("sb").over(before).alias("kb"))
        .where("piece > 0")
    )


_NODES = "ka long, kb long, pa long, pb long, depth long, bytes long, members array<long>, ends array<long>, goes_on boolean"
_NODE_TYPES = pa.schema(
    [*((c, pa.int64()) for c in ("ka", "kb", "pa", "pb", "depth", "bytes")), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("goes_on", pa.bool_())]
)


def family_trie(heads: pa.Table, rows: pa.Table) -> pa.Table:
    """The trie of one piece of a family: of its members' turns (rows), the first after those that they take from
    the base (heads, in the first piece only)."""
    nodes: dict[tuple[int, int, int], list] = {}

    def visit(conv: int, size: int, depth: int, key: tuple[int, int], last: tuple[int, int], n: int) -> None:
        node = nodes.get((*key, depth))
        if node is None:
            node = nodes[(*key, depth)] = [*last, n, [], [], False]
        node[3].append(conv)
        if depth == size:
            node[4].append(conv)
        else:
            node[5] = True

    h = {c: heads["head_" + c].to_numpy() for c in ("pos", "sa", "sb", "bytes")}
    base = [(a, b, n) for _, a, b, n in sorted(zip(*(h[c].tolist() for c in ("pos", "sa", "sb", "bytes"))))]
    r = {c: rows[c].to_numpy(zero_copy_only=False) for c in ("conv_id", "pos", "sa", "sb", "bytes", "h", "m", "size", "base", "piece", "ka", "kb")}
    order = np.lexsort((r["pos"], r["conv_id"]))
    columns = zip(*(r[c][order].tolist() for c in ("conv_id", "pos", "sa", "sb", "bytes", "h", "m", "size", "base", "piece", "ka", "kb")))
    now = None
    for conv, pos, sa, sb, n, skip, taken, size, first, piece, ka, kb in columns:
        if conv != now:
            now, key = conv, (ka, kb)
            depth = pos if conv == first else taken + pos - skip
            if not piece:
                key, depth = (0, 0), 0
                visit(conv, size, 0, key, key, 0)
                if conv != first:
                    for a, b, m in base[:taken]:
                        last, key, depth = key, (key[0] ^ a, key[1] ^ b), depth + 1
                        visit(conv, size, depth, key, last, m)
        if pos >= skip or conv == first:
            last, key, depth = key, (key[0] ^ sa, key[1] ^ sb), depth + 1
            visit(conv, size, depth, key, last, n)
    flat = [(ka, kb, p, q, d, n, members, ends, on) for (ka, kb, d), (p, q, n, members, ends, on) in nodes.items()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*flat), _NODE_TYPES.types)] if flat else [pa.array([], t) for t in _NODE_TYPES.types], _NODE_TYPES)


def _family_nodes(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    numbered, seq = _numbered(_digested(turns))
    depth = F.when(F.col("conv_id") == F.col("base"), F.col("pos") + 1).when(F.col("pos") >= F.col("h"), F.col("m") + F.col("pos") - F.col("h") + 1)
    numbered = numbered.withColumn("depth", F.coalesce(depth, F.lit(0)))
    placed = materialize(
        numbered.select(
            "base", "conv_id", "pos", (F.col("pos") / PIECE).cast("long").alias("piece"), "h", "m", "size", "bytes",
            F.xxhash64("a", "b", "depth").alias("sa"), F.xxhash64("b", "depth", "a").alias("sb"),
        ),
        "placed",
    )
    rows = placed.where("piece = 0 OR pos >= h OR conv_id = base").join(_entries(placed), ["base", "conv_id", "piece"], "left")
    heads = placed.where(f"conv_id = base AND pos < {HEAD}").select(*(F.col(c).alias(f"head_{c}") for c in ("base", "piece", "pos", "sa", "sb", "bytes")))
    nodes = heads.groupBy("head_base", "head_piece").cogroup(rows.fillna(0, ["ka", "kb"]).groupBy("base", "piece")).applyInArrow(family_trie, _NODES)
    return materialize(nodes, "family_nodes"), [seq, placed]


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ka, kb, conv_id), sorted, as texts of ids joined by commas, with the first id of each."""
    key, first, ids, size = None, None, [], 0

    def made():
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([",".join(ids)])], ["ka", "kb", "first", "ids"])

    for batch in batches:
        for ka, kb, conv in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "conv_id"))):
            if key != (ka, kb) or size > TEXT:
                if ids:
                    yield made()
                key, first, ids, size = (ka, kb), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's texts, which come sorted."""
    names = ["ka", "kb", "ends_sha256"]
    key, state, out = None, None, []
    for batch in batches:
        for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
            if key == (ka, kb):
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (ka, kb), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names)
            out = []
    if key:
        yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], names)


def end_hashes(nodes: DataFrame) -> DataFrame:
    """ka, kb and the hash of the ids that end there, of nodes where any do. Ids are sorted across range partitions;
    one task reads a node's ids only as texts of TEXT characters."""
    ends = nodes.select("ka", "kb", F.explode("ends").alias("conv_id"))
    texts = ends.repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id").mapInArrow(_id_texts, "ka long, kb long, first long, ids string")
    return texts.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(_hashed, "ka long, kb long, ends_sha256 string")


def _owners(tops: DataFrame, owners: DataFrame) -> DataFrame:
    """tops joined with owners by key. Keys with more than one row in HOT, fewer than HOT of them whatever the table is, are
    sent to the tasks; only the others are shuffled."""
    hot = tops.groupBy("ka", "kb").agg(F.count("*").alias("n")).where(F.col("n") * HOT > max(tops.count(), HOT)).select("ka", "kb")
    known = materialize(owners.join(F.broadcast(hot), ["ka", "kb"]), "hot")
    cold = tops.join(F.broadcast(known.select("ka", "kb")), ["ka", "kb"], "left_anti").join(owners, ["ka", "kb"])
    return tops.join(F.broadcast(known), ["ka", "kb"]).unionByName(cold)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row per node: conv_id (least member), depth, parent_conv_id (the
    parent's; null for the root), n_convs, n_children, n_leaves (below it or itself), saved_tokens (UTF-8 bytes that
    sharing saves in its subtree), ends_sha256.

    turns has conv_id, turn, role and text, other columns don't matter; jobs run when this is called. A conversation is
    ordered by turn, null first, equal turns by role, then by a digest of role and text; repeated rows are
    turns each. Null roles and texts are empty ones, very long texts count whole. Rows without a conv_id belong to no conversation.
    An empty table has no conversations and gives no rows."""
    nodes, made = _family_nodes(turns)
    trie = nodes.groupBy("ka", "kb").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"),
        F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"), F.max("goes_on").alias("goes_on"),
    )
    trie = materialize(trie.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    leaf = (~F.col("goes_on")).cast("long")
    chains = trie.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"), F.sum(leaf).alias("leaves"))
    chains = materialize(chains, "chains")
    # what hangs below a node: the chains of members that don't own it
    below = nodes.select("ka", "kb", "depth", F.explode("members").alias("conv_id")).join(chains, "conv_id").where("depth < top")
    hanging = below.groupBy("ka", "kb").agg(
        F.sum("saved").alias("chain_saved"), F.sum("leaves").alias("chain_leaves"), F.sum((F.col("top") == F.col("depth") + 1).cast("long")).alias("chain_tops")
    )
    # the rest of the owner's chain, by pieces of depth
    trie = trie.withColumn("piece", (F.col("depth") / PIECE).cast("long"))
    piece_sums = trie.groupBy("conv_id", "piece").agg(F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    later_sums = piece_sums.select("conv_id", "piece", F.sum("saved").over(later).alias("later")).where("later IS NOT NULL")
    rest = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = trie.withColumn("rest", F.sum("saved").over(rest)).join(later_sums, ["conv_id", "piece"], "left")
    own = own.join(chains.select("conv_id", "bottom", "leaves"), "conv_id")
    # a chain's parent is owned by another conversation
    tops = trie.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).where("depth > 0")
    tops = materialize(tops.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), F.col("ka").alias("ca"), F.col("kb").alias("cb")), "tops")
    parents = _owners(tops, trie.select("ka", "kb", F.col("conv_id").alias("above"))).select(F.col("ca").alias("ka"), F.col("cb").alias("kb"), "above")
    found = own.join(hanging, ["ka", "kb"], "left").join(parents, ["ka", "kb"], "left").join(end_hashes(nodes), ["ka", "kb"], "left")
    none = F.lit(0).cast("long")
    out = found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("chain_tops", none) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        (F.coalesce("chain_leaves", none) + F.col("leaves")).alias("n_leaves"),
        (F.coalesce("chain_saved", none) + F.col("rest") + F.coalesce("later", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    discard(*made)
    return out
