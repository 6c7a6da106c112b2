"""Conversation prefix trie by the Euler-tour technique.

Every distinct sequence of first turns is a node. A turn gets a 128-bit digest salted with its place; the exclusive or of the
digests of a conversation's first d turns is the key of its depth-d node, so keys are running exclusive ors that any task can carry on,
and the parent's key is the node's without its own turn. Keys are grouped with map-side counts: a prefix that a third of all
conversations share costs a row per task.

The trie is then one list: each node has an enter and an exit arc; enter leads to the first child's enter, or else to the own exit, and exit
to the next sibling's enter, or else to the parent's exit. The list is ranked over all tasks (`listrank`); arcs in rank order get
running totals of leaves and savings (`scans`), and a subtree's total is the total at its exit less the total before its enter.
No level-by-level pass is made, so depth decides nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal, word_count, written
from .listrank import list_ranks
from .scans import scanned

PIECE = 8192
SHARE = 20
HEADS = 4


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (1, 2, ...), a, b (digest of role and text), words. Row-local but for the numbering; texts are not shuffled."""
    rows = internal(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    rows = rows.select(F.col("conv_id").cast("long"), "turn", digest.alias("d"), word_count(text).alias("words"))
    rows = rows.select("conv_id", "turn", F.xxhash64("d").alias("a"), F.xxhash64(F.lit(1), "d").alias("b"), "words")
    ranked = scanned(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "trie-turns")
    return ranked.select("conv_id", F.col("rank").alias("pos"), "a", "b", "words")


def shared_heads(rows: DataFrame, ids: DataFrame, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """Conversations rebuilt on common heads: conversation c begins with the first h turns of conversation c - c % share, h = crc32(c) %
    heads, and goes on with its own turns after its first h. Rows as in `turn_rows`."""
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % share
    first = rows.filter((F.col("conv_id") % share == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    wanted = ids.select("conv_id", base.alias("base"), h.alias("h"))
    head = wanted.join(first, "base").filter("pos <= h").select("conv_id", "pos", "a", "b", "words")
    lengths = first.groupBy("base").agg(F.max("pos").alias("n_base"))
    tail = rows.withColumn("h", h).filter("pos > h").withColumn("base", base).join(lengths, "base", "left")
    pos = F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_base", F.lit(0)))
    return head.unionByName(tail.select("conv_id", pos.cast("long").alias("pos"), "a", "b", "words"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, conv_id) rows as pieces of at most PIECE comma-joined numbers."""
    part, nth, at, held, out = TaskContext.get().partitionId(), 0, None, [], []
    for batch in batches:
        for node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (node != at or len(held) == PIECE):
                out.append((at, part, nth, ",".join(held)))
                nth, held = nth + 1, []
            at = node
            held.append(str(conv))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "part", "nth", "ids"), x, strict=True)) for x in out], schema=_PIECES)
            out = []
    if held:
        out.append((at, part, nth, ",".join(held)))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("id", "part", "nth", "ids"), x, strict=True)) for x in out], schema=_PIECES)


_PIECES = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its pieces as they stream by."""
    at, state, done = None, None, []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if node == at:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((at, state.hexdigest()))
            at, state = node, hashlib.sha256(ids.encode())
        ids, hashes = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["id", "sha"])
        done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], names=["id", "sha"])


def member_hashes(members: DataFrame) -> DataFrame:
    """(id, sha): SHA-256 of the ascending, comma-joined conv_ids of each id. Ids are sorted by range and joined into pieces where they are, so a
    node with very many members meets in one task only as a few pieces, which are hashed one by one."""
    rows = members.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").select("id", "conv_id")
    pieces = rows.mapInArrow(_joined_ids, "id long, part int, nth long, ids string")
    return pieces.repartition("id").sortWithinPartitions("id", "part", "nth").mapInArrow(_hashed, "id long, sha string")


def subtree_totals(nodes: DataFrame, amounts: list[str]) -> DataFrame:
    """(id, total_<amount>...): sums of ``amounts`` over each node's subtree, itself included. ``nodes``: id (below 2^62), parent (root: null), place
    (distinct among siblings: their order in the tour) and the amounts, all longs."""
    kids = nodes.filter("parent is not null").select("parent", "place", "id")
    kids = written(scanned(kids, "parent", ["place"], "trie-siblings").select("parent", "rank", "id"), "trie-ranked")
    after = kids.select(F.col("parent").alias("p"), (F.col("rank") - 1).alias("r"), F.col("id").alias("sibling"))
    follow = kids.join(after, (F.col("parent") == F.col("p")) & (F.col("rank") == F.col("r")), "left").select("id", "sibling")
    first = kids.filter("rank = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    linked = nodes.select("id", "parent").join(follow, "id", "left").join(first, "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    arcs = F.array(F.struct(enter.alias("id"), F.coalesce(F.col("child") * 2, leave).alias("next")),
                   F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next")))
    ranks = list_ranks(linked.select(F.inline(arcs)), "trie-tour")
    placed = ranks.select(F.shiftright("id", 1).alias("id"), F.col("id").bitwiseAND(F.lit(1)).alias("leaves"), "rank")
    at_enter = [F.when(F.col("leaves") == 0, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in amounts]
    tour = placed.join(nodes.select("id", *amounts), "id").select(
        F.lit(0).cast("long").alias("tour"), "id", "leaves", F.col("rank").alias("at"), *at_enter)
    summed = scanned(tour, "tour", ["at"], "trie-totals", sums=tuple(amounts))
    inside = [F.sum(F.when(F.col("leaves") == 1, F.col(f"run_{c}")).otherwise(F.col(c) - F.col(f"run_{c}"))).alias(f"total_{c}") for c in amounts]
    return summed.groupBy("id").agg(*inside)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuild: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. (conv_id, depth) names a node.

    Turns go by ``turn``, null first, equal ones by a digest of role and text; repeated rows are turns of their own. Null role or text is
    empty. Rows without conv_id belong to no conversation and count nowhere. The root, of depth 0, has every conversation as
    a member; an empty table has no nodes. saved_tokens: what need not be processed again when shared turns are processed once.
    Other columns are ignored. ``rebuild`` maps rows of `turn_rows` and the table of conv_ids to the rows to build the trie over."""
    rows = turn_rows(conversations, conv_id, turn, role, text)
    ids = written(internal(conversations, conv_id=conv_id).select(F.col("conv_id").cast("long")).filter("conv_id is not null").distinct(), "trie-ids")
    rows = rebuild(rows, ids) if rebuild else rows
    salted = rows.select("conv_id", "pos", "words", F.xxhash64("a", "b", "pos").alias("x"), F.xxhash64("pos", "b", "a").alias("y"))
    keyed = scanned(salted, "conv_id", ["pos"], "trie-keys", xors=("x", "y"))
    keyed = keyed.select("conv_id", F.col("pos").alias("depth"), "words", F.col("run_x").alias("kx"), F.col("run_y").alias("ky"),
                         F.col("run_x").bitwiseXOR(F.col("x")).alias("px"), F.col("run_y").bitwiseXOR(F.col("y")).alias("py"))
    key, zero = ["depth", "kx", "ky"], F.lit(0).cast("long")
    nodes = keyed.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
                                    F.min("px").alias("px"), F.min("py").alias("py"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in key], "conv_id", "n_convs", *[zero.alias(c) for c in ("words", "px", "py")])
    nodes = written(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("id").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(above, ["depth", "px", "py"], "left")
    tree = written(tree.select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "words"), "trie-tree")
    below = tree.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "id")
    tree = tree.join(below, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    amounts = tree.select("id", "parent", F.col("conv_id").alias("place"), (F.col("n_children") == 0).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(written(amounts, "trie-amounts"), ["leaf", "saved"])
    last = keyed.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("k")).select("conv_id", "k.*")
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in key])
    ends = member_hashes(ends.join(nodes.select(*key, "id"), key).select("id", "conv_id"))
    out = tree.join(totals, "id").join(ends, "id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("total_leaf").alias("n_leaves"),
                      F.col("total_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
