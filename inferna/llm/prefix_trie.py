"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns, known by its depth and a 128-bit
key: the exclusive or of a hash of every turn with its place, so that keys come
from running aggregates and no conversation has to lie in one task.  Order within
a conversation is taken from one sort by range of all turns; places and running
keys are made block by block, with the blocks' totals carried on.

Subtree totals go up the trie in reverse level order: nodes sorted by falling
depth and key, each taking the messages of its children from a priority queue
whose entries are ordered by the receiver's place in that same sort, so that only
the queue's front is ever read.  The queue spills sorted runs.  That happens first
within shards, the largest subtrees of at most ``shard_nodes`` nodes (by the
turns below a node, which bound its nodes), then over the nodes above the shards'
roots with one message for each of them that has shards below.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.common import bounded_broadcast, narrowed, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Turns whose running key one task works out before the carry of earlier blocks is added.
BLOCK = 4096


class SpillingQueue:
    """Least entry first; beyond ``limit`` entries in memory the held ones go, sorted, to an unnamed scratch file of the task."""

    def __init__(self, limit: int):
        self.limit, self.held, self.runs, self.spilled = limit, [], [], 0

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.held, entry)
        if len(self.held) > self.limit:
            run, self.held = sorted(self.held), []
            file = tempfile.TemporaryFile()
            for i in range(0, len(run), 4096):
                pickle.dump(run[i:i + 4096], file)
            file.seek(0)
            entries = self._read(file)
            heapq.heappush(self.runs, (next(entries), self.spilled, entries))
            self.spilled += 1

    @staticmethod
    def _read(file):
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def front(self) -> tuple | None:
        if self.runs and (not self.held or self.runs[0][0] < self.held[0]):
            return self.runs[0][0]
        return self.held[0] if self.held else None

    def pop(self) -> tuple:
        if self.runs and (not self.held or self.runs[0][0] < self.held[0]):
            first, number, entries = heapq.heappop(self.runs)
            following = next(entries, None)
            if following is not None:
                heapq.heappush(self.runs, (following, number, entries))
            return first
        return heapq.heappop(self.held)


def pass_upwards(shard: list[str], limit: int):
    """A function for mapInArrow over nodes in the order of shard, falling depth, key: adds n_children, n_leaves, saved of the subtree.

    ``children``, ``leaves`` and ``saved`` of a row are what it has of its own
    or from shards below it.
    """
    names = [*shard, "depth", "k1", "k2", "p1", "p2", "children", "leaves", "saved"]

    def run(batches):
        at, queue = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                own, (depth, k1, k2, p1, p2, children, leaves, saved) = row[:len(shard)], row[len(shard):]
                if own != at or queue is None:
                    at, queue = own, SpillingQueue(limit)
                place = (-depth, k1, k2)
                while (first := queue.front()) is not None and first[:3] <= place:
                    _, _, _, more, gain = queue.pop()
                    children, leaves, saved = children + 1, leaves + more, saved + gain
                leaves = leaves or 1
                if depth:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                for o, v in zip(out, (depth, k1, k2, children, leaves, saved)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["depth", "k1", "k2", "n_children", "n_leaves", "saved_tokens"])
    return run


PASSED = "depth long, k1 long, k2 long, n_children long, n_leaves long, saved_tokens long"


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, role, text), (conv, len)): every turn with its place from 0 in the order of turn, role, text; nulls of turn first.

    One sort by range numbers all turns; a conversation that reaches over several
    ranges carries the counts of the earlier ones.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    spread = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(spread.select("conv", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "trie-turns")
    spans = numbered.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stage(spans.withColumn("before", before), "trie-spans")
    rows = numbered.join(spans.select("conv", "part", "first", "before"), ["conv", "part"]) \
        .select("conv", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "role", "text")
    return rows, stage(spans.groupBy("conv").agg(F.sum("n").alias("len")), "trie-convs")


def regrafted(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``head`` turns taken from the conversation ``base`` (columns of ``conv``).

    Returns ((conv, pos, role, text), (conv, len)); a conversation may have no turn left.
    """
    rows, convs = placed(turns)
    convs = convs.select("conv", "len", base.alias("base"), head.cast("long").alias("head"))
    convs = stage(convs.join(convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len")), "base", "left")
                  .select("conv", "base", "head", "len", F.least("head", F.coalesce("base_len", F.lit(0))).alias("lent")), "trie-heads")
    own = rows.join(convs.select("conv", "head", "lent"), "conv").where("pos >= head") \
        .select("conv", (F.col("pos") - F.col("head") + F.col("lent")).alias("pos"), "role", "text")
    first = stage(rows.join(convs.groupBy(F.col("base").alias("conv")).agg(F.max("lent").alias("most")), "conv").where("pos < most")
                  .select(F.col("conv").alias("base"), "pos", "role", "text"), "trie-lent")
    lent = first.join(convs.select("conv", "base", "lent"), "base").where("pos < lent").select("conv", "pos", "role", "text")
    length = F.col("lent") + F.greatest(F.col("len") - F.col("head"), F.lit(0))
    return own.unionByName(lent), convs.select("conv", length.alias("len"))


def trie(turns: DataFrame, lengths: DataFrame, shard_nodes: int = 100_000, queue: int = 1 << 16) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, role, text; pos from 0 without gaps) for the conversations ``lengths`` (conv, len).

    Columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 as the contract of the query has them, and the
    node's key.  No conversations, no nodes.
    """
    place = [F.col("pos"), F.col("role"), F.col("text")]
    terms = stage(turns.select("conv", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), F.xxhash64(*place).alias("t1"), F.xxhash64(F.lit(7), *reversed(place)).alias("t2"),
                               F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-terms")
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = terms.groupBy("conv", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2")) \
        .select("conv", "block", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(c) for b, c in (("b1", "c1"), ("b2", "c2"))])
    paths = terms.withColumns({f"k{i}": F.bit_xor(f"t{i}").over(within) for i in (1, 2)}).join(carry, ["conv", "block"]).join(lengths, "conv") \
        .select("conv", (F.col("pos") + 1).alias("depth"), *[F.col(f"k{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2)],
                *[F.col(f"k{i}").bitwiseXOR(F.col(f"c{i}")).bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)], "words", "len")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv", zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words")], "len")
    paths = stage(paths.unionByName(roots), "trie-paths")
    own = (F.col("n_convs") - 1) * F.col("words")
    nodes = stage(paths.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("p1", "p2", "words")],
                                                         F.sum(F.col("len") - F.col("depth")).alias("below"))
                  .select("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", own.alias("saved"), (F.col("below") >= shard_nodes).alias("top")), "trie-nodes")
    key = ["depth", "k1", "k2"]
    top = stage(nodes.where("top").select(*key, "p1", "p2", "saved"), "trie-top")
    n_top = top.count()

    # a conversation's shard is the subtree of the first node of its path that is not above the shards
    begun = stage(paths.select("conv", *key).join(bounded_broadcast(top.select(key), n_top, 24), key).groupBy("conv").agg(F.count("*").alias("f")), "trie-begun")
    begun = lengths.select("conv").join(begun, "conv", "left").select("conv", F.coalesce("f", F.lit(0)).alias("f"))
    shards = stage(paths.join(begun, "conv").where("depth = f").select("conv", F.col("depth").alias("s0"), F.col("k1").alias("s1"), F.col("k2").alias("s2")), "trie-shards")
    low = nodes.where("not top").join(shards.withColumnRenamed("conv", "conv_id"), "conv_id")
    blank = {"children": zero, "leaves": zero}
    shard = ["s0", "s1", "s2"]
    low = low.withColumns(blank).select(*shard, *key, "p1", "p2", "children", "leaves", "saved") \
        .repartition(*shard).sortWithinPartitions(*shard, F.desc("depth"), "k1", "k2")
    below = stage(low.mapInArrow(pass_upwards(shard, queue), PASSED), "trie-below")

    # one message for each node above with shards below it, then the same pass over the nodes above
    heads = nodes.join(shards.select(F.col("s0").alias("depth"), F.col("s1").alias("k1"), F.col("s2").alias("k2")).distinct(), key) \
        .where("depth > 0").select(*key, "p1", "p2")
    sent = below.join(heads, key).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")) \
        .agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("gain"))
    above = top.join(sent, key, "left").select(*key, "p1", "p2", *[F.coalesce(c, zero).alias(c) for c in ("children", "leaves")], (F.col("saved") + F.coalesce("gain", zero)).alias("saved"))
    above = stage(above.coalesce(1).sortWithinPartitions(F.desc("depth"), "k1", "k2").mapInArrow(pass_upwards([], queue), PASSED), "trie-above")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    totals = below.unionByName(above)
    return (nodes.join(totals, key).join(parents, ["depth", "p1", "p2"], "left").join(ends(paths), key, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "k1", "k2"))


def ends(paths: DataFrame, chunk: int = 8192) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end.

    The sorted ids are joined to texts range by range; the digest, which has to
    take its bytes in order, then runs over a few texts a node as a stream.
    """
    order = ["depth", "k1", "k2", "conv"]
    last = paths.where("depth = len").select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = last.schema["conv"].dataType.simpleString()

    def join(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            node = None
            for d, x, y, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (d, x, y) != node or len(out[4][-1]) >= chunk:
                    node = d, x, y
                    for o, v in zip(out, (d, x, y, c, [])):
                        o.append(v)
                out[4][-1].append(str(c))
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], b.column(3).type), pa.array([",".join(o) for o in out[4]])],
                                             names=[*order, "ids"])

    texts = stage(last.mapInArrow(join, f"depth long, k1 long, k2 long, conv {kind}, ids string"), "trie-ends")

    def digest(batches):
        node = held = None
        for b in batches:
            done = []
            for d, x, y, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))):
                if (d, x, y) == node:
                    held.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, held.hexdigest()))
                node, held = (d, x, y), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(FINISHED.names, r)) for r in done], schema=FINISHED)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(FINISHED.names, (*node, held.hexdigest())))], schema=FINISHED)

    return texts.repartition("depth", "k1", "k2").sortWithinPartitions(*order).mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


FINISHED = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def rebuilt_trie(conversations: DataFrame, group: int = 20, heads: int = 4, shard_nodes: int = 100_000, queue: int = 1 << 16) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) after conversation c took its first crc32(c) % ``heads`` turns from conversation c - c % ``group``.

    Null turns come first; turns that tie are ordered by role, then text; null
    role or text is the empty string; repeated rows are turns of their own; rows
    with a null conv_id belong to no conversation.  Texts may be of any length: only
    their hashes and word counts leave the first stage.  Extra columns play no part.
    """
    t = narrowed(conversations, ["conv_id", "turn", "role", "text"]).where("conv_id is not null") \
        .select(F.col("conv_id").alias("conv"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    turns, lengths = regrafted(t, F.col("conv") - F.col("conv") % group, head)
    return trie(turns, stage(lengths, "trie-lengths"), shard_nodes, queue)
