"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns. Its owner is the smallest
conv_id among its members; a conversation that owns a node owns every deeper
one on its path, so each owns a suffix of its path and each node has one owner.
What lies below a node is then a sum over its members: all their tokens from
there on less those that they own, and one leaf for each owned last node that
nobody continues. One group-by over prefixes adds these up; the trie is never
walked.

Positions, prefix keys, owners and suffix sums are running aggregates within a
conversation or a prefix. Either may hold a third of all rows, so rows are cut
by sorted ranges into blocks, aggregated within blocks by windows, and carried
from block to block by the few keys that lie in more than one (`Blocks`).
Texts are read once, for their hash and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of

#: Turns of another conversation at the front of a rebuilt one: the hash of conv_id modulo this.
HEADS = 6
#: conv_ids are joined this many at a time before they are hashed in order.
CHUNK_IDS = 1 << 14


class Blocks:
    """Rows as a written table, cut by ``order`` (which begins with the keys) into blocks, with running aggregates by key over all blocks."""

    def __init__(self, work: Scratch, name: str, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        cut = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in order)).withColumn("block", F.spark_partition_id())
        self.rows = work.table(name, cut)
        key = F.struct(*keys)
        edges = self.rows.groupBy("block").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        shared = edges.select("block", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key")).groupBy("key").agg(F.count("*").alias("blocks")).where("blocks > 1")
        #: Keys in more than one block: fewer than blocks, so they go to every task.
        self.split = F.broadcast(work.table(f"{name}-split", shared.select("key.*")))

    def running(self, rows: DataFrame, **aggregates: tuple[Column, str, str]) -> DataFrame:
        """``rows`` (of this table, or with more columns) with aggregates by key over all blocks.

        An aggregate is given with the function that merges two parts of it, and
        with its rows: ``up`` to each one, from each one ``down``, or ``whole``.
        """
        local, others = {"whole": Window.partitionBy("block", *self.keys)}, {"whole": Window.partitionBy(*self.keys)}
        inner = [c for c in self.order if c not in self.keys]
        for way, sort in (("up", F.asc_nulls_first), ("down", F.desc_nulls_last)):
            local[way] = local["whole"].orderBy(*map(sort, inner)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            others[way] = others["whole"].orderBy(sort("block")).rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.join(self.split, self.keys).groupBy("block", *self.keys).agg(*(a.alias(f"_{n}") for n, (a, _, _) in aggregates.items()))
        carried = parts.select("block", *self.keys, *(F.expr(f"{merge}(_{n})").over(others[way]).alias(f"_{n}") for n, (_, merge, way) in aggregates.items()))
        merged = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
        seen = rows.select("*", *(a.over(local[way]).alias(n) for n, (a, _, way) in aggregates.items()))
        joined = seen.join(F.broadcast(carried), ["block", *self.keys], "left")  # two rows a block at most
        both = {n: [] if way == "whole" else [merged[merge](F.col(n), F.col(f"_{n}"))] for n, (_, merge, way) in aggregates.items()}
        told = {n: F.coalesce(*both[n], f"_{n}", n) for n in aggregates}
        return joined.withColumns(told).drop(*(f"_{n}" for n in aggregates))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, n``: the digest stands for the text, ``n`` is its code points."""
    text = F.coalesce("text", F.lit(""))
    rows = with_columns_of(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), F.char_length(text).cast("long").alias("n"))


def head_turns(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS


def rebuilt(numbered: DataFrame) -> DataFrame:
    """``conv_id, part, pos, k1, k2, n``: the root of each conversation (part 0), turns of another's front (1), its own (2)."""
    own = numbered.where(F.col("pos") > head_turns())
    convs = numbered.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    fronts = numbered.where(f"conv_id % 100 = 0 AND pos < {HEADS}").select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "n")
    heads = convs.join(fronts, "base").where(F.col("pos") <= head_turns())
    root = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "n")))
    return root.unionByName(heads.select("conv_id", F.lit(1).alias("part"), "pos", "k1", "k2", "n")).unionByName(own.select("conv_id", F.lit(2).alias("part"), "pos", "k1", "k2", "n"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256`` of the conv_ids of each node, in ascending order: joined in bounded runs, then hashed run by run."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        out = lambda: pa.RecordBatch.from_pylist([{"owner": now[0], "depth": now[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=RUN)
        for batch in batches:
            for owner, depth, conv_id in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
                if ids and ((owner, depth) != now or len(ids) == CHUNK_IDS):
                    yield out()
                    ids = []
                now = owner, depth
                ids.append(conv_id)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out = lambda: pa.RecordBatch.from_pylist([{"owner": now[0], "depth": now[1], "ends_sha256": state.hexdigest()}], schema=DIGEST)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["owner"], row["depth"]) != now:
                    if state:
                        yield out()
                    now, state = (row["owner"], row["depth"]), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
        if state:
            yield out()

    runs = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(join, "owner long, depth long, first long, ids string")
    return runs.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(digest, "owner long, depth long, ends_sha256 string")


RUN = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGEST = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts are empty; null turns come first; turns of equal number
    stand in the order of role and of the text's SHA-256, repeated rows next to
    each other; rows without a conv_id are left out; other columns are ignored;
    an empty table has no nodes, not even a root. Prefixes are told apart by
    128 bits of hashes of their turns.
    """
    work = Scratch(spark, "trie")
    turns = Blocks(work, "turns", turns_of(conversations), ["conv_id"], ["conv_id", "turn", "role", "digest"])
    keys = [F.xxhash64(F.lit(k), "role", "digest").alias(f"k{k}") for k in (1, 2)]
    one = F.sum(F.lit(1).cast("long"))
    numbered = work.table("numbered", turns.running(turns.rows, pos=(one, "sum", "up")).select("conv_id", "pos", *keys, "n"))

    # Depths and prefix keys: the turns' hashes, each with its depth, folded by exclusive or.
    paths = Blocks(work, "rebuilt", rebuilt(numbered), ["conv_id"], ["conv_id", "part", "pos"])
    rows = paths.running(paths.rows, depth=(one, "sum", "up"), last=(one, "sum", "whole"))
    rows = work.table("depths", rows.withColumns({c: F.col(c) - 1 for c in ("depth", "last")}))
    folded = {f"p{k}": (F.bit_xor(F.xxhash64(F.lit(k), "depth", f"k{k}")), "bit_xor", "up") for k in (1, 2)}
    rows = paths.running(rows, **folded).select("depth", "p1", "p2", "conv_id", "n", "last")

    # Owners: the smallest member of each prefix, and whether any member goes on.
    prefixes = Blocks(work, "prefixes", rows, ["depth", "p1", "p2"], ["depth", "p1", "p2", "conv_id"])
    rows = prefixes.running(prefixes.rows, owner=(F.min("conv_id"), "min", "whole"), deepest=(F.max("last"), "max", "whole"))
    owned = F.col("owner") == F.col("conv_id")
    rows = rows.select("conv_id", "depth", "last", "n", "owner", owned.alias("owned"), (owned & (F.col("last") == F.col("depth")) & (F.col("deepest") == F.col("depth"))).alias("leaf"))

    # From each node to the end of its path: tokens that are not owned, owned nodes, the leaf; from the root to it: the last node of another owner.
    marked = Blocks(work, "marked", rows, ["conv_id"], ["conv_id", "depth"])
    count = lambda c: F.sum(F.col(c).cast("long"))
    rows = marked.running(
        marked.rows,
        saved=(F.sum(F.when(F.col("owned"), 0).otherwise(F.col("n"))), "sum", "down"),
        owns=(count("owned"), "sum", "down"),
        leaves=(count("leaf"), "sum", "down"),
        above=(F.max(F.when(~F.col("owned"), F.struct("depth", "owner"))), "max", "up"),
    )
    below = F.col("last") - F.col("depth")
    child = (below > 0) & (F.col("owns") - F.col("owned").cast("long") == below)  # the next node is owned if all deeper ones are
    parent = F.when(F.col("owned") & (F.col("depth") > 0), F.when(F.col("above.depth") == F.col("depth") - 1, F.col("above.owner")).otherwise(F.col("conv_id")))
    rows = work.table("members", rows.select("conv_id", "owner", "depth", "last", "saved", "leaves", child.cast("long").alias("child"), parent.alias("parent")))

    nodes = rows.groupBy("owner", "depth").agg(F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_digest(rows.where("depth = last").select("owner", "depth", "conv_id"))
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return nodes.join(ends, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)
