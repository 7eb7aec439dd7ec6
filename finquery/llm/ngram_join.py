"""N-gram Jaccard join: count-vector R-trees over the sets that share a signature.

A document's set is its distinct word shingles. Hashing shingles into
``GROUPS`` groups makes each set a point of group counts; the summed minima of
two points bound the sets' overlap from above, and the summed minima of a point
and a box bound the overlap with every set in the box. R-tree nodes are boxes
packed by size; a search goes down only where the bound reaches the overlap
that the threshold asks for, and survivors are verified on the sets themselves.

Most sets link with none, which is found first, without loss: a set that links
shares at least the threshold's part of its shingles with another, so a set
goes on only if that many of its shingles occur in a different set at all. That
is told by sorted runs of shingle hashes (their leading bits), merged by ranges
of hashes, from which one bit for each shingle comes back. Of equal texts, which
a hash of the whole text tells, one alone is read so.

Which sets stand in one tree is found next, again without loss. Two sets that link
differ in at most k shingles, k following from their sizes; if both are split
by hash into k + e parts, e parts at least are equal in both. A set sends one
signature for each part (for its size band, and near a band's end for the
next), but for fewer than e parts of few shingles. Sets with a signature in
common are joined, and the connected blocks of these joins hold every linked
pair. Signatures travel in sorted runs of many documents, coded by differences,
each class of equal sets once a run.

A block is an R-tree: leaves of bounded size, numbered by set size, inner nodes
of ``FAN`` children above them. Each leaf is searched on its own; then
neighbouring leaves; then every set that is not in its block's largest
component yet goes down the tree, from the root to the leaves whose boxes allow
a link, and is compared there. Sets that a chain of verified links already
joins are not compared again, so a group of near copies costs a few comparisons
for each member, not for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.fingerprint_index import BUCKET_WINDOWS, NULL_ID, cells_of, packed, rows_of, texts_of, unpacked, written_chunks
from finquery.llm.scratch import Scratch
from finquery.llm.words import U64, Words, mixed, release

GROUPS, NODE, FAN = 32, 16, 32
LEAF_SHINGLES, LEAF_SETS = 400_000, 512
BAND, THIN = 1.3, 3
#: Whether shingles are shared is asked of their leading bits: two that agree in them by chance let a set go on that cannot link, and lose none.
TRAILING = np.uint64(24)
LEADING = np.uint64((1 << 64) - (1 << 24))
#: Signatures of one run, and in one bucket of the join, about.
RUN, BUCKET = 1 << 20, 1 << 20
ODD = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, in lower case; a text of fewer words is one shingle."""
    found = Words(pc.ascii_lower(texts))
    words, ends = found.hashes(3), found.ends
    out = []
    long = len(words) - width + 1
    rolled = words[: max(long, 0)].copy()
    for k in range(1, width):
        rolled = rolled * U64(ODD) + words[k : k + max(long, 0)]
    rolled = mixed(rolled)
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = U64(b - a)
            for w in words[a:b]:
                h = mixed(np.array([h], U64) * U64(ODD) + w)[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.empty(0, U64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest, as two signed numbers."""
    a, b = (int(mixed(s ^ U64(k)).sum(dtype=U64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return (a + len(s)) % 2**64 - 2**63, b - 2**63


def bands_of(n: int, percent: int) -> list[int]:
    """The size bands for which a set of ``n`` sends signatures: its own, and those after it in which a partner can be."""
    own = int(math.log(n, BAND) + 1e-9) if n > 1 else 0
    out = [own]
    while n * 100 // percent >= BAND ** (out[-1] + 1) - 1e-6:
        out.append(out[-1] + 1)
    return out


def parts_in(band: int, percent: int) -> tuple[int, int]:
    """How many parts, and how many of them at least are equal in two linked sets of which the larger is in the band."""
    top = math.ceil(BAND ** (band + 1)) + 1
    differ = math.floor(2 * top * (100 - percent) / (100 + percent))
    return differ + 3 + differ // 5, 3 + differ // 5


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Parts of few shingles say little; they are left out where enough others must be equal without them."""
    out = []
    for band in bands_of(len(s), percent):
        parts, equal = parts_in(band, percent)
        which = ((mixed(s ^ U64(0xD6E8FEB86659FD93)) >> U64(32)) % U64(parts)).astype(np.int64)
        sums = np.zeros(parts, dtype=U64)
        np.add.at(sums, which, mixed(s + U64(ODD)))
        sums = mixed(sums + mixed(np.arange(parts, dtype=U64) * U64(ODD) + U64(band << 40)))
        sizes = np.bincount(which, minlength=parts)
        for thin in (THIN, 1, 0):  # fewer thin parts than equal ones: one equal part at least is not thin
            if (sizes < thin).sum() < equal:
                out.append(sums[sizes >= thin])
                break
    return np.concatenate(out)


def text_marks(texts: pa.Array) -> np.ndarray:
    """A 128-bit hash of each text in lower case, as two signed numbers a row."""
    raw = [xxhash.xxh3_128_digest(t) for t in pc.ascii_lower(texts).cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)


def first_copies(work: Scratch, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, x, y``: each document with its text's hash; and ``chunk, places``: where in the chunks the first document of each text stands."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc_ids, texts = texts_of(row)
            marks, n = text_marks(texts), len(doc_ids)
            yield from pa.Table.from_arrays([pa.array(np.full(n, row["chunk"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(doc_ids, mask=doc_ids == NULL_ID), *(pa.array(np.ascontiguousarray(m)) for m in marks.T)], ["chunk", "place", "doc_id", "x", "y"]).to_batches(max_chunksize=10_000)
            release()

    marks = work.table("marks", chunks.select("chunk", "doc_ids", "sizes", "texts").mapInArrow(marked, "chunk long, place int, doc_id long, x long, y long"))
    first = marks.groupBy("x", "y").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "place")).alias("first"))
    places = work.table("places", first.groupBy("first.chunk").agg(F.collect_list("first.place").alias("places")))
    return marks.select("doc_id", "x", "y"), places


def shared_sets(work: Scratch, documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, a, b``: set size and digest of each row of ``documents``; and ``doc_id, n, a, b, s``: the shingles of sets that can link.

    Of equal texts the smallest document alone is read as shingles, and of equal
    sets in a chunk the smallest has ``s``; whether a set can link is the same
    for all that equal it. A document without an id has no ``s``.
    """
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = written_chunks(work, documents, parts)
    buckets = max(4 * parts, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WINDOWS))
    marks, places = first_copies(work, chunks)
    chunks = chunks.join(places, "chunk")

    class Sets:
        """The sets of a chunk's first copies; ``firsts``: one document for each class; ``keys``: their shingles' leading bits, ``several``: which are in more than one."""

        def __init__(self, row: dict):
            doc_ids, texts = texts_of(row)
            at = np.sort(np.array(row["places"], np.int64))
            self.doc_ids, texts = doc_ids[at], texts.take(pa.array(at))
            self.texts, self.sets = texts, shingle_sets(texts, width)
            self.marks = [digest(s) for s in self.sets]
            seen: dict[tuple[int, int], int] = {}
            for k, (i, mark) in enumerate(zip(self.doc_ids.tolist(), self.marks, strict=True)):  # by doc_id
                if i != NULL_ID and len(self.sets[k]):
                    seen.setdefault(mark, k)
            self.firsts = list(seen.values())
            flat = np.sort(np.concatenate([np.empty(0, U64), *(self.sets[k] for k in self.firsts)]) & LEADING)
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
            self.keys, self.several = flat[first], np.diff(first, append=len(flat)) > 1

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = Sets(row).keys
            out = [(bucket, row["chunk"], at.stop - at.start, packed(np.diff(keys[at] >> TRAILING, prepend=keys[at.start] >> TRAILING)), int(keys[at.start] >> TRAILING)) for bucket, at in cells_of(keys, buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], ["bucket", "chunk", "n", "run", "low"])
            release()

    def merge(cells: pd.DataFrame) -> pd.DataFrame:
        """For each run of a bucket a bit for each shingle: another run has it."""
        keys = np.concatenate([np.cumsum(unpacked(raw, 0, n)[0], dtype=U64) + U64(low) for n, low, raw in zip(cells["n"], cells["low"], cells["run"], strict=True)])
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        flags = np.zeros(len(keys), dtype=bool)
        flags[order[1:][same]] = flags[order[:-1][same]] = True
        ends = np.concatenate([[0], np.cumsum(cells["n"].to_numpy())])
        return pd.DataFrame({"bucket": cells["bucket"], "chunk": cells["chunk"], "n": cells["n"], "run": [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            here, bits = Sets(row), sorted(row["bits"] or [], key=lambda x: x["bucket"])
            shared = here.several.copy()
            if bits:
                shared |= np.concatenate([np.unpackbits(np.frombuffer(x["run"], np.uint8), count=x["n"]).astype(bool) for x in bits])
            kept: list[bytes | None] = [None] * len(here.sets)
            for k in here.firsts:
                if 100 * int(shared[np.searchsorted(here.keys, here.sets[k] & LEADING)].sum()) >= percent * len(here.sets[k]):
                    kept[k] = here.sets[k].tobytes()
            ids, n, a, b = [None if i == NULL_ID else i for i in here.doc_ids.tolist()], [len(s) for s in here.sets], [m[0] for m in here.marks], [m[1] for m in here.marks]
            yield from pa.Table.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, n, a, b)), pa.array(kept, pa.binary()), *(pa.array(np.ascontiguousarray(m)) for m in text_marks(here.texts).T)], ["doc_id", "n", "a", "b", "s", "x", "y"]).to_batches(max_chunksize=1000)
            release()

    cell = "bucket long, chunk long, n long, run binary"
    # A bit for each shingle of a chunk; written, so that the runs are gone before the shingles are written.
    bits = work.table("bits", chunks.mapInArrow(sort, f"{cell}, low long").groupBy("bucket").applyInPandas(merge, cell).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "run")).alias("bits")))
    firsts = work.table("firsts", chunks.join(bits, "chunk", "left").select("doc_ids", "sizes", "texts", "places", "bits").mapInArrow(told, "doc_id long, n long, a long, b long, s binary, x long, y long"))
    for name in ("chunks", "places", "bits"):
        work.remove(name)
    docs = work.table("docs", marks.join(firsts.select("x", "y", "n", "a", "b").hint("merge"), ["x", "y"]).select("doc_id", "n", "a", "b"))
    return docs, firsts.where("s is not null").select("doc_id", "n", "a", "b", "s")


def joined_by(sig: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest that signatures join it with; ``at``: the node of each signature."""
    order = np.lexsort((at, sig))
    sig, at = sig[order], at[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    head = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    known = Forest(n)
    pairs = np.stack([head, at], axis=1)[head != at]
    for x, y in np.unique(pairs, axis=0).tolist():
        known.join(x, y)
    return np.array([known.root(x) for x in range(n)], dtype=np.int64)


def signature_links(docs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``u, v``: links among the documents of distinct sets (``doc_id, s``) whose components hold every linked pair.

    Documents of one run that signatures join are joined there at once, and the
    run then carries each signature once for all of them, so that a large group
    costs about one link a document and few signatures a run.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of signatures with the smallest document of those that they join, cut at the bucket bounds; and the links within a run, in buckets below zero."""
        ids: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            order = np.argsort(np.array(ids), kind="stable")
            names = np.array(ids, "<i8")[order]
            sig, at = np.concatenate([parts[k] for k in order]), np.repeat(np.arange(len(names)), [len(parts[k]) for k in order])
            roots = joined_by(sig, at, len(names))
            inner = np.flatnonzero(roots != np.arange(len(names)))
            by = np.lexsort((roots[at], sig))
            sig, doc = sig[by], names[roots[at]][by]
            first = np.ones(len(sig), dtype=bool)
            first[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
            sig, doc = sig[first], doc[first]
            bucket = ((sig >> U64(32)) * U64(buckets)) >> U64(32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(sig)]])
            rows = [(-1 - int(names[0]) % buckets, len(inner), 0, names[inner].tobytes() + names[roots[inner]].tobytes())] if len(inner) else []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                low = int(doc[a:b].min())
                rows.append((int(bucket[a]), b - a, low, packed(np.diff(sig[a:b], prepend=U64(0))) + packed((doc[a:b] - low).astype(U64))))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))], ["bucket", "n", "low", "run"])

        for batch in batches:
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                ids.append(i)
                parts.append(signatures(np.frombuffer(raw, U64), percent))
                size += len(parts[-1])
            if size >= RUN:
                yield out()
                ids, parts, size = [], [], 0
        if ids:
            yield out()

    def link(cells: pd.DataFrame) -> pd.DataFrame:
        if cells["bucket"].iloc[0] < 0:
            pairs = [np.frombuffer(raw, "<i8").reshape(2, -1) for raw in cells["run"]]
            return pd.DataFrame(dict(zip(("u", "v"), np.concatenate(pairs, axis=1), strict=True)))
        sig, doc = [], []
        for n, low, raw in zip(cells["n"], cells["low"], cells["run"], strict=True):
            keys, at = unpacked(raw, 0, n)
            sig.append(np.cumsum(keys, dtype=U64))
            doc.append(unpacked(raw, at, n)[0].astype(np.int64) + low)
        sig, doc = np.concatenate(sig), np.concatenate(doc)
        nodes, at = np.unique(doc, return_inverse=True)
        roots = joined_by(sig, at, len(nodes))
        inner = roots != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[inner], "v": nodes[roots[inner]]}).astype("int64")

    return docs.select("doc_id", "s").mapInArrow(deal, "bucket long, n long, low long, run binary").groupBy("bucket").applyInPandas(link, "u long, v long").distinct()


def components(work: Scratch, name: str, links: DataFrame) -> DataFrame:
    """``node, comp``: for each node of ``links`` (``u, v``) its component's smallest node.

    Alternates large-star and small-star steps until nothing changes. A step
    makes no more rows than it reads; its result is a table in the shared
    folder, so the number of stages stays small. Minima are summed up before
    they are shuffled and joined to the links, which Spark splits where many
    links share a node.
    """
    edges = work.table(f"{name}-0", links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    for k in range(1, 60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A link from v to the smaller u becomes one from v to u's least neighbour.
        large = work.table(f"{name}-large-{k}", edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")))
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = work.table(f"{name}-{k}", small.distinct())
        work.remove(f"{name}-large-{k}")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.remove(f"{name}-{k - 1}")
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    edges = edges.distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def counts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount((mixed(s ^ U64(0xA0761D6478BD642F)) >> U64(59)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tree_links(sets: list[np.ndarray], groups: np.ndarray, percent: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` that join what no found link joins yet. ``groups``: components known before; ``across``: only pairs from two sides."""
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])), dtype=np.int64)
    size = np.array([len(sets[k]) for k in order])
    points = np.stack([counts_of(sets[k]) for k in order])
    # Nodes: consecutive sets by size, within them by leading counts; each node a box with its largest counts and its sizes.
    for a in range(0, len(order), NODE * NODE):
        part = slice(a, a + NODE * NODE)
        inner = np.lexsort((points[part, 1], points[part, 0]))
        order[part], size[part], points[part] = order[part][inner], size[part][inner], points[part][inner]
    first = np.arange(0, len(order), NODE)
    high, least, most = np.maximum.reduceat(points, first), np.minimum.reduceat(size, first), np.maximum.reduceat(size, first)
    known, out = Forest(len(sets)), []
    heads: dict[int, int] = {}
    for k, g in enumerate(groups[order].tolist()):
        known.join(heads.setdefault(g, k), k)
    side = across[order] if across is not None else None
    for k in range(len(order)):
        n, p = size[k], points[k]
        # Overlap that a set of m >= low shingles needs: percent / (100 + percent) of both sizes.
        low = -(-percent * n // 100)
        boxes = np.flatnonzero((most >= low) & (percent * least <= 100 * n) & ((100 + percent) * np.minimum(high, p).sum(axis=1) >= percent * (n + np.maximum(least, low))))
        near = (boxes[:, None] * NODE + np.arange(NODE)).ravel()
        near = near[near < k]
        near = near[(size[near] >= low) & (percent * size[near] <= 100 * n)]
        if side is not None:
            near = near[side[near] != side[k]]
        near = near[(100 + percent) * np.minimum(points[near], p).sum(axis=1) >= percent * (n + size[near])]
        for m in near.tolist():
            if known.root(m) != known.root(k) and linked(sets[order[k]], sets[order[m]], percent):
                known.join(m, k)
                out.append((int(order[k]), int(order[m])))
    return out


def by_key(keys: tuple[str, ...], work: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Groups of rows with equal ``keys`` in partitions sorted by them, handed over one at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            found = work(pd.concat(held, ignore_index=True))
            return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

        for part in parts:
            if not len(part):
                continue
            cut = np.flatnonzero(np.any([part[k].to_numpy()[1:] != part[k].to_numpy()[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, len(part)], strict=True):
                piece = part.iloc[a:b]
                if held and any(held[-1][k].iloc[0] != piece[k].iloc[0] for k in keys):
                    yield flush()
                    held = []
                held.append(piece)
        if held:
            yield flush()

    return run


def descended(work: Scratch, state: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """``x_rep, block, leaf``: the leaves, but its own and the next, that each set of ``opened`` reaches from its block's root.

    Boxes are the largest group counts and the range of sizes below a node. A
    set goes from a node to a child where sizes allow a link and the summed
    minima of its point and the child's box reach the overlap that a link asks for.
    """
    size = (F.length("s") / 8).cast("long")
    boxes = [work.table("boxes-0", state.groupBy("block", F.col("leaf").alias("node")).agg(F.min(size).alias("least"), F.max(size).alias("most"), F.array(*(F.max(F.col("p")[k]) for k in range(GROUPS))).alias("high")))]
    while not boxes[-1].where("node > 0").isEmpty():
        boxes.append(work.table(f"boxes-{len(boxes)}", boxes[-1].groupBy("block", F.floor(F.col("node") / FAN).alias("node")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.array(*(F.max(F.col("high")[k]) for k in range(GROUPS))).alias("high"))))
    here = opened.select(F.col("rep").alias("x_rep"), F.col("leaf").alias("own"), "block", "p", size.alias("n"), F.lit(0).cast("long").alias("parent"))
    for k, level in enumerate(reversed(boxes)):
        low = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100))
        overlap = F.expr("aggregate(zip_with(p, high, (a, b) -> least(a, b)), 0, (a, x) -> a + x)")
        fits = (F.col("most") * 100 >= percent * F.col("n")) & (percent * F.col("least") <= 100 * F.col("n")) & ((100 + percent) * overlap >= percent * (F.col("n") + low))
        children = level.withColumn("parent", F.floor(F.col("node") / FAN))
        here = work.table(f"down-{k}", here.join(children, ["block", "parent"]).where(fits).select("x_rep", "own", "block", "p", "n", F.col("node").alias("parent")))
    return here.where("abs(parent - own) > 1").select("x_rep", "block", F.col("parent").alias("leaf"))


def jaccard_components(spark: SparkSession, documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``documents``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    shingle sets; a component's id is the smallest doc_id that links reach.
    Texts are lower-cased (A-Z). Null, empty and word-free texts have an empty
    set and link with nothing. Repeated rows link like any equal texts, and
    rows with one doc_id are one document. A row without a doc_id has its set's
    size and no component. An empty table gives no rows.
    """
    work = Scratch(spark, "jaccard")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, with_sets = shared_sets(work, documents, width, percent)
    # Equal sets are one class, named by its smallest doc_id.
    sets_here = docs.where("n > 0 and doc_id is not null")
    classes = work.table("classes", sets_here.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    # A set of n shingles has about n signatures at most.
    # Sets that can link, each once. Merged at every size: what is broadcast must not follow the corpus.
    able = with_sets.join(classes.select(F.col("rep").alias("doc_id"), "a", "b").hint("merge"), ["doc_id", "a", "b"], "left_semi").dropDuplicates(["doc_id"])
    able = work.table("able", able.select("doc_id", "a", "b", "n", "s"))
    work.remove("firsts")
    buckets = max(parts, -(-(able.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    blocks = components(work, "blocks", signature_links(able, percent, buckets))
    in_block = work.table("in_block", classes.join(blocks, F.col("rep") == F.col("node")).select("a", "b", "rep", "n", F.col("comp").alias("block")))

    # Leaves: a block's sets by size, so many to a leaf; where sets of one size fill several leaves, a hash deals them.
    sized = in_block.groupBy("block", "n").agg(F.count("*").alias("sets")).withColumn("fill", F.greatest(F.col("sets") * F.col("n") / LEAF_SHINGLES, F.col("sets") / LEAF_SETS))
    # One row a size, so that no block is large here.
    sized = work.table("sized", sized.withColumn("before", F.sum("fill").over(Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("fill")).select(F.col("block").alias("b_block"), F.col("n").alias("b_n"), "before", "fill"))
    chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / F.lit(1 << 20)
    leaves = work.table("leaves", in_block.join(sized, (F.col("block") == F.col("b_block")) & (F.col("n") == F.col("b_n"))).withColumn("leaf", F.floor(F.col("before") + chance * F.col("fill") + F.lit(1e-9)).cast("long")).select(*in_block.columns, "leaf"))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("p", pa.array([counts_of(np.frombuffer(s, U64)).tolist() for s in batch.column("s").to_pylist()], pa.list_(pa.int32())))

    whole = able.select(F.col("doc_id").alias("rep"), "a", "b", "s").join(leaves.select("rep", "a", "b", "block", "leaf").hint("merge"), ["rep", "a", "b"]).select("rep", "block", "leaf", "s")
    sets = work.table("sets", whole.mapInArrow(pointed, "rep long, block long, leaf long, s binary, p array<int>"))
    work.remove("able")

    def search(part: pd.DataFrame) -> list[tuple[int, int]]:
        """Links inside one leaf, or between two (``pair``)."""
        part = part.drop_duplicates(["rep", "side"] if "side" in part else "rep", ignore_index=True)
        loaded = [np.frombuffer(x, U64) for x in part["s"]]
        names = part["rep"].to_numpy()
        groups = part["comp"].to_numpy() if "comp" in part else np.arange(len(part))
        found = tree_links(loaded, groups, percent, part["side"].to_numpy() if "side" in part else None)
        known = Forest(len(part))
        by_name = np.argsort(names, kind="stable")
        place = np.argsort(by_name)
        for a, b in found:
            known.join(int(place[a]), int(place[b]))
        ranked = names[by_name]
        return [(int(ranked[k]), int(ranked[known.root(k)])) for k in sorted({int(place[x]) for pair in found for x in pair})]

    inside = sets.drop("p").repartition(parts, "block", "leaf").sortWithinPartitions("block", "leaf").mapInPandas(by_key(("block", "leaf"), search), "u long, v long")
    links = work.table("links-inside", inside)

    # A block of one leaf is done: its links are stars around components' smallest documents. The rest goes on by leaves.
    sizes = work.table("large", leaves.groupBy("block").agg(F.max("leaf").alias("last")).where("last > 0"))
    reached = links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    if not sizes.isEmpty():
        large = work.table("large-sets", sets.join(sizes, "block", "left_semi").dropDuplicates(["rep"]))
        work.remove("sets")
        within = large.select(F.col("rep").alias("u"))
        settled, links = links.join(within, "u", "left_anti"), links.join(within, "u", "left_semi")

        def compared(name: str, pairs: DataFrame, left: DataFrame, links: DataFrame) -> DataFrame:
            """``links`` and those between the sets of ``left`` (side 0) and of the leaves that ``pairs`` (``x_rep, block, leaf``) sends them to."""
            most = work.table(f"{name}-most", pairs.groupBy("block", "leaf").agg(F.ceil(F.count("*") / LEAF_SETS).alias("shares")))
            comes = pairs.join(left.select(F.col("rep").alias("x_rep"), "s", "comp"), "x_rep").join(most, ["block", "leaf"]).select("block", "leaf", F.pmod(F.xxhash64("x_rep"), F.col("shares")).alias("share"), F.col("x_rep").alias("rep"), "s", "comp", F.lit(0).alias("side"))
            stays = state.join(most, ["block", "leaf"]).select("block", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "rep", "s", "comp", F.lit(1).alias("side"))
            keys = ("block", "leaf", "share")
            found = comes.unionByName(stays).repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(by_key(keys, search), "u long, v long")
            return work.table(f"{name}-links", links.unionByName(found))

        def so_far(name: str, links: DataFrame) -> tuple[DataFrame, DataFrame]:
            """The sets of large blocks with their components; and those outside of their block's largest component."""
            comp = components(work, name, links)
            state = work.table(f"{name}-state", large.join(comp, F.col("rep") == F.col("node"), "left").select("rep", "block", "leaf", "s", "p", F.coalesce("comp", "rep").alias("comp")))
            main = state.groupBy("block", "comp").agg(F.count("*").alias("sets")).groupBy("block").agg(F.max_by("comp", F.struct("sets", "comp")).alias("main"))
            return state, work.table(f"{name}-open", state.join(work.table(f"{name}-main", main), "block").where("comp <> main").drop("main"))

        # Neighbouring leaves: every set to the next leaf.
        state, opened = so_far("leaves-done", links)
        if not opened.isEmpty():
            last = opened.select("block").distinct()
            beside = state.join(last, "block", "left_semi").join(sizes, "block").where("leaf < last").select(F.col("rep").alias("x_rep"), "block", (F.col("leaf") + 1).alias("leaf"))
            links = compared("beside", beside, state, links)
            for name in ("leaves-done-state", "leaves-done-open"):
                work.remove(name)
            state, opened = so_far("beside-done", links)
        if not opened.isEmpty():
            pairs = descended(work, state, opened, percent)
            links = compared("tree", pairs, opened, links)
        reached = settled.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(components(work, "reached", links))

    of_class = classes.join(reached, F.col("rep") == F.col("node"), "left").select("a", "b", F.coalesce("comp", "rep").alias("component_id"))
    found = sets_here.join(of_class, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(docs.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
