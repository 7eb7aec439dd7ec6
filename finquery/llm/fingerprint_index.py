"""Substring dedup with a log-structured index of window fingerprints.

A window is ``width`` consecutive words of one document. Its fingerprint is a
64-bit key and a 24-bit check from independent hash families; a match of keys
counts only if the checks agree too (two different windows agree in all 88 bits
about once in 3e26 pairs).

Documents are packed into chunks of bounded size, written once and bucketed by
chunk. Each chunk is sorted into an immutable run: distinct fingerprints in
order with the smallest doc_id that holds each, cut into buckets of the key
range and stored as byte planes of differences. Per bucket the chunks' runs
are merged with the runs of the history into one sorted run of smallest
doc_ids, each chunk's run is joined against the merged
run, and one bit per fingerprint goes back: "a smaller doc_id outside this
chunk has it". A fingerprint occurs at most once in a run, so a passage in a
third of all documents costs one entry a chunk, like any other.

The chunks then apply their bits and remove covered words.

An index is a folder of generations and a manifest of its settings and of the
generations that count. A batch writes its generation under a name of its own
and then a new manifest, by one rename; a job that fails before that leaves the
index as it was. Old generations go only after the manifest that no longer names
them is there. Compaction merges all runs into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, small_batches, with_columns_of
from finquery.llm.words import U64, Words, covered, slices, window_hashes, window_starts

CHUNK_BYTES = 6 << 20
#: Fingerprints in one bucket, about: what one reducing task holds at a time.
BUCKET_WINDOWS = 1 << 20
NULL_ID = -(1 << 63)
#: The part of a whole table, by doc_id, that is taken in first, as the history of the rest.
HISTORY = 1 / 16
#: Characters of a word with its space, about: what a table's words are guessed from when an index begins.
WORD_BYTES = 6
CHUNK = "chunk long, n_words long, doc_ids binary, sizes binary, texts binary"
CELL = "bucket long, chunk long, n long, low long, run binary"


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes, with as many planes as the largest needs."""
    planes = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([planes]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    planes = raw[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :planes] = np.frombuffer(raw, dtype=np.uint8, count=n * planes, offset=at + 1).reshape(planes, n).T
    return out.reshape(-1).view("<u8"), at + 1 + n * planes


def pack_run(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[int, bytes]:
    """The smallest doc_id, and a sorted run in byte planes."""
    low = int(docs.min())
    return low, packed(np.diff(keys, prepend=U64(0))) + packed(checks) + packed((docs - low).astype(U64))


def unpack_run(n: int, low: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = unpacked(raw, 0, n)
    checks, at = unpacked(raw, at, n)
    docs, _ = unpacked(raw, at, n)
    return np.cumsum(keys, dtype=U64), checks, docs.astype(np.int64) + low


def merged(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their smallest doc_id, and for each given entry its place among them."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if (unlike := (k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # keys met: order by the check too
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) if unlike.any() else k[1:] != k[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], c[first], np.minimum.reduceat(docs[order], first) if len(first) else docs, place


def chunked(documents: DataFrame) -> DataFrame:
    """Documents in rows of bounded size; texts are compressed, documents stand in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size, n, press = 0, TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            texts = [t for _, t in held]
            row = [n, sum(len(t.split()) for t in texts), np.array([i for i, _ in held], "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), press.compress(b"".join(texts))]
            return pa.RecordBatch.from_pylist([dict(zip(("chunk", "n_words", "doc_ids", "sizes", "texts"), row, strict=True))], schema=pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())]))

        for whole in batches:
            for batch in slices(whole):
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast("binary").to_pylist(), strict=True):
                    held.append((NULL_ID if i is None else i, t or b""))
                    size += len(t or b"")
                if size >= CHUNK_BYTES or len(held) >= 1 << 18:
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    return with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, CHUNK)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another, without a second copy of the batch."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def texts_of(row: dict) -> tuple[np.ndarray, pa.Array]:
    """The doc_ids (``NULL_ID`` for none) and the texts of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(row["texts"])
    sizes = np.frombuffer(row["sizes"], "<i8")
    kind, offset = (pa.string(), np.int32) if len(raw) < 1 << 31 else (pa.large_string(), np.int64)
    return np.frombuffer(row["doc_ids"], "<i8"), pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(offset).tobytes()), pa.py_buffer(raw)])


def cells_of(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """A sorted run cut at the bucket bounds; a bucket is a range of keys."""
    bucket = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), slice(int(a), int(b))


def written_chunks(work: Scratch, documents: DataFrame, parts: int) -> DataFrame:
    """The chunks as a table bucketed by chunk, so that what comes back for them meets them without moving the texts."""
    name = "finquery_" + work.root.rsplit("-", 1)[1]
    with small_batches(work.spark):
        chunked(documents).write.bucketBy(parts, "chunk").option("compression", "none").option("path", work.path("chunks")).option("parquet.block.size", str(32 << 20)).saveAsTable(name)
    work.catalogued.append(name)
    return work.spark.table(name)


class Chunk:
    """A chunk read back, with the fingerprints of its windows."""

    def __init__(self, row: dict, width: int):
        self.doc_ids, texts = texts_of(row)
        self.words = Words(texts)
        self.n, self.width = len(self.words.ids), width
        self.starts, doc = window_starts(self.words.ends, width)
        keys = window_hashes(self.words.hashes(1), width, 0x9E3779B97F4A7C15)
        checks = window_hashes(self.words.hashes(2), width, 0xC2B2AE3D27D4EB4F) >> U64(40)
        self.docs = self.doc_ids[doc]
        self.keys, self.checks, self.least, self.place = merged(keys[self.starts], checks[self.starts], self.docs)

    def without(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Words, removed words and the kept words of each document; flags: fingerprints that a smaller doc_id outside has."""
        gone = self.starts[flags[self.place] | (self.docs > self.least[self.place])] if len(self.starts) else self.starts
        keep, ends = ~covered(gone, self.width, self.n), self.words.ends
        kept = np.concatenate([[0], np.cumsum(keep)])
        return np.diff(ends), np.diff(ends) - np.diff(kept[ends]), self.words.joined(keep)


class FingerprintIndex:
    """Runs of historical fingerprints in a folder, one subfolder a generation; ``ingest`` matches and adds a batch.

    ``path``: the index's folder in the shared store; one that is there already
    is opened with its own width and number of key ranges, and an error is
    raised if another width is asked for. None: an index without a history,
    for one batch. ``buckets``: key ranges, fixed when an index begins; None
    takes them from the first batch's size. ``fanout``: how many generations
    are kept before all are compacted into one. One writer at a time: of two
    that began from the same manifest the second fails.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = 13, buckets: int | None = None, fanout: int = 4):
        self.spark, self.path, self.width, self.buckets, self.fanout = spark, path, width, buckets, fanout
        self.generations: list[str] = []
        self.version = 0
        if path is not None:
            self._open()

    def _fs(self, name: str):  # noqa: ANN202
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _open(self) -> None:
        fs, where = self._fs(self.path)
        found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        versions = [int(n.split("-")[1].split(".")[0]) for n in found if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return
        self.version = max(versions)
        told = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{self.version}.json", wholetext=True).collect()))  # one small file
        if told["width"] != self.width:
            raise ValueError(f"the index is of windows of {told['width']} words")
        self.buckets, self.generations = told["buckets"], [f"{self.path}/{g}" for g in told["generations"]]

    def _commit(self, generations: list[str]) -> None:
        """Name the generations that count from now on, in a manifest that appears as a whole."""
        told = json.dumps({"width": self.width, "buckets": self.buckets, "generations": [g.rsplit("/", 1)[1] for g in generations]})
        fs, draft = self._fs(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(told.encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest-{self.version + 1}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("another batch was taken in meanwhile")
        old, self.generations, self.version = self.generations, generations, self.version + 1
        for name in [*(g for g in old if g not in generations), f"{self.path}/manifest-{self.version - 1}.json"]:
            fs.delete(self._fs(name)[1], True)

    def history(self) -> DataFrame:
        return self.spark.read.schema(CELL).parquet(*self.generations) if self.generations else self.spark.createDataFrame([], CELL)

    def ingest(self, documents: DataFrame, add: bool = True) -> DataFrame:
        """``doc_id, n_words, n_removed, kept_text`` of each row of ``documents``; ``add``: whether they join the history.

        A word is removed if a window over it also starts in a document with a
        smaller doc_id, in this batch or before. Null texts have no words; rows
        with equal doc_ids take nothing from each other; a null doc_id counts
        as smaller than all. Texts of fewer than ``width`` words stay whole.
        """
        if self.version:
            fs, manifest = self._fs(f"{self.path}/manifest-{self.version}.json")
            if not fs.exists(manifest):
                raise RuntimeError("another batch was taken in meanwhile")
        work, width, spark = Scratch(self.spark, "windows"), self.width, self.spark
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = written_chunks(work, documents, parts)
        self.buckets = self.buckets or max(4 * parts, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WINDOWS))
        buckets = self.buckets

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                chunk, out = Chunk(row, width), []
                for bucket, at in cells_of(chunk.keys, buckets):
                    low, run = pack_run(chunk.keys[at], chunk.checks[at], chunk.least[at])
                    out.append((bucket, row["chunk"], at.stop - at.start, low, run))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], ["bucket", "chunk", "n", "low", "run"])

        runs = chunks.mapInArrow(sort, CELL)
        keep = add and self.path is not None
        fold = len(self.generations) + 1 >= self.fanout

        def compact(cells: pd.DataFrame) -> pd.DataFrame:
            """One bucket: the new run (chunk -1, if kept), and the bits of each chunk."""
            each = [unpack_run(*x) for x in zip(cells["n"], cells["low"], cells["run"], strict=True)]
            ends = np.concatenate([[0], np.cumsum(cells["n"].to_numpy())])
            docs = np.concatenate([x[2] for x in each])
            keys, checks, least, place = merged(np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each]), docs)
            flags = least[place] < docs
            bucket = int(cells["bucket"].iloc[0])
            out = [(bucket, c, b - a, 0, np.packbits(flags[a:b]).tobytes()) for c, a, b in zip(cells["chunk"], ends, ends[1:], strict=False) if c >= 0]
            if keep:  # a new run holds what the batch brings; a compaction all
                new = slice(None) if fold else np.unique(place[np.repeat(cells["chunk"].to_numpy() >= 0, cells["n"]) & ~flags])
                if len(keys[new]):
                    out.append((bucket, -1, len(keys[new]), *pack_run(keys[new], checks[new], least[new])))
            return pd.DataFrame(out, columns=["bucket", "chunk", "n", "low", "run"])

        found = runs.unionByName(self.history()).groupBy("bucket").applyInPandas(compact, CELL)
        if keep:
            work.table("found", found.withColumn("kept", F.col("chunk") < 0), "kept")
            self._add(work.path("found/kept=true"), fold)
            bits_at = work.path("found/kept=false")
            fs, where = self._fs(bits_at)
            found = spark.read.schema(CELL).parquet(bits_at) if fs.exists(where) else spark.createDataFrame([], CELL)
        bits = found.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "run")).alias("bits"))  # a bit for each window of a chunk

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                chunk = Chunk(row, width)
                parts = sorted(row["bits"] or [], key=lambda x: x["bucket"])
                flags = np.concatenate([np.unpackbits(np.frombuffer(x["run"], np.uint8), count=x["n"]).astype(bool) for x in parts]) if parts else np.zeros(0, bool)
                words, removed, kept = chunk.without(flags)
                yield pa.RecordBatch.from_arrays([pa.array([None if i == NULL_ID else i for i in chunk.doc_ids.tolist()], pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept_text"])

        return chunks.join(bits, "chunk", "left").select("doc_ids", "sizes", "texts", "bits").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")

    def _add(self, run: str, fold: bool) -> None:
        """Move a written run into the index, as a generation beside the others or, if all were merged into it, in their place."""
        name = f"{self.path}/generation-{uuid.uuid4().hex}"
        fs, source = self._fs(run)
        fs.mkdirs(self._fs(self.path)[1])
        if not fs.exists(source):  # nothing new
            fs.mkdirs(self._fs(name)[1])
        elif not fs.rename(source, self._fs(name)[1]):
            raise RuntimeError("the new generation could not be moved into the index")
        self._commit([name] if fold else [*self.generations, name])


def remove_repeats(spark: SparkSession, documents: DataFrame, width: int = 13, history: float = HISTORY) -> DataFrame:
    """The whole table through an index of its own: the first documents by doc_id (``history`` of them, about) become the history that the rest is matched with.

    What `FingerprintIndex.ingest` says of nulls, short texts and repeated rows
    holds; an empty table gives no rows.
    """
    cut = documents.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [history], 0.01) if history else None
    if not cut:
        return FingerprintIndex(spark, width=width).ingest(documents)
    index = FingerprintIndex(spark, f"{Scratch(spark, 'index').root}/runs", width)
    before = F.coalesce(F.col("doc_id") <= cut[0], F.lit(True))
    total = documents.where(~before).select(F.sum(F.length("text"))).first()[0] or 0
    index.buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (BUCKET_WINDOWS * WORD_BYTES)))
    return index.ingest(documents.where(before)).unionByName(index.ingest(documents.where(~before), add=False))
