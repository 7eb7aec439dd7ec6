"""Token counts by a separator scan over flat, unindexed token files.

A file is nothing but little-endian token ids; each document ends with the
end-of-document id. Files are cut into blocks of equal size that are read on
their own. A block finds all separators at once with numpy and knows every
document that begins and ends in it. What a block cannot know, where a document
that ends in it began, comes from an exclusive prefix scan over the blocks of
the file: the last begin before the block. The scan holds one row a block.

Documents do not run across files. Tokens after a file's last separator are a
document without an end (``ended`` false).

``stamp`` ids may open each document (five digits of base 2**15, the doc_id):
flat files that are written here carry it, so that counts can name documents
without an index. A block reads its stamps' ids beyond its own end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, small_batches, with_columns_of
from finquery.llm.token_output import encoder, id_type
from finquery.llm.words import slices

BLOCK_IDS = 1 << 20
STAMP, DIGIT, NULL_STAMP = 5, 15, (1 << 75) - 1


def stamps(doc_ids: list[int | None]) -> np.ndarray:
    """Five ids for each doc_id; a null has the largest digits."""
    values = [NULL_STAMP if i is None else i + (1 << 63) for i in doc_ids]
    return np.array([[v >> DIGIT * k & 0x7FFF for k in range(STAMP)] for v in values], dtype=np.uint32).reshape(-1, STAMP)


def unstamped(digits: np.ndarray) -> int | None:
    value = sum(int(d) << DIGIT * k for k, d in enumerate(digits))
    return None if value == NULL_STAMP else value - (1 << 63)


def write_flat_files(documents: DataFrame, tokenizer: str, end_id: int, path: str) -> str:
    """Flat files of stamped documents at ``path``; returns the type of the ids. A null text has no ids of its own.

    Strings of special tokens in a text are ordinary text here, so that no text
    holds the end-of-document id.

    Spark's text writer puts the separator after each row, so its bytes must be
    those of a string in Latin-1, which holds for every id.
    """
    if end_id < 1 << DIGIT:
        raise ValueError("the end-of-document id must be no digit of a stamp")
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, ordinary=True)
        for whole in batches:
            for batch in slices(whole):
                ids, ends = own.ids(batch.column("text"))
                if (ids == end_id).any():
                    raise ValueError("the end-of-document id must be a special token's")
                heads = stamps(batch.column("doc_id").to_pylist()).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() + ids[a:b].tobytes() for h, a, b in zip(heads, ends, ends[1:], strict=False)], pa.binary())], ["value"])

    separator = np.array([end_id], dtype=kind).tobytes().decode("latin-1")
    flat = with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, "value binary")
    with small_batches(documents.sparkSession):
        flat.select(F.col("value").cast("string")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    return kind


def blocks_of(spark: SparkSession, path: str, kind: str, block_ids: int) -> DataFrame:
    """``path, size, block``: the blocks of the files below ``path``, from their lengths alone."""
    width = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", (F.col("length") / width).cast("long").alias("size"))
    return files.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_ids).cast("long"))))


def ranged(path: str) -> bool:
    """Whether Arrow can open files of the path's store."""
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def separator_scan(spark: SparkSession, path: str, end_id: int, kind: str, stamp: int = STAMP, block_ids: int = BLOCK_IDS, ranges: bool = True) -> DataFrame:
    """``file, ordinal, start, n_tokens, ended, doc_id`` of every document in the flat files below ``path``.

    ``start`` counts ids from the file's beginning, after the stamp; without
    stamps doc_id is null. An empty file holds no documents. Blocks are read by
    their ranges; from a store that only Spark opens, files come whole (each
    below 2 GB, as those written here are) and are cut into blocks then.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = np.dtype(kind).itemsize

    def facts(path: str, block: int, total: int, ids: np.ndarray) -> pa.RecordBatch:
        """What a block shows; ``ids`` may run on behind it for the length of a stamp."""
        begin = block * block_ids
        found = np.flatnonzero(ids[: min(block_ids, total - begin)] == end_id)
        starts = found + 1
        starts = starts[starts + begin < total]  # none after the file's last id
        if begin == 0:
            starts = np.concatenate([[0], starts])
        who = [unstamped(ids[s : s + stamp]) if stamp else None for s in starts]
        # The n-th begin of the block belongs to the n-th end here, but for an end whose document began before.
        early = int(begin > 0 and len(found) > 0)
        n = len(found) - early
        firsts, ends, names = [None] * early + starts[:n].tolist(), found.tolist(), [None] * early + who[:n]
        out = [(path, block, k, None if s is None else begin + s, begin + e, w, False) for k, (s, e, w) in enumerate(zip(firsts, ends, names, strict=True))]
        left = starts[n:].tolist()  # at most one document is still open
        out.append((path, block, len(found), begin + left[0] if left else None, None, who[n] if left else None, True))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["path", "block", "k", "first", "end", "doc_id", "summary"])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(row["path"])
                begin = row["block"] * block_ids
                with fs.open_input_file(name) as f:
                    raw = f.read_at((min(block_ids, row["size"] - begin) + stamp) * width, begin * width)
                yield facts(row["path"], row["block"], row["size"], np.frombuffer(raw, dtype=kind))

    def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["content"], dtype=kind)
                for n in range(-(-len(ids) // block_ids)):
                    yield facts(row["path"], n, len(ids), ids[n * block_ids : (n + 1) * block_ids + stamp])

    schema = "path string, block long, k long, first long, end long, doc_id long, summary boolean"
    if ranges and ranged(path):
        scanned = blocks_of(spark, path, kind, block_ids).repartition(parts, "path", "block").mapInArrow(by_range, schema)
    else:
        scanned = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(by_file, schema)
    found = Scratch(spark, "separators").table("found", scanned)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("first").isNotNull(), F.struct("first", "doc_id"))
    scan = found.where("summary").select("path", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ends_before"), F.last(opened, True).over(before).alias("carry"), F.col("k").alias("here"), opened.alias("open"))
    inner = found.where("not summary").join(scan.select("path", "block", "ends_before", "carry"), ["path", "block"])
    whole = inner.select("path", (F.col("ends_before") + F.col("k")).alias("ordinal"), F.coalesce("first", "carry.first").alias("first"), "end", F.lit(True).alias("ended"), F.when(F.col("first").isNotNull(), F.col("doc_id")).otherwise(F.col("carry.doc_id")).alias("doc_id"))
    # A file whose last id is no separator: what is open after its last block.
    last = scan.groupBy("path").agg(F.max_by(F.struct((F.col("ends_before") + F.col("here")).alias("ordinal"), F.coalesce("open", F.when(F.col("here") == 0, F.col("carry"))).alias("open")), "block").alias("x"))
    sizes = blocks_of(spark, path, kind, block_ids).where("block = 0").select("path", "size")
    tail = last.where("x.open is not null").join(sizes, "path").select("path", "x.ordinal", F.col("x.open.first").alias("first"), F.col("size").alias("end"), F.lit(False).alias("ended"), F.col("x.open.doc_id").alias("doc_id"))
    return whole.unionByName(tail).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "ordinal", (F.col("first") + stamp).alias("start"), (F.col("end") - F.col("first") - stamp).alias("n_tokens"), "ended", "doc_id")


def token_counts(spark: SparkSession, documents: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``documents`` as flat files and count each one's tokens by a scan. Repeated rows each count; an empty table gives no rows."""
    work = Scratch(spark, "flat")
    kind = write_flat_files(documents, tokenizer, end_id, work.path("files"))
    return separator_scan(spark, work.path("files"), end_id, kind, STAMP, block_ids)
