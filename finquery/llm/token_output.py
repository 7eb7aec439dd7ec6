"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

Format of a file: consecutive blocks, each of them

    magic ``FQT1`` | documents u32 | ids u32 | data bytes u32
    | doc_id i64 per document | ids u32 per document
    | control bytes (four 2-bit lengths a byte) | data bytes | ``\\n``

An id is written as its frequency rank in 1 to 4 little-endian bytes, frequent
ids in one; its length less one stands in the control bytes, apart from the
data. Reading looks control bytes up in a 256-row table of lengths, takes
prefix sums for positions and gathers bytes, all in numpy. The rank table is a
table of its own beside the files.

Files are written by Spark's own writer (its committer makes retries safe, and
any store Spark can write to serves), in ascending ``doc_id`` across files.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, shuffles_removed, small_batches, with_columns_of
from finquery.llm.words import Words, release, slices

MAGIC = b"FQT1"
BLOCK_IDS = 1 << 18
#: Files have so many ids at most, about (20 MB): one file is one bounded unit of reading. A small corpus is
#: dealt over as many files as there are shuffle partitions, of LEAST_IDS at least.
FILE_IDS, LEAST_IDS = 1 << 24, 2 << 20
#: Stands for a document without an id.
NULL_ID = -(1 << 63)
#: Words that an encoder remembers: so many, then those in use.
MOST_PIECES = 1 << 19
#: Marks that may follow letters; the apostrophe is left out, as it begins endings.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters that are composed already and whose lower case is one letter (so no dotted capital I).
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
#: Bytes taken by each of the four ids of a control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


class Encoder:
    """Ids of whole texts through the tokenizers library, each distinct piece between spaces encoded once.

    Texts that may hold a special token's string go whole to the library, which
    gives such strings their own ids; with ``ordinary`` they are text like any other.

    Valid for tokenizers that drop white space, never join pieces across it and
    mark the end of a word in the vocabulary (`separable`): the ids are then
    those of the whole text. Pieces go to the library many at a time and are
    told apart by their number of words; where the ends of words do not add up,
    one at a time. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.kind = id_type(path)
        told = json.loads(self.tokenizer.to_str())
        # Case and composition can change on the way to a match; what stands before the first letter cannot.
        fronts = {"".join(takewhile(lambda c: c.isascii() and not c.isalnum() and not c.isspace(), t["content"])) for t in told["added_tokens"] if not (ordinary and t["special"])}
        self.special = "|".join("".join(f"\\x{ord(c):02x}" for c in front) for front in sorted(fronts))
        pre = told.get("pre_tokenizer") or {}
        first, suffix = (pre.get("pretokenizers") or [pre])[0], told["model"].get("end_of_word_suffix")
        self.separable = "" not in fronts and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and bool(suffix)
        if self.separable:
            self.words = regex.compile(first["pattern"]["Regex"])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            for token, n in self.tokenizer.get_vocab().items():
                self.ends[n] = token.endswith(suffix)
            self.light = Tokenizer(self.tokenizer.model)  # the same model for words on which normalising and splitting change nothing
            self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            probe = "the quick brown fox jumps over lazy dogs"
            self.plain = self.words.findall("word" + TAIL) == ["word", TAIL] and self.light.encode(probe).ids == self._raw([probe.upper()])[0].tolist() == self._raw([probe])[0].tolist()
        self.bases, self.others, self.tails = Remembered(self.kind), Remembered(self.kind), {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _groups(self, pieces: list[str], counts: list[int], tokenizer) -> Iterator[tuple[str, bytes]]:  # noqa: ANN001
        """Each piece with its ids; ``counts``: words in each piece."""
        for k in range(0, len(pieces), 1 << 15):
            at = range(k, min(k + (1 << 15), len(pieces)), 256)
            texts = [" ".join(pieces[j : j + 256]) for j in at]
            for j, e in zip(at, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                group, ids = pieces[j : j + 256], np.array(e.ids, dtype=self.kind)
                ends, upto = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]), np.cumsum([0, *counts[j : j + 256]])
                if upto[-1] == len(ends) - 1 and ends[-1] == len(ids):
                    cuts, raw = (ends[upto] * ids.itemsize).tolist(), ids.tobytes()
                    yield from ((p, raw[a:b]) for p, a, b in zip(group, cuts, cuts[1:], strict=False))
                else:
                    yield from zip(group, (x.tobytes() for x in self._raw(group)), strict=True)

    def _tails(self, low: pa.Array, size: np.ndarray, short: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The number of each piece's marks among ``self.tails``; 0 for none."""
        if len(self.tails) > 1 << 12:
            self.tails.clear()
        self.tails.setdefault(b"", b"")
        number = {t: k for k, t in enumerate(self.tails)}
        raw, ends = np.frombuffer(low.buffers()[2] or b"", dtype=np.uint8), low.offset + np.cumsum(size)
        which = np.zeros(len(size), dtype=np.int64)
        for n in np.unique((size - short)[plain]).tolist():
            if n == 0:
                continue
            at = np.flatnonzero(plain & (size - short == n))
            runs, of = np.unique(raw[ends[at, None] - n + np.arange(n)], axis=0, return_inverse=True) if n > 1 else np.unique(raw[ends[at] - 1], return_inverse=True)
            names = [r.tobytes() for r in runs]
            new = [t for t in names if t not in number]
            for t, x in zip(new, self._raw([t.decode() for t in new]) if new else (), strict=True):
                number[t] = len(number)
                self.tails[t] = x.tobytes()
            which[at] = np.array([number[t] for t in names])[of.ravel()]
        return which

    def _parts(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of word parts in a row, the size of each part, and for each piece the numbers of its two parts (letters, then marks)."""
        low = pc.utf8_lower(unique)
        base = pc.ascii_rtrim(low, characters=TAIL)
        size, short = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (low, base))
        # Composed Latin letters, then marks: two words at most, each on its own.
        plain = pc.match_substring_regex(pc.ascii_rtrim(unique, characters=TAIL), LETTERS).to_numpy(zero_copy_only=False) & (size - short < 9) & self.plain
        coded = base.filter(pa.array(plain)).dictionary_encode()
        places = self.bases.places(coded.dictionary, lambda new: self._groups(new, [1] * len(new), self.light))
        other = self.others.places(unique.filter(pa.array(~plain)), lambda new: self._groups(new, [len(self.words.findall(unicodedata.normalize("NFC", p).lower())) for p in new], self.tokenizer))
        which = np.zeros((len(unique), 2), dtype=np.int64)
        which[:, 1] = self._tails(low, size, short, plain)
        tails = [np.frombuffer(x, dtype=self.kind) for x in self.tails.values()]
        which[plain, 0] = places[coded.indices.to_numpy(zero_copy_only=False)] + len(tails)
        which[~plain, 0] = other + len(tails) + len(self.bases.size)
        return np.concatenate([*tails, self.bases.ids, self.others.ids]), np.concatenate([[len(x) for x in tails], self.bases.size, self.others.size]).astype(np.int64), which

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, of the type ``kind``, and where each text begins and ends."""
        if not self.separable:
            found = self._raw(["" if t is None else t for t in texts.to_pylist()])
            return np.concatenate([np.empty(0, self.kind), *found]), np.cumsum([0, *map(len, found)])
        if self.special:
            held = pc.match_substring_regex(texts, self.special).fill_null(False)
            at = np.flatnonzero(held.to_numpy(zero_copy_only=False))
            if len(at):
                flat, ends = self._plain_ids(pc.if_else(held, "", texts))
                found = self._raw(texts.take(pa.array(at)).to_pylist())
                size = np.diff(ends)
                size[at] = [len(x) for x in found]
                return np.insert(flat, np.repeat(ends[at], size[at]), np.concatenate(found)), np.concatenate([[0], np.cumsum(size)])
        return self._plain_ids(texts)

    def _plain_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        flat, size, which = self._parts(words.unique)
        part = which[words.ids].ravel()
        n = size[part]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat((np.cumsum(size) - size)[part] - ends[:-1], n) + np.arange(ends[-1])], ends[2 * words.ends]


class Remembered:
    """Pieces with their ids, in flat arrays; of a full table the pieces in use stay."""

    def __init__(self, kind: str):
        self.known, self.ids, self.size = pa.array([], pa.string()), np.empty(0, kind), np.empty(0, np.int64)

    def places(self, wanted: pa.Array, learn: Callable[[list[str]], Iterator[tuple[str, bytes]]]) -> np.ndarray:
        """The place of each of some distinct pieces; those that are not known are learnt."""
        at = pc.fill_null(pc.index_in(wanted, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) > MOST_PIECES:
            kept = np.unique(at[at >= 0])
            n, first = self.size[kept], (np.cumsum(self.size) - self.size)[kept]
            self.ids = self.ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            self.known, self.size = self.known.take(pa.array(kept)), n
            at = np.where(at >= 0, np.searchsorted(kept, at), -1)
        new = np.flatnonzero(at < 0)
        if len(new):
            pieces = wanted.take(pa.array(new))
            found = [x for _, x in learn(pieces.to_pylist())]
            at[new] = len(self.size) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, pieces])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype=self.ids.dtype)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize])
        return at


@cache
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, ordinary)


def id_type(path: str) -> str:
    """Two bytes hold the ids of a vocabulary of up to 65,536, four those of a larger one."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return "<u2" if max([*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])]) < 1 << 16 else "<u4"


def tokenize(documents: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """``doc_id, n, ids`` (little-endian, of `id_type`, with the end id if given) of every whole text; a null text is empty."""
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = encoder(tokenizer), np.array([] if end_id is None else [end_id], dtype=kind)
        for whole in batches:
            for batch in slices(whole):
                ids, ends = own.ids(batch.column("text"))
                found = [np.concatenate([ids[a:b], tail]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "n", "ids"])

    return with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, n long, ids binary")


def control_encoded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    most = int(size.max()) if len(size) else 1
    wide = "<u2" if most < 3 else "<u4"
    raw = values.astype(wide).view(np.uint8).reshape(-1, np.dtype(wide).itemsize)
    data = raw[np.arange(raw.shape[1]) < size[:, None]].tobytes()
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = size - 1
    return (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8).tobytes(), data


def control_decoded(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values; lengths by table lookup, positions by prefix sums."""
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        more = np.flatnonzero(size > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int], parts: list[np.ndarray]) -> bytes:
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    control, data = control_encoded(flat)
    head = MAGIC + np.array([len(doc_ids), len(flat), len(data)], dtype="<u4").tobytes()
    return head + np.array(doc_ids, dtype="<i8").tobytes() + np.array([len(p) for p in parts], dtype="<u4").tobytes() + control + data


def blocks_of(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc_ids, ids per document, ranks`` of each block of a file."""
    raw, at = np.frombuffer(content, dtype=np.uint8), 0
    while at < len(raw):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a token file")
        docs, n, size = (int(x) for x in raw[at + 4 : at + 16].view("<u4"))
        at += 16
        ids, counts = raw[at : at + 8 * docs].view("<i8"), raw[at + 8 * docs : at + 12 * docs].view("<u4")
        at += 12 * docs
        control, at = raw[at : at + -(-n // 4)], at + -(-n // 4)
        yield ids, counts, control_decoded(control, raw[at : at + size], n)
        at += size + 1


def ranked(tokens: DataFrame, kind: str) -> DataFrame:
    """``id, rank``: ids by falling count over the whole corpus, then by id. As many rows as the vocabulary has ids in use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # encoding is over
        release()
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    counts = tokens.select("ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "id")) - 1).select("id", F.col("rank").cast("long").alias("rank"))


def write_token_files(tokens: DataFrame, kind: str, ranks: DataFrame, path: str, most_ids: int) -> None:
    """Files at ``path`` in ascending doc_id. ``most_ids``: the vocabulary's size, a bound of the rank table that goes to each task."""
    table = ranks.toPandas()  # one row for each vocabulary id in use
    if len(table) > most_ids:
        raise ValueError("the rank table is larger than the vocabulary")
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, dtype=np.uint32)
    rank_of[table["id"].to_numpy()] = table["rank"].to_numpy()
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, -(-total // FILE_IDS), min(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_IDS)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block(ids, parts)], pa.binary())], ["block"])
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(NULL_ID if doc_id is None else doc_id)
                parts.append(rank_of[np.frombuffer(raw, dtype=kind)])
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield out()
                    ids, parts, size = [], [], 0
        if ids:
            yield out()

    blocks = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n").mapInArrow(encode, "block binary")
    with small_batches(tokens.sparkSession), shuffles_removed(tokens.sparkSession):
        blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def file_number(path: Column) -> Column:
    """The number in a part file's name. Names hold five digits or more, so their order as text is not that of the files."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long")


def read_token_files(spark: SparkSession, path: str, ranks: DataFrame) -> DataFrame:
    """``file`` (its number), ``inside`` (ids before, in the file), ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of all documents in the files."""
    table = ranks.toPandas()
    id_of = np.zeros(len(table) + 1, dtype=np.uint32)
    id_of[table["rank"].to_numpy()] = table["id"].to_numpy()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                file, before = batch.column("file")[k].as_py(), 0
                for doc_ids, counts, values in blocks_of(batch.column("content")[k].as_py()):
                    raw, ends = id_of[values].tobytes(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                    cuts = (ends * 4).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(doc_ids), pa.int64()), pa.array(ends[:-1] + before), pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(counts, pa.int64()), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["file", "inside", "doc_id", "n_tokens", "ids"])
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(file_number(F.col("path")).alias("file"), "content").mapInArrow(decode, "file long, inside long, doc_id long, n_tokens long, ids binary")


def token_output(spark: SparkSession, documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``documents`` as token files and read them back: ``doc_id, start, n_tokens, ids_crc32, file``.

    Null texts are empty and have the end id alone; documents with equal ids of
    their own (repeated rows) each stay, next to each other, in the order of
    their lengths; documents without an id come first. An empty table gives no
    rows. ``start`` counts the ids of all documents before, by doc_id.
    """
    work, kind = Scratch(spark, "tokens"), id_type(tokenizer)
    tokens = work.table("ids", tokenize(documents, tokenizer, end_id))
    ranks = work.table("ranks", ranked(tokens, kind))
    write_token_files(tokens, kind, ranks, work.path("files"), 1 << 22)
    work.remove("ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "inside", "doc_id", "n_tokens")), pa.array(crc, pa.int64())], ["file", "inside", "doc_id", "n_tokens", "ids_crc32"])

    rows = work.table("digests", read_token_files(spark, work.path("files"), ranks).mapInArrow(digest, "file long, inside long, doc_id long, n_tokens long, ids_crc32 long"))
    return rows.join(starts_of(rows), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file")


def starts_of(rows: DataFrame) -> DataFrame:
    """``file, before``: the ids in all files before; one row a file."""
    return rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file")).withColumn("before", F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).drop("in_file")
