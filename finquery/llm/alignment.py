"""Cross-tokenizer alignment: minimal groups of two tokenizers' tokens, their links and corpus-wide pair counts.

Both tokenizers see a text behind one space. A token of one overlaps tokens of
the other where their byte ranges meet; the connected components of that
bipartite graph, found by union-find, are the minimal groups. A component's
members expand to links: pairs that end on the same byte. Where two tokens end
together, everything before is settled, so what lies between two single spaces
is aligned once for all places where it stands (`Aligner`).

Counting is distributed: a chunk of texts brings each distinct pair once with
its count, pairs are summed over chunks, and each chunk gets one row back for
each of its pairs. No key has more rows than there are chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquery.llm.scratch import LARGE_ROWS, Scratch, held, with_columns_of
from finquery.llm.token_output import Remembered
from finquery.llm.words import slices

#: Fixed: every character that some reading counts as white space, and marks without width. Beside one of them, and between two spaces, a text is not cut.
WHITE = "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{2581}\\x{3000}\\x{feff}"
UNSAFE = f"\\A\\z|\\A[{WHITE}]|[{WHITE}]\\z"
#: Longer pieces are aligned anew in every chunk, so that the memory of remembered pieces is bounded.
REMEMBERED_BYTES = 64
#: A pair as one number: the first tokenizer's id above these bits, the second's in them.
SECOND_BITS = 24

#: Of so many chunks a task holds looked-up pairs as objects; more are sorted.
CHUNKS_HELD = "8"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, the rest from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over ``n`` nodes and the edges ``u[i]-v[i]``: each node's least member of its component."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))  # union: the greater root below the lesser
        while True:  # find: halve all paths until they end at roots
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + sizes[i] - 1``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``sizes[i]`` values."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Groups:
    """The aligned pieces of a chunk: per piece ``n_a, n_b, n_groups`` and ``text`` (its groups as written), and the links of all, flat: ``pair``, ``n_links`` a piece."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, aligner: Aligner):
        end_a, end_b = np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b])
        ends = np.union1d(end_a, end_b)  # between two successive ends lies just one overlapping pair
        label = components(len(a) + len(b), np.searchsorted(end_a, ends), len(a) + np.searchsorted(end_b, ends))
        group_a, group_b = (np.searchsorted(np.unique(label), part) for part in (label[: len(a)], label[len(a) :]))
        # Links: of all pairs of a component's members those that end together. Ends of one side differ, so these are its last members.
        last_a, last_b = (np.flatnonzero(np.diff(g, append=-1)) for g in (group_a, group_b))
        if not np.array_equal(end_a[last_a], end_b[last_b]):
            raise AssertionError("a component whose sides do not end together")
        self.pair = (a[last_a].astype(np.int64) << SECOND_BITS) | b[last_b]
        self.n_a, self.n_b = n_a, n_b
        begins = np.diff(group_a, prepend=-1) > 0
        self.n_groups = self.n_links = sums(begins, n_a)
        # As text: a separator and the id, in the order group, side, place.
        first_b = np.diff(group_b, prepend=-1) > 0
        opens = np.zeros(len(a) + 1, dtype=bool)
        opens[(np.cumsum(n_a) - n_a)[n_a > 0]] = True
        code_a = np.where(opens[:-1], 0, np.where(begins, 1, 2)) * aligner.most + a
        code_b = np.where(first_b, 3, 2) * aligner.most + b
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(last_a)))])[group_a]
        upto_a = np.cumsum(np.bincount(group_a, minlength=len(last_a)))[group_b]
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + before_b] = code_a
        code[np.arange(len(b)) + upto_a] = code_b
        written = aligner.written.take(pa.array(code))
        at = np.frombuffer(written.buffers()[1], dtype=np.int64)[: len(code) + 1][np.concatenate([[0], np.cumsum(n_a + n_b)])]
        self.text = pa.LargeStringArray.from_buffers(len(n_a), pa.py_buffer(np.ascontiguousarray(at)), written.buffers()[2] or pa.py_buffer(b""))


class Aligner:
    """Ids of both tokenizers for pieces of texts.

    A cut at a space between two characters that are not white space changes
    neither tokenizer's ids: the byte-level one splits there before it merges,
    and no entry of the second one's vocabulary has a space after another
    character (checked). Texts with other spaces are pieces of their own.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.first.encode_special_tokens = True
        letters, special = byte_letters(), self.first.get_added_tokens_decoder()
        vocabulary = self.first.get_vocab()
        self.bytes_a, self.bytes_b = [b""] * (max(vocabulary.values()) + 1), []
        for token, n in vocabulary.items():
            self.bytes_a[n] = token.encode() if n in special else bytes(letters[c] for c in token)
        for n in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(n)
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.second.is_byte(n) else piece.replace("▁", " ").encode())
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b) or not all(map(len, self.bytes_a)) or not all(map(len, self.bytes_b)):
            raise ValueError("a vocabulary with empty entries, or with a space inside one")
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        ids = pc.cast(pa.array(np.arange(self.most)), pa.large_string())
        self.written = pa.concat_arrays([pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (mark, ids, ""))) for mark in ("", ";", ",", "|")])
        self.known = Remembered("<u4")

    def learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with the two numbers of its ids and the ids; no ids where either side's bytes are not those of the piece behind a space."""
        for k in range(0, len(pieces), 1 << 13):
            some = pieces[k : k + (1 << 13)]
            found = self.first.encode_batch_fast([" " + p for p in some], add_special_tokens=False)
            for p, e, b in zip(some, found, self.second.encode(some, num_threads=1), strict=True):
                a, want = e.ids, b" " + p.encode()
                same = b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b])
                yield p, np.array([len(a), len(b), *a, *b] if same else [0, 0], dtype="<u4").tobytes()

    def _records(self, short: pa.Array, long: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces as `learn` writes them, flat, and where each piece's begin."""
        places = self.known.places(short, self.learn)
        fresh = [x for _, x in self.learn(long.to_pylist())]
        size = np.concatenate([self.known.size, np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4])
        flat = np.concatenate([self.known.ids, np.frombuffer(b"".join(fresh), dtype="<u4")])
        return flat, (np.cumsum(size) - size)[np.concatenate([places, len(self.known.size) + np.arange(len(fresh))])]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Groups]:
        """The numbers of all texts' pieces in a row, how many each text has, and the pieces. A text that has no tokens has no pieces."""
        texts = texts.fill_null("")
        parts = pc.split_pattern(texts, " ")
        coded, n = parts.flatten().dictionary_encode(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        at, unique = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        unsafe = pc.match_substring_regex(unique, UNSAFE).to_numpy(zero_copy_only=False)
        whole = sums(unsafe[at], n) > 0
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        at = at[np.repeat(~whole, n)]
        used, at = np.unique(at, return_inverse=True)
        pieces = unique.take(pa.array(used))
        is_short = pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= REMEMBERED_BYTES
        order = np.concatenate([np.flatnonzero(is_short), np.flatnonzero(~is_short)])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        lone = texts.filter(pa.array(whole & filled))
        flat, begin = self._records(pieces.filter(pa.array(is_short)), pa.concat_arrays([pieces.filter(pa.array(~is_short)), lone]))
        n = np.where(whole, filled, n).astype(np.int64)
        numbers, doc = np.empty(n.sum(), dtype=np.int64), np.repeat(np.arange(len(n)), n)
        numbers[~whole[doc]] = number[at]
        numbers[whole[doc]] = len(order) + np.arange(len(lone))
        n_a, n_b = flat[begin].astype(np.int64), flat[begin + 1].astype(np.int64)
        ok = sums(n_a[numbers] == 0, n) == 0
        numbers, n = numbers[ok[doc]], np.where(ok, n, 0)
        a, b = (flat[spread(s, m)].astype(np.int64) for s, m in ((begin + 2, n_a), (begin + 2 + n_a, n_b)))
        return numbers, n, Groups(a, b, n_a, n_b, self)


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(path_a, path_b)


CHUNK = "chunk long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, pieces array<long>, numbers binary, n_links binary, links binary, pairs array<struct<pair:long,n:long>>"


def chunk_row(chunk: int, doc_ids: pa.Array, texts: pa.Array, own: Aligner) -> pa.RecordBatch:
    """One row for all texts of a chunk: what is known of each without the other chunks, its pieces, the pieces' links, and the distinct pairs with their counts."""
    numbers, n, groups = own.align(texts)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), groups.text.take(pa.array(numbers))), pa.scalar(";", pa.large_string()))
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() if k else "" for k, x in zip(n.tolist(), joined, strict=True)]
    totals = [pa.array(sums(x[numbers], n)) for x in (groups.n_a, groups.n_b, groups.n_groups, groups.n_links)]
    docs = pa.StructArray.from_arrays([doc_ids.cast(pa.int64()), *totals, pa.array(digests, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    pairs, link = np.unique(groups.pair, return_inverse=True)
    times = np.bincount(numbers, minlength=len(groups.n_links))
    count = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(count, link, np.repeat(times, groups.n_links))
    table = pa.StructArray.from_arrays([pa.array(pairs), pa.array(count)], ["pair", "n"]).filter(pa.array(count > 0))
    link = (np.cumsum(count > 0) - 1)[link] if len(pairs) else link  # pieces only of texts without tokens have no pairs that count
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    raw = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), listed(docs), listed(pa.array(n)), raw(numbers), raw(groups.n_links), raw(link), listed(table)], ["chunk", "docs", "pieces", "numbers", "n_links", "links", "pairs"])


def chunks_of(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`CHUNK` rows; a chunk is about 4 MB of text of one task, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context = aligner(path_a, path_b), TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 33
        for whole in batches:
            for batch in slices(whole):
                yield chunk_row(chunk, batch.column("doc_id"), batch.column("text"), own)
                chunk += 1

    return with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, n, best``: the links that hold a pair in the whole corpus, and whether no pair of the same second id has more."""
    counts = chunks.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("n")).withColumn("second", F.col("pair").bitwiseAND((1 << SECOND_BITS) - 1))
    most = counts.groupBy("second").agg(F.max("n").alias("most"))  # joined: of one second id there are as many pairs as the first vocabulary has entries at most
    return counts.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def totals_of(chunks: DataFrame) -> DataFrame:
    """The documents of chunk rows with ``known``, the looked-up pairs in the order of the chunk's own."""
    fields = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                docs, known = (batch.column(c).slice(k, 1).flatten() for c in ("docs", "known"))
                numbers, n_links, links = (np.frombuffer(batch.column(c)[k].as_py(), dtype="<i4").astype(np.int64) for c in ("numbers", "n_links", "links"))
                pieces = batch.column("pieces").slice(k, 1).flatten().to_numpy()
                n, best = (known.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "best"))
                each = [sums(sums(np.append(x, 0)[links], n_links)[numbers], pieces) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in fields), *(pa.array(x) for x in each)], [*fields, "n_best", "count_sum"])

    return chunks.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def alignment(spark: SparkSession, documents: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the pairs ``first_id, second_id, n, best`` of the whole corpus.

    Per row of ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    n_best`` (links whose pair no other pair of their second id exceeds) and
    ``count_sum`` (the counts of its links, summed). Null and empty texts, and
    those that a tokenizer does not give back byte by byte, have zeros and an
    empty ``groups_sha256``. Repeated rows are rows of their own and count as
    often as they stand; a null doc_id stays null; other columns are left
    behind; an empty table gives no rows.
    """
    work = Scratch(spark, "alignment")
    chunks = work.table("chunks", chunks_of(documents, path_a, path_b), **LARGE_ROWS)
    pairs = work.table("pairs", pair_counts(chunks), batch=4)
    asked = chunks.select("chunk", F.explode("pairs.pair").alias("pair"))
    known = asked.join(pairs, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))
    none = F.expr("CAST(array() AS array<struct<pair:bigint,n:bigint,best:boolean>>)")
    rows = totals_of(chunks.join(known, "chunk", "left").select("docs", "pieces", "numbers", "n_links", "links", F.coalesce("known", none).alias("known")))
    first = F.shiftright("pair", SECOND_BITS).alias("first_id")
    with held(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": CHUNKS_HELD}):
        found = work.table("documents", rows, batch=4)
    work.remove("chunks")
    return found, pairs.select(first, F.col("pair").bitwiseAND((1 << SECOND_BITS) - 1).alias("second_id"), "n", "best")
