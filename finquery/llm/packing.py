"""Packing of documents into sequences of bounded length by cutting-stock column generation.

A document's full sequences stand alone; what remains of it (less than a
sequence) is an item of the cutting-stock problem. Only the histogram of item
lengths reaches the driver, one count a length. There a linear program over
patterns (multisets of lengths that share a sequence) is solved by column
generation: a knapsack over exact totals prices new patterns with the duals of
the lengths. Its solution is rounded down and completed; items that no pattern
takes without much padding are laid end to end and cut where sequences end, and
the last of these sequences is cut into powers of two, which need no padding.

Documents are ranked within their length, and the ranks of a length are dealt
to the patterns by intervals, so that each document finds its place by a search
in the plan, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquery.llm.scratch import Scratch, with_columns_of
from finquery.llm.token_output import encoder, id_type
from finquery.llm.words import slices

#: What laying an item end to end with others costs, as tokens of padding: a cut document is worth so much of it.
CUT_PRICE = 4.0
#: The program is solved when no better solution can save more than this share of all tokens, or when so many rounds of new patterns together saved less.
GAP, PATIENCE = 3e-5, 50
#: New patterns of a round.
COLUMNS = 40


def waste(totals: np.ndarray, size: int) -> np.ndarray:
    """Padding of sequences with so many tokens: none at a power of two."""
    return np.where((totals & (totals - 1)) == 0, 0, size - totals)


def best_totals(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each exact total the greatest value of lengths that sum to it, and the place of the last length taken (-1: none)."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        k = fits[c]
        if k:
            gains = best[c - lengths[:k]] + values[:k]
            j = int(gains.argmax())
            best[c], last[c] = gains[j], (j if gains[j] > -np.inf else -1)
    return best, last


def longest_first(lengths: np.ndarray, left: np.ndarray, size: int) -> dict[int, int]:
    """A pattern that takes the longest length that still fits, over and over, of what is ``left``."""
    pattern, room, k = {}, size, len(lengths)
    open_ = np.flatnonzero(left > 0)
    while room > 0:
        k = min(k, int(np.searchsorted(lengths, room, side="right")))
        at = int(np.searchsorted(open_, k)) - 1
        if at < 0:
            break
        k = int(open_[at])
        pattern[k] = int(min(room // lengths[k], max(1, left[k])))
        room -= pattern[k] * int(lengths[k])
    return pattern


def total_of(pattern: dict[int, int], lengths: np.ndarray) -> int:
    return sum(int(lengths[k]) * a for k, a in pattern.items())


def excess(pattern: dict[int, int], lengths: np.ndarray, size: int) -> float:
    return float(waste(np.array([total_of(pattern, lengths)]), size)[0])


class Program:
    """The linear program: padding of patterns, and `CUT_PRICE` for each item outside of them, at its least, so that every item is taken once.

    A revised simplex with the basis' inverse. It starts from patterns that take
    the longest items first, each used until one of its lengths is exhausted:
    such a basis is triangular.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.lengths, self.counts, self.size = lengths, counts.astype(float), size
        m = len(lengths)
        self.columns: list[dict[int, int]] = [{k: 1} for k in range(m)]
        self.costs, self.patterned = np.full(m, CUT_PRICE), np.zeros(m, dtype=bool)
        left, exhausted = self.counts.copy(), []
        while (left > 0).any():
            pattern = longest_first(lengths, left, size)
            cost = excess(pattern, lengths, size)
            if cost > CUT_PRICE * sum(pattern.values()):  # such items are cut: each row begins with a column for that
                out = max(pattern)
            else:
                out = min(pattern, key=lambda k: left[k] / pattern[k])
                times = left[out] / pattern[out]
                for k, a in pattern.items():
                    left[k] = 0.0 if left[k] - a * times < 1e-9 * self.counts[k] else left[k] - a * times
                self.columns[out], self.costs[out], self.patterned[out] = pattern, cost, True
            left[out] = 0.0
            exhausted.append(out)
        self._invert([*exhausted, *sorted(set(range(m)) - set(exhausted))])

    def _invert(self, order: list[int]) -> None:
        """The inverse of a basis that is triangular in this order: the column of each row has nothing in rows before. Without matrix routines, whose threads may not survive a fork of the driver."""
        m, rows = len(order), [[] for _ in order]
        for j in order:
            for k, a in self.columns[j].items():
                if k != j:
                    rows[k].append((j, a))
        self.inverse = np.zeros((m, m))
        for k in order:
            self.inverse[k, k] = 1.0
            for j, a in rows[k]:
                self.inverse[k] -= a * self.inverse[j]
            self.inverse[k] /= self.columns[k][k]
        self.x = np.maximum(np.einsum("ij,j->i", self.inverse, self.counts), 0.0)
        self.duals = np.einsum("i,ij->j", self.costs, self.inverse)

    def value(self) -> float:
        return float((self.costs * self.x).sum())

    def _enter(self, pattern: dict[int, int], cost: float, patterned: bool) -> bool:
        gain = sum(self.duals[k] * a for k, a in pattern.items()) - cost
        if gain <= 1e-9:
            return False
        step = sum(self.inverse[:, k] * a for k, a in pattern.items())
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            return False
        out = int(up[np.argmin(self.x[up] / step[up])])
        t = self.x[out] / step[out]
        self.x -= t * step
        self.x[out] = t
        np.maximum(self.x, 0.0, out=self.x)
        row = self.inverse[out] / step[out]
        self.duals -= gain * row
        wide, high = np.flatnonzero(row), np.flatnonzero(step)
        self.inverse[np.ix_(high, wide)] -= np.outer(step[high], row[wide])
        self.inverse[out] = row
        self.columns[out], self.costs[out], self.patterned[out] = pattern, cost, patterned
        return True

    def solve(self) -> list[tuple[dict[int, int], float]]:
        """Patterns with how often each is used, after rounds of pricing."""
        material, padding = float((self.counts * self.lengths).sum()), waste(np.arange(self.size + 1), self.size)
        values, rounds = [self.value()], 0
        while len(self.lengths) and (rounds < PATIENCE or values[-1 - PATIENCE] - values[-1] > GAP * material):
            for k in np.flatnonzero(self.duals > CUT_PRICE + 1e-9):
                self._enter({int(k): 1}, CUT_PRICE, False)
            best, last = best_totals(self.lengths, self.duals, self.size)
            gains = best - padding
            gains[0] = -np.inf
            most = float(gains.max())
            # No sequence can bring more than ``most``, and there are never more sequences than items.
            if most <= 1e-7 or most * min(self.counts.sum(), 2 * material / self.size + 1) <= GAP * material:
                break
            for c in np.argsort(-gains)[:COLUMNS]:
                if gains[c] <= 1e-7:
                    break
                pattern, at = {}, int(c)
                while at:
                    k = int(last[at])
                    pattern[k] = pattern.get(k, 0) + 1
                    at -= int(self.lengths[k])
                self._enter(pattern, float(padding[c]), True)
            rounds += 1
            values.append(self.value())
        return [(self.columns[j], float(self.x[j])) for j in np.flatnonzero(self.patterned)]


@dataclass
class Plan:
    """Where the item of a rank of a length goes. Intervals of ranks, ordered by length and rank: ``per`` items in each sequence from ``first`` on, the first at ``offset``; ``per`` = 0: end to end from position ``first``."""

    size: int
    sequences: int
    patterns: int
    cut_tokens: int
    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``per, sequence or position, offset`` of each item."""
        at = np.searchsorted(self.length * (1 << 48) + self.rank, length * (1 << 48) + rank, side="right") - 1
        per, ahead = self.per[at], rank - self.rank[at]
        many = np.maximum(per, 1)
        return per, self.first[at] + np.where(per > 0, ahead // many, ahead * length), self.offset[at] + np.where(per > 0, ahead % many * length, 0)

    def sequence_end(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of positions end to end: the number of the sequence (from `patterns` on), where it begins and where it ends. After the last full sequence come powers of two."""
        full = self.cut_tokens // self.size * self.size
        rest = self.cut_tokens - full
        cuts = np.cumsum([0, *(1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1)]) + full
        tail = np.clip(np.searchsorted(cuts, position, side="right") - 1, 0, max(len(cuts) - 2, 0))
        last = np.append(cuts, cuts[-1])
        in_full = position < full
        return (
            self.patterns + np.where(in_full, position // self.size, full // self.size + tail),
            np.where(in_full, position // self.size * self.size, last[tail]),
            np.where(in_full, position // self.size * self.size + self.size, last[tail + 1]),
        )


def plan(histogram: dict[int, int], size: int) -> Plan:
    """A plan for items of the lengths 1 to ``size`` - 1. What it costs depends on ``size``, not on the counts."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    left, used = counts.copy(), []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[k]) // a for k, a in pattern.items()))
        if times > 0:
            used.append((pattern, times))
            for k, a in pattern.items():
                left[k] -= a * times

    solved = Program(lengths, counts, size).solve() if len(lengths) else []
    for pattern, x in solved:
        use(pattern, int(x + 1e-6))
    for pattern, _ in sorted(solved, key=lambda s: s[1] % 1, reverse=True):
        use(pattern, 1)
    loose = np.zeros_like(left)
    while (left > 0).any():
        pattern = longest_first(lengths, left, size)
        if excess(pattern, lengths, size) <= CUT_PRICE * sum(pattern.values()):
            use(pattern, int(left.max()))
        else:
            k = max(pattern)
            loose[k], left[k] = left[k], 0
    rows, dealt, first = [], np.zeros_like(left), 0
    for pattern, times in used:
        offset = 0
        for k in sorted(pattern, reverse=True):
            rows.append((lengths[k], dealt[k], pattern[k], first, offset))
            dealt[k] += pattern[k] * times
            offset += pattern[k] * lengths[k]
        first += times
    at = 0
    for k in range(len(lengths) - 1, -1, -1):
        if loose[k]:
            rows.append((lengths[k], dealt[k], 0, at, 0))
            at += int(loose[k] * lengths[k])
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    rest = at % size
    return Plan(size, first + at // size + rest.bit_count(), first, at, *(np.ascontiguousarray(table[:, j]) for j in range(5)))


def token_rows(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``row`` (its number: task, then place), ``doc_id, n, ids`` of every whole text."""
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail, context = encoder(tokenizer), np.array([end_id], dtype=kind), TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for whole in batches:
            for batch in slices(whole):
                ids, ends = own.ids(batch.column("text"))
                found = [np.concatenate([ids[a:b], tail]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(batch))), batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["row", "doc_id", "n", "ids"])
                row += len(batch)

    return with_columns_of(documents, doc_id="long", text="string").mapInArrow(run, "row long, doc_id long, n long, ids binary")


def ranks(rows: DataFrame, size: int) -> DataFrame:
    """``row, rank`` (place among the items of its length), ``before`` (full sequences of all rows before it): counted within tasks, then over tasks."""
    items = rows.select("row", F.shiftright("row", 33).alias("block"), (F.col("n") % size).alias("length"), F.floor(F.col("n") / size).cast("long").alias("full"))
    alike = items.groupBy("block", "length").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    offsets = alike.select("block", "length", (F.sum("c").over(Window.partitionBy("length").orderBy("block")) - F.col("c")).alias("ranked"))
    blocks = alike.groupBy("block").agg(F.sum("f").alias("f"))
    starts = blocks.select("block", (F.sum("f").over(Window.orderBy("block")) - F.col("f")).alias("begun"))  # one row a task
    local = items.withColumns({
        "rank": F.row_number().over(Window.partitionBy("block", "length").orderBy("row")) - 1,
        "before": F.sum("full").over(Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full"),
    })
    return local.join(offsets, ["block", "length"]).join(starts, "block").select("row", (F.col("rank") + F.col("ranked")).alias("rank"), (F.col("before") + F.col("begun")).alias("before"))


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut(placed: DataFrame, table: Plan, full: int, kind: str) -> DataFrame:
    """`PIECE` rows; ``ids`` as little-endian unsigned 32-bit integers. ``full``: sequences that stand alone, which are numbered first."""
    size = table.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank, before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "rank", "before"))
            doc, start, length, sequence, offset = [], [], [], [], []

            def add(*parts: np.ndarray) -> None:
                for part, to in zip(parts, (doc, start, length, sequence, offset), strict=True):
                    to.append(part)

            alone = n // size
            inside = np.arange(alone.sum()) - np.repeat(np.cumsum(alone) - alone, alone)
            add(np.repeat(np.arange(len(n)), alone), inside * size, np.full(len(inside), size), np.repeat(before, alone) + inside, np.zeros(len(inside), np.int64))
            item = np.flatnonzero(n % size)
            if len(item):
                per, where, off = table.place(n[item] % size, rank[item])
                whole = per > 0
                rest = n[item] % size
                begin = alone[item] * size
                add(item[whole], begin[whole], rest[whole], full + where[whole], off[whole])
                at, end, begin, item = where[~whole], (where + rest)[~whole], begin[~whole], item[~whole]
                while len(item):
                    number, opens, closes = table.sequence_end(at)
                    stop = np.minimum(end, closes)
                    add(item, begin, stop - at, full + number, at - opens)
                    more = stop < end
                    at, begin, end, item = stop[more], (begin + stop - at)[more], end[more], item[more]
            doc, start, length, sequence, offset = (np.concatenate(x) for x in (doc, start, length, sequence, offset))
            order = np.lexsort([start, doc])
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            flat = [np.frombuffer(x, dtype=kind).astype("<u4") for x in batch.column("ids").to_pylist()]
            ids = [flat[d][s : s + k].tobytes() for d, s, k in zip(doc, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[doc]), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "n", "ids", "rank", "before").mapInArrow(run, PIECE)


def packed(spark: SparkSession, documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``size`` (a power of two) tokens: `PIECE`.

    Null and empty texts have the end id alone. Repeated rows are documents of
    their own (their pieces have the same doc_id); a null doc_id stays null;
    documents of equal length are ranked in the order in which they are read;
    other columns are left behind; an empty table gives no pieces. Documents of
    a sequence or more are cut at its multiples; of the remainders only those
    that no pattern takes are cut. `sequences` puts pieces together.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size: a power of two")
    work, kind = Scratch(spark, "packing"), id_type(tokenizer)
    tokens = work.table("tokens", token_rows(documents, tokenizer, end_id))
    histogram = {r["length"]: r["count"] for r in tokens.groupBy((F.col("n") % size).alias("length")).count().where("length > 0").collect()}  # ``size`` - 1 rows at most
    full = tokens.agg(F.coalesce(F.sum(F.floor(F.col("n") / size)), F.lit(0))).first()[0]
    return cut(tokens.join(ranks(tokens, size), "row"), plan(histogram, size), int(full), kind)


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: whole sequences, padded to ``size`` unless they are a power of two long."""
    listed = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # ``size`` parts at most
    pad = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, 0).otherwise(size - F.col("n_tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), pad))
    return listed.select("sequence_id", "n_tokens", F.concat(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")), padding).alias("ids"))
