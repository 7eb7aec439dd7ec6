"""Reading documents and asking external models, row by row in the workers, with every attempt on record."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class Truncated(Exception):
    """An answer that was cut at its greatest length: another attempt would be cut as well."""


class Failed(Exception):
    """A call that may succeed another time: the service is away or overloaded, or its answer is empty or unreadable."""


def back_off(attempt: int) -> float:
    """Seconds to wait after a failed attempt (counted from 1)."""
    return min(2**attempt, 6)


ATTEMPT = "attempt int, answer string, latency_ms long, error string, last boolean"


def attempted(rows: DataFrame, call: Callable[[dict, int], str], *keys: str, attempts: int = 2, wait: Callable[[int], float] = back_off) -> DataFrame:
    """``keys`` and `ATTEMPT`: one row for each attempt of ``call(row, attempt)`` on each row, up to the first answer.

    A failed attempt is followed by another after a wait, until ``attempts``
    are over; a truncated answer ends them at once. Latency is that of an
    attempt that answered. ``last`` marks the one that settled the row: with an
    answer, or with the error for which the row goes to `quarantined`. Any other
    exception is a fault of ``call`` itself and fails the task, which Spark runs again.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def one(row: dict) -> Iterator[tuple]:
        for attempt in range(1, attempts + 1):
            began = time.perf_counter()
            try:
                answer = call(row, attempt)
                if not (answer or "").strip():
                    raise Failed("empty answer")
            except (Failed, Truncated) as e:
                last = attempt == attempts or isinstance(e, Truncated)
                yield attempt, None, None, str(e), last
                if last:
                    return
                time.sleep(wait(attempt))
            else:
                yield attempt, answer, int((time.perf_counter() - began) * 1000), None, True
                return

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = [(*(row[k] for k in keys), *x) for row in part.astype(object).where(part.notna(), None).to_dict("records") for x in one(row)]
            yield pd.DataFrame(told, columns=[*keys, "attempt", "answer", "latency_ms", "error", "last"]).astype({"latency_ms": "Int64"})

    return rows.mapInPandas(run, f"{kinds}, {ATTEMPT}")


def answered(attempts: DataFrame) -> DataFrame:
    return attempts.where("last and error is null")


def quarantined(attempts: DataFrame) -> DataFrame:
    """Rows that no attempt answered, with the last error and the number of attempts."""
    return attempts.where("last and error is not null").drop("answer", "latency_ms", "last")


def page_rows(files: DataFrame, reader: Callable[[bytes, int], Iterable[tuple[int, str]]], most_pages: int) -> DataFrame:
    """The columns of ``files`` but ``content``, with ``page_number, native_text, error``: a row for each page that ``reader(content, most_pages)`` gives.

    A table function in a lateral join: pages leave the worker as they are read,
    so a document is never held as rows, and the limit goes to the reader, which
    need not read beyond it. What the reader refuses (``ValueError``), and null
    content, give one row with the error and no page.
    """

    @udtf(returnType="page_number int, native_text string, error string")
    class Pages:
        def eval(self, content: bytes, most: int) -> Iterator[tuple[int | None, str | None, str | None]]:
            if content is None:
                yield None, None, "no content"
                return
            try:
                for k, (number, text) in enumerate(reader(bytes(content), most)):
                    if k == most:
                        return
                    yield number, text, None
            except ValueError as e:
                yield None, None, str(e)

    return files.lateralJoin(Pages(F.col("content").outer(), F.lit(most_pages))).drop("content")
