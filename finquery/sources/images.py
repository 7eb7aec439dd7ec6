"""Measures on page images, for grey pixels that a decoder delivers, and page regions as columns.

Decoding and drawing need an imaging library, which a connector brings; what is
decided from pixels is here, in numpy, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANGLES = (0, 90, 180, 270)


def readability(grey: np.ndarray) -> float:
    """Text runs along rows: the spread of edges over rows against that over columns, weighed by contrast and a page's shape."""
    height, width = grey.shape
    if height < 8 or width < 8:
        return 0.0
    wide = np.pad(grey.astype(np.int32), 1, mode="edge")
    around = sum(wide[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - grey
    edge = np.clip(8 * grey.astype(np.int32) - around, 0, 255) > 40
    return float(edge.sum(axis=1).var() / (edge.sum(axis=0).var() + 1.0) * (1.0 + grey.std() / 80.0) * (1.15 if height / width >= 1.05 else 0.9))


def is_blank(grey: np.ndarray) -> bool:
    """Hardly any contrast, or little on a bright page."""
    spread, light = float(grey.std()), float(grey.mean())
    return (spread < 10.0 and light > 240.0) or spread < 6.0


def content_box(grey: np.ndarray) -> tuple[int, int, int, int]:
    """Left, top, right, bottom of what differs from the corners' median, with a margin; the whole page where that is under 55 percent of a side."""
    height, width = grey.shape
    whole = (0, 0, width, height)
    if min(height, width) < 10:
        return whole
    ground = sorted(int(grey[y, x]) for y in (0, -1) for x in (0, -1))[2]
    rows, columns = np.flatnonzero((grey != ground).any(axis=1)), np.flatnonzero((grey != ground).any(axis=0))
    if not len(rows):
        return whole
    left, right, top, bottom = int(columns[0]), int(columns[-1]) + 1, int(rows[0]), int(rows[-1]) + 1
    if right - left < 0.55 * width or bottom - top < 0.55 * height:
        return whole
    x, y = max(12, width // 100), max(12, height // 100)
    return max(0, left - x), max(0, top - y), min(width, right + x), min(height, bottom + y)


def image_facts(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, n_bytes, blank, scores, box`` of ``pages`` (``doc_id, page_number, width, height, grey``: one byte a pixel, by rows); images under 500 bytes are blank."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                grey = np.frombuffer(r.grey or b"", dtype=np.uint8)
                sound = len(grey) == r.width * r.height and len(grey) > 0
                grey = grey.reshape(r.height, r.width) if sound else np.zeros((1, 1), np.uint8)
                out.append((r.doc_id, r.page_number, len(r.grey or b""), not sound or grey.size < 500 or is_blank(grey), [{"angle": a, "score": readability(np.rot90(grey, k=-(a // 90)))} for a in ANGLES], list(content_box(grey))))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "n_bytes", "blank", "scores", "box"])

    return pages.select("doc_id", "page_number", "width", "height", "grey").mapInPandas(run, "doc_id long, page_number int, n_bytes long, blank boolean, scores array<struct<angle:int,score:double>>, box array<int>")


def region(name: str, top: Column, width: Column, bottom: Column) -> Column:
    return F.struct(F.lit(name).alias("region"), F.lit(0).alias("left"), top.cast("int").alias("top"), width.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def halves(width: Column, height: Column) -> Column:
    """An upper and a lower part of a page that overlap by a tenth, 40 rows at least."""
    lap, middle = F.greatest(F.floor(height * 0.1), F.lit(40)), F.floor(height / 2)
    return F.array(region("top", F.lit(0), width, F.least(height, middle + lap)), region("bottom", F.greatest(F.lit(0), middle - lap), width, height))


def page_layout(width: Column, height: Column) -> Column:
    """The whole page, and two parts that overlap by a twelfth."""
    lap, middle = F.greatest(F.floor(height / 12), F.lit(1)), F.greatest(F.floor(height / 2), F.lit(1))
    return F.array(region("full", F.lit(0), width, height), region("top", F.lit(0), width, F.least(height, middle + lap)), region("bottom", F.greatest(F.lit(0), middle - lap), width, height))
