"""What the text operators share: reduced text, script classes and Arrow mapping."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP: np.ndarray | None = None


def reduced(text: Column) -> Column:
    """Lower case, with everything removed but letters, marks and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def keep_table() -> np.ndarray:
    """For each code point, whether it is a letter, mark or digit."""
    global _KEEP
    if _KEEP is None:
        _KEEP = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _KEEP


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def reduce_text(text: str) -> np.ndarray:
    """The code points of the reduced text."""
    cps = code_points(text.lower())
    return cps[keep_table()[cps]]


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` applied to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)
