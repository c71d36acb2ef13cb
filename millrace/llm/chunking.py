"""Splitting long texts at natural boundaries, by content-defined landmarks.

A rolling hash over a window of code points marks landmarks, whose places depend only on the text around them. A
piece ends at the natural boundary (paragraph, line, sentence, word, in this order) nearest to the first landmark
after its minimum size. So after an edit the cuts fall back into step with the old ones, and only pieces near the
edit change.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

WINDOW = 32
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, name: str, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        seq = np.full(max(n, 65_536), base, np.uint64)
        seq[0] = 1
        _POWERS[name] = np.cumprod(seq, dtype=np.uint64)
    return _POWERS[name][:n]


def landmarks(text: str, one_in: int) -> np.ndarray:
    """Offsets after which the hash of the ``WINDOW`` code points before has its top bits clear (one place in ``one_in``)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    if n < WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.cumsum(codes * _powers(_INVERSE, "down", n), dtype=np.uint64)
        window = sums[WINDOW - 1 :].copy()
        window[1:] -= sums[: n - WINDOW]
        h = window * _powers(_BASE, "up", n)[WINDOW - 1 :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(16)) % np.uint64(one_in) == 0) + WINDOW


#: Natural boundaries, best first: a cut falls right after the match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡।؟۔॥។၊။]+[”’»」』）]*\s*"),
    re.compile(r"\s+"),
]
_MARK = re.compile(r"[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎ً-ٟ‍️]")


def cuts(text: str, limit: int, overlap: int, least: int, one_in: int) -> list[int]:
    """Ends of the pieces, the last being ``len(text)``; each piece with its overlap is at most ``limit`` long."""
    ends, start, n = [], 0, len(text)
    marks = landmarks(text, one_in)
    levels = [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in BOUNDARIES]
    while n - start > limit - (overlap if start else 0):
        low, high = start + least, start + limit - (overlap if start else 0)
        i = np.searchsorted(marks, low)
        aim = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        reach = max(64, (limit - least) // 4)
        cut = 0
        for places in levels:
            a, b = np.searchsorted(places, max(low, aim - reach)), np.searchsorted(places, min(high, aim + reach), "right")
            if a < b:
                near = places[a:b]
                cut = int(near[np.argmin(np.abs(near - aim))])
                break
        if not cut:
            for places in levels:
                b = np.searchsorted(places, high, "right")
                if b and places[b - 1] >= low:
                    cut = int(places[b - 1])
                    break
        if not cut:
            cut = aim
            while cut > low and _MARK.match(text, cut):
                cut -= 1
        ends.append(cut)
        start = cut
    ends.append(n)
    return ends


def split_long(docs: DataFrame, limit: int = 4000, overlap: int = 200, least: int = 1200, one_in: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, piece_no INT from 0, start_char INT, end_char INT, piece STRING), offsets in code points.

    ``piece`` is text[start_char:end_char] and is at most ``limit`` long. Each piece after the first begins ``overlap``
    code points before the end of the one before, so that pieces without their overlaps join to the text exactly.
    A text within the limit, the empty one too, is one piece; NULL gives no row; repeated rows give repeated pieces.
    Only texts over the limit reach Python, which returns offsets; the JVM cuts the pieces.
    """
    if not 0 <= overlap < least < limit - overlap:
        raise ValueError("need 0 <= overlap < least < limit - overlap")
    kind = ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())]))

    @F.pandas_udf(kind)
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ends = cuts(t, limit, overlap, least, one_in)
            out.append([{"s": max(0, a - overlap) if a else 0, "e": b} for a, b in zip([0, *ends], ends, strict=False)])
        return pd.Series(out)

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__t")).where(F.col("__t").isNotNull())
    short = rows.where(F.length("__t") <= limit).select(key, F.lit(0).alias("piece_no"), F.lit(0).alias("start_char"), F.length("__t").alias("end_char"), F.col("__t").alias("piece"))
    long = rows.where(F.length("__t") > limit).select(key, "__t", F.posexplode(spans("__t")).alias("piece_no", "p"))
    long = long.select(key, "piece_no", F.col("p.s").alias("start_char"), F.col("p.e").alias("end_char"), F.col("__t").substr(F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias("piece"))
    return short.unionByName(long)
