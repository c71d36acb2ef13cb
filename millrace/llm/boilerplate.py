"""The main body of a page apart from site and file furniture.

Words and shapes of a line have learned weights, body above 0 and furniture below (logistic regression over the lines of
labelled pages, see ``boilerplate_fit``); a line's score is their sum. A line that is surely furniture ends a region; what lies
between is scanned once for its maximal-scoring runs of lines. Runs of enough weight are the page's body, and every other
line is furniture: a doubtful line goes with the lines around it.

Pages are independent, so they stream through Arrow batches without a shuffle; cost is linear in a page's length.
"""

from __future__ import annotations

import json
import math
import os
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WEIGHTS_FILE = os.path.join(os.path.dirname(__file__), "boilerplate_weights.json")
#: Score at or below which a line ends a region, least weight of a run that is body, and the most that one line adds to its run.
SURE, LEAST, MOST = -1.5, 0.5, 8.0
#: Page numbers, and heads or feet that files repeat on each page.
PAGE = re.compile(r"(?i)(- ?0 ?-|(page|seite|página|стр\.|p\.) ?0( (of|sur|von|de|из|/) ?0)?|0 ?/ ?0|0 \| \S.{0,80}|\S.{0,80} \| 0|0)$")
HEAD = [re.compile(p) for p in (r"(?i)rfp 0-0$", r"(?i)rev\. 0( / 0)?$", r"(?i)confidential( - draft)?$", r"(?i)form [a-z]-0$", r"(?i)\S.{2,60} purchasing division$")]
_SPLIT = re.compile(r"\s*[|·•»›>/]\s*|\s{2,}|\s*\t\s*")
_SEPARATOR = re.compile(r"[|·•»›>/\t]|  ")
_BULLET = re.compile(r"^[•·▪◦*-]\s+")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_MONEY, _ITEM, _LINK = re.compile(r"[$€£¥]"), re.compile(r"[-*•▪◦–]|\(?(?:\d+|[a-z]{1,2})[.)]"), re.compile(r"://|@|\bwww\.")
_TRIM = " \t\r\v\f\u00a0\u3000\u200b\ufeff"
_STOP = ".。।"
#: Longest line, in code points, that is a feature as a whole.
WHOLE = 80


@cache
def weights() -> dict[str, float]:
    with open(WEIGHTS_FILE, encoding="utf-8") as f:
        return json.load(f)


def stripped(text: str) -> list[str]:
    return [x.strip(_TRIM) for x in text.split("\n")]


def line_features(line: str, head: bool) -> tuple[set[str], set[str], set[str]]:
    """Features of a stripped line in three groups: its shape and the line as a whole, its items, its words and pairs of words. Digits count as 0."""
    plain = _DIGITS.sub("0", line)
    low = plain.lower()
    bare = _BULLET.sub("", low)
    items = [x for x in _SPLIT.split(bare) if x] if _SEPARATOR.search(bare) else []
    words, dense = _LETTERS.findall(low), "".join(_DENSE.findall(low))
    if dense:
        words = [w for w in words if not _DENSE.match(w)]
    n, k = max(low.count(" ") + 1, len(dense) // 3), len(items)
    one = {"#bias", "#n" + ("1" if n <= 1 else "2" if n == 2 else "4" if n <= 4 else "8" if n <= 8 else "16" if n <= 16 else "99")}
    if k > 1:
        one.add("#items2" if k == 2 else "#items4" if k <= 4 else "#items9")
        if len(plain) < 20 * k:
            one.add("#short")
    last = plain[-1]
    if last in ".!?。।؟！？":
        one.add("#stop")
    elif last in ":,;،、":
        one.add("#" + last)
    for name, on in (("#digit", "0" in plain), ("#item", _ITEM.match(line)), ("#copy", plain[0] == "©"), ("#money", _MONEY.search(plain)), ("#lower", plain[0].islower()), ("#link", _LINK.search(plain)), ("#head", head)):
        if on:
            one.add(name)
    if len(bare) <= WHOLE:
        one.add("=" + bare.rstrip(_STOP))
    said = set(words)
    said.update(map("{} {}".format, words, words[1:]))
    said.update(dense[i : i + 2] for i in range(len(dense) - 1))
    return one, {"=" + x.rstrip(_STOP) for x in items} if k > 1 else set(), said


def group_scales(groups: tuple[set[str], set[str], set[str]]) -> tuple[float, float, float]:
    """Many items or words count by the root of their number, so that a long line's score doesn't grow with its length."""
    return 1.0, 1.0 / math.sqrt(max(1, len(groups[1]))), 1.0 / math.sqrt(max(1.0, len(groups[2]) / 4))


@lru_cache(200_000)
def line_score(line: str, head: bool = False) -> float:
    """Learned score of a stripped line: body above 0, furniture below."""
    groups, known = line_features(line, head), weights()
    return sum(s * sum(known.get(f, 0.0) for f in g) for g, s in zip(groups, group_scales(groups), strict=True))


def head_lines(lines: list[str]) -> set[int]:
    """Places of page numbers and of the lines that are repeated next to them, among stripped lines."""
    full = [i for i, x in enumerate(lines) if x]
    shape = {i: _DIGITS.sub("0", lines[i]).lower() for i in full if len(lines[i]) <= 90}
    rising, last = [], 0
    numbers = [i for i in full if i in shape and PAGE.match(_DIGITS.sub("0", lines[i]))]
    for i in numbers:
        value = int(_DIGITS.search(lines[i]).group()[:6])
        if value == last + 1 or (not lines[i].isdigit() and value > last):
            rising.append(i)
            last = value
    if len(rising) < 2 and all(lines[i].isdigit() for i in rising):
        rising = [i for i in rising if last == 1 and i == full[-1]]
    found = set(rising)
    times: dict[str, int] = {}
    for s in shape.values():
        times[s] = times.get(s, 0) + 1
    place = {i: k for k, i in enumerate(full)}
    edge = {j for i in found for j in full[max(0, place[i] - 1) : place[i] + 2]}
    if found:
        edge.add(full[0])
    beside: dict[str, bool] = {}
    for i, s in shape.items():
        beside[s] = beside.get(s, True) and i in edge
    ends = {*full[:1], *full[-1:]}
    for i, s in shape.items():
        if i in found:
            continue
        plain = _DIGITS.sub("0", lines[i])
        if any(h.match(plain) for h in HEAD):
            if i in edge or times[s] > 1 or i in ends or len(s) < 30:
                found.add(i)
        elif rising and beside[s] and times[s] >= max(2, min(3, len(rising))) and len(s) <= 60:
            found.add(i)
    return found


def best_region(score: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the greatest sum (the first such), or (0, -1) if none is positive."""
    best, at, run, start = 0.0, (0, -1), 0.0, 0
    for i, x in enumerate(score):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, at = run, (start, i)
    return at


def body_regions(score: list[float]) -> list[tuple[int, int]]:
    """Maximal-scoring runs of lines in order of place (Ruzzo and Tompa): the best run, and what further runs the lines outside it hold."""
    runs: list[tuple[float, float, int, int]] = []  # sum before, sum at the end, first, last
    total = 0.0
    for i, x in enumerate(score):
        before, total = total, total + x
        if x <= 0:
            continue
        new = (before, total, i, i)
        while True:
            j = next((j for j in range(len(runs) - 1, -1, -1) if runs[j][0] < new[0]), -1)
            if j < 0 or runs[j][1] >= new[1]:
                break
            new = (runs[j][0], new[1], runs[j][2], i)
            del runs[j:]
        runs.append(new)
    return [(r[2], r[3]) for r in runs]


def furniture_lines(text: str | None) -> list[int]:
    """Numbers (from 1, blank lines counted) of the non-blank lines that are furniture: those outside the body's regions."""
    if not text or not text.strip(_TRIM + "\n"):
        return []
    lines = stripped(text)
    heads = head_lines(lines)
    score = [min(MOST, line_score(x, i in heads)) if x else 0.0 for i, x in enumerate(lines)]
    body: set[int] = set()
    begin = 0
    for end in [*(i for i, s in enumerate(score) if s <= SURE), len(score)]:
        for a, z in body_regions(score[begin:end]):
            if sum(score[begin + a : begin + z + 1]) >= LEAST:
                body.update(range(begin + a, begin + z + 1))
        begin = end + 1
    return [i + 1 for i, x in enumerate(lines) if x and i not in body]


def find_furniture(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """Rows (``key``, line_no INT) of the furniture lines of ``pages``; NULL, empty and blank texts have none, repeated rows give theirs again."""

    def run(batches):
        for batch in batches:
            lines = [furniture_lines(t) for t in batch.column(1).to_pylist()]
            index = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            values = np.fromiter((x for y in lines for x in y), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(values, pa.int32())], names=[key, "line_no"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, line_no int")


def body(text: str | None) -> str | None:
    """``text`` without its furniture lines, or NULL for NULL."""
    if text is None:
        return None
    gone = set(furniture_lines(text))
    return "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone)


def bodies(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """Rows (``key``, body STRING), one for each row; see ``body``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([body(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "body"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, body string")
