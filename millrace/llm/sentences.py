"""Sentence units of texts in any script.

The standard character-property rules of sentence breaking (a terminator, then closing marks, then spaces; no break
before lower case, inside numbers or between upper-case letters and their dots) with the terminators of all scripts,
tailored in four ways: abbreviations that never, or only before a number, or only sometimes end a sentence; paired
quotation marks and brackets, within which nothing breaks; scripts that end sentences by a space; and lines, where a
break is either a wrapped line's or a unit's end.

Texts are independent of each other, so they stream through Arrow batches without a shuffle. A text's cost is linear
in its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations in lower case without the last dot; ``OWN`` tells which belong to one language only.
#: Never end a sentence: titles, references and words that need what follows.
NEVER = set(
    "mr mrs ms mx dr dra sr sra srta lic ing prof st ft mt lt col gen sgt capt cpt maj rev hon gov sen rep pres supt messrs mme mlle mm mgr vgl bzw fr hr dipl med med.dent "
    "z d.h z.b u.a e.g i.e eg ie vs cf viz al approx ca c.-à-d p.ex ee г-н г-жа т.е т.к напр гр ดร นาย د أ डॉ श्री श्रीमती प्रो".split()
)
#: End a sentence unless a number follows.
BEFORE_NUMBER = set(
    "no nos nr nrn núm num n p pp pág págs pag sec secs sect ste ext fig figs vol ch chap cap art arts abs par para add tel rm bldg apt line lot item ref "
    "jan feb mar apr jun jul aug sep sept oct nov dec п пп стр ст гл рис табл सं क्र ข้อ เลขที่".split()
)
#: End a sentence only before a capital letter or an opening mark.
SOMETIMES = set(
    "suiv ss ff sqq inc corp co ltd llc plc gmbh bros jr esq etc usw uu u.s u.k u.n e.u d.c a.m p.m m.d ph.d r.n d.o m.p.h b.a m.a ave blvd rd hwy dept dist assn bldgs mon tue tues wed thu thur thurs fri sat sun "
    "est min max avg misc incl excl руб тыс млн млрд др пр т.д т.п g kg km cm mm hrs hr mins".split()
)
#: Abbreviations of one language: in a text tagged with another language of this table they are words.
OWN = {
    "de": set("vgl bzw hr dipl med.dent z d.h z.b u.a usw uu nr abs nrn".split()),
    "fr": set("mme mlle mm mgr c.-à-d p.ex suiv".split()),
    "es": set("sra srta lic ing pág págs núm".split()),
    "en": set("messrs supt sgt capt cpt hon bldg rm hwy dept dist assn bros thurs tues".split()),
}
#: Words that begin a sentence rather than a name.
_STARTS = set("the a an it he she we they you i this that these those there in on at for if but and our my his her its das der die es il elle le la les el los las".split())
_OWNER = {w: k for k, ws in OWN.items() for w in ws}
GERMAN_MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split()

_OPEN = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}
_CLOSE = set("”“»›」』）)]】》\"'’")
_FRENCH = {" »", "\u00a0»", "\u202f»"}

#: Terminators of all scripts, by the standard's Sentence_Break property: STerm, and ATerm but the full stop. Full-width stops may stand in numbers.
_ALL = "".join(chr(c) for c in range(0x80, 0x1F000) if not 0xD800 <= c <= 0xDFFF)
_FULL = set(regex.findall(r"\p{Sentence_Break=STerm}|\p{Sentence_Break=ATerm}", _ALL)) | set("。！？｡।॥؟۔")
_NUMERIC = set("．﹒․")
_ENDS = re.escape(".!?…" + "".join(sorted(_FULL)))
_PAIRED = r"[“”„«»‹›「」『』（）()\[\]【】《》\"]"
_TOKEN = re.compile(rf"[{_ENDS}]+|{_PAIRED}")
#: The same for texts within the first plane, whose class is one table look-up.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_PLAIN = re.compile(rf"[{_ASTRAL.sub('', _ENDS)}]+|{_PAIRED}")
_TERMINATORS = ".!?…" + "".join(_FULL)
_LINE = re.compile(r"[^\n\r\v\f\x85  ]+")
_BLANK = re.compile(r"[\s​﻿]*")
_MARKER = re.compile(r"\s*(?:[-*•‣◦▪–—·]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,4}[.)])\s+")
_TABLE = re.compile(r"\|.*\||\t.*\t")
_SEPARATED = re.compile(r"\s{2,}|\s+[|·•>»›/]\s+|\s*\|\s*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[  ]+(?=[฀-๿])")
_WORD = re.compile(r"[^\s\"“”„«»‹›「」『』（）()\[\]【】《》]*$")
_ROMAN = re.compile(r"(?=[IVXLC])X{0,3}(?:IX|IV|V?I{0,3})(?:\([a-z0-9]\))?(?![A-Za-z])")
_LOWER_NAME = re.compile(r"[a-z]-[a-z]|[a-z][A-Z]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
#: Thai has no sentence mark: a space between two Thai letters ends a unit if both sides are at least so long.
THAI_LEAST = 14


def _wrap_width(lines: list[tuple[str, int, int]]) -> int:
    """Width to which the text's lines were wrapped, or 0: a break is a wrapped line's if the next line's first word no longer fitted."""
    lengths = [len(s) for s, _, _ in lines]
    within = [n for n in lengths if n <= 120]
    if len(within) < 3 or len(within) < 0.8 * len(lengths):
        return 0
    width = max(within)
    if width < 30:
        return 0
    fits = wraps = 0
    for (s, _, gap), (t, _, _) in zip(lines, lines[1:], strict=False):
        first = t[:1]
        if gap or s[-1] in _TERMINATORS or not (first.islower() or (first.isalpha() and not first.isupper())) or _CJK.match(first) or "฀" <= first <= "๿":
            continue
        if len(s) <= width < len(s) + 1 + len(t.split(None, 1)[0]):
            wraps += 1
        else:
            fits += 1
    return width if wraps >= 1 and wraps >= 1.5 * fits else 0


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans of one or more lines within which line breaks are only wrapped lines'."""
    lines: list[tuple[str, int, int]] = []  # stripped line, its start, blank lines before the next
    last = 0
    for m in _LINE.finditer(text):
        raw = m.group()
        s = raw.strip(" \t 　​﻿\x1c\x1d\x1e\x1f")
        if not s or not s.strip():
            continue
        at = m.start() + raw.index(s[0])
        if lines and text.count("\n", last, at) > 1:
            lines[-1] = (lines[-1][0], lines[-1][1], 1)
        lines.append((s, at, 0))
        last = at + len(s)
    if not lines:
        return []
    width = _wrap_width(lines)
    spans = []
    for i, (s, at, _) in enumerate(lines):
        joined = False
        if width and spans:
            p, _, gap = lines[i - 1]
            joined = not gap and len(p) <= width < len(p) + 1 + len(s.split(None, 1)[0]) and not _MARKER.match(s) and not _TABLE.search(s) and not _TABLE.search(p)
        if joined:
            spans[-1] = (spans[-1][0], at + len(s))
        else:
            spans.append((at, at + len(s)))
    return spans


def _pairs(tokens: list[tuple[int, str]], text: str) -> dict[int, int]:
    """Place of each opening mark that is closed, with the place of its closing mark, however far. A straight mark opens only before a letter and after none (6" is no quotation)."""
    out, stack, straight = {}, [], None
    for at, mark in tokens:
        if mark == '"':
            if straight is not None:
                out[straight] = at
                straight = None
            elif not text[at - 1 : at].isalnum() and not text[at + 1 : at + 2].isspace():
                straight = at
        elif stack and mark == _OPEN[stack[-1][1]]:
            o, _ = stack.pop()
            out[o] = at
        elif mark in _OPEN:
            stack.append((at, mark))
    return out


def _ends(word: str, before: str, nxt: str, rest: str, lang: str = "") -> bool:
    """Whether a dot after ``word`` ends a sentence of language ``lang``, a space and ``nxt`` following."""
    low = word.lower().lstrip("'’-–—")
    if low[:2] in ("l'", "d'", "l’", "d’"):
        low = low[2:]
    number = nxt.isdigit() or nxt == "№" or bool(_ROMAN.match(rest))
    upper = nxt.isupper() or nxt in "\"“„«‹「(（[¿¡" or (nxt.isalpha() and not nxt.islower()) or bool(_LOWER_NAME.match(rest))
    if lang in OWN and _OWNER.get(low, lang) != lang:
        return upper or low.isalpha() and len(low) >= 4
    if low in ("st", "ft", "mt") and upper and not number:  # a street or fort after its name ends, a saint before one doesn't
        name = before.rstrip().rpartition(" ")[2]
        return len(name) > 1 and name.isalpha() and name[0].isupper() and rest.split(None, 1)[0].lower() in _STARTS
    if low == "al":
        return upper and not before.rstrip().lower().endswith("et")
    if low in NEVER:
        return False
    if low in BEFORE_NUMBER:
        if number:
            return False
        if low in ("p", "n") and nxt.islower():
            return False
        return upper or len(low) > 3
    if len(word) == 1 and word.isalpha():
        if word == "m" and before.rstrip().lower().endswith(("a.", "p.")):
            return upper
        if word == "г" and before.rstrip()[-1:].isdigit():
            return upper
        return word.islower() and word.isascii() and upper and not number  # else an initial
    if low in SOMETIMES:
        return upper and not number
    if "." in low and len(low) <= 6 and all(len(x) <= 2 for x in low.split(".")) and not low[0].isdigit():
        return upper and not number
    if word.isdigit() and len(word) <= 2 and rest.split(None, 1)[0].strip(".,").lower() in GERMAN_MONTHS:
        return False
    if nxt.islower() and not upper:
        return len(low) >= 4 and low.isalpha()
    return True


def _split(text: str, start: int, end: int, out: list[int], lang: str = "") -> None:
    """Appends the starts of the units of text[start:end], which begins with no space."""
    out.append(start)
    found = [(m.start(), m.group()) for m in (_TOKEN if _ASTRAL.search(text, start, end) else _PLAIN).finditer(text, start, end)]
    thai = None
    if "฀" <= text[start] <= "๿" or _THAI_GAP.search(text, start, end):
        thai = [m.end() for m in _THAI_GAP.finditer(text, start, end)]
        items = [x for x in _SEPARATED.split(text[start:end]) if x]
        if len(items) > 2 and max(map(len, items)) <= 24:
            return
    if not found and not thai:
        return
    marker = _MARKER.match(text, start, end)
    skip = marker.end() if marker else start
    pairs = _pairs([x for x in found if x[1][0] not in _TERMINATORS], text) if len(found) > 1 else {}
    opens = {c: o for o, c in pairs.items()}
    inside = sorted(pairs.items())
    breaks, begun, k, until = [], start, 0, -1
    for at, mark in found:
        while k < len(inside) and inside[k][0] < at:
            until = max(until, inside[k][1])
            k += 1
        if mark[0] not in _TERMINATORS or at < skip:
            continue
        e = at + len(mark)
        q, opened = e, None
        if text[e : e + 2] in _FRENCH:
            q, opened = e + 2, opens.get(e + 1)
        while q < end and text[q] in _CLOSE:
            if q in opens:
                opened = opens[q]
            elif text[q] == '"' or text[q] in _OPEN:
                break
            q += 1
        if until >= q or q >= end:
            continue  # inside a pair that goes on, or the end anyway
        b = _BLANK.match(text, q, end).end()
        if b >= end:
            continue
        nxt, gap = text[b], b - q
        if nxt in ",;:、，；：)）]】”»」』→":
            continue
        if nxt in "—–-" and not (gap and (text[b + 1 : b + 2].isupper() or text[b + 1 : b + 2] in ("¿", "¡", "«", "“"))):
            continue  # a dash goes on with the sentence unless it opens someone's words
        if opened is not None and opened == begun and gap == 0 and _CJK.match(nxt):
            continue  # a quotation that begins the sentence, whose speaker follows
        kind = mark[-1]
        starts_upper = not nxt.islower() or bool(_LOWER_NAME.match(text, b, min(end, b + 4)))
        if mark[0] in _FULL or kind in _FULL:
            good = not (kind in _NUMERIC and text[at - 1 : at].isdigit() and nxt.isdigit() and not gap)
        elif "…" in mark or mark.count(".") > 1 and "!" not in mark and "?" not in mark:
            good = gap > 0 and starts_upper
        elif "!" in mark or "?" in mark:
            good = (gap > 0 and (starts_upper or q == e)) or (gap == 0 and (nxt.isupper() or nxt in "¿¡" or bool(_CJK.match(nxt))) and text[at - 1].isalpha() and "/" not in _WORD.search(text, max(start, at - 60), at).group())
        else:
            word = _WORD.search(text, max(begun, text.rfind(" ", begun, at)), at).group()
            if not word and q == e:
                if at == begun or text[at - 1].isspace():
                    continue
                word = "x" * 4
            if gap:
                good = q > e and starts_upper if q > e else _ends(word, text[max(begun, at - len(word) - 40) : at - len(word)], nxt, text[b : b + 24], lang)
                if q > e and good and word.lower() in NEVER:
                    good = False
            else:
                plain = word.rpartition(".")[2]
                good = nxt.isupper() and text[b + 1 : b + 2].islower() and ((len(plain) > 1 and (plain[-1].islower() or plain[-1].isdigit() or plain[-1] == "%") and plain.lower() not in NEVER) or q > e)
                good = good and not any(x in word for x in ("://", "@", "www.", "/")) and word.count(".") <= 1
                good = good or bool(_CJK.match(nxt))
        if good:
            breaks.append(b)
            begun = b
    if thai:
        fixed = sorted({start, end, *breaks})
        for b in thai:
            i = np.searchsorted(fixed, b)
            lo = fixed[i - 1] if fixed[i] != b else None
            if lo is None:
                continue
            nexts = [x for x in thai if x > b and x < fixed[i]]
            hi = nexts[0] if nexts else fixed[i]
            if b - lo >= THAI_LEAST and hi - b >= THAI_LEAST and text[lo:b].rstrip()[-1:] != ".":
                fixed.insert(i, b)
        breaks = fixed[1:-1]
    out.extend(breaks)


def unit_starts(text: str | None, lang: str | None = None) -> list[int]:
    """Offsets of the first characters of the sentence units; a NULL or blank text has none. ``lang`` is a tag as found; unknown ones suppress the abbreviations of all languages."""
    out: list[int] = []
    code = (lang or "").strip().lower()[:2]
    if text:
        for a, b in _blocks(text):
            _split(text, a, b, out, code)
    return out


def sentence_starts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """Rows (``key``, start_char INT), one for each sentence unit; offsets in code points from 0.

    Headings, list items, table rows and other lines are units of their own; a list marker belongs to its item. NULL,
    empty and blank texts have no unit. A repeated row gives its units again. ``lang`` names the column of the texts' language
    tags, if there is one. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            starts = [unit_starts(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            index = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
            values = np.fromiter((x for s in starts for x in s), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(values, pa.int32())], names=[key, "start_char"])

    kind = dict(docs.dtypes)[key]
    tag = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    return docs.select(key, text, tag.alias("__lang")).mapInArrow(run, f"`{key}` {kind}, start_char int")
