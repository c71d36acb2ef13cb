"""Pages of stuffed keywords, link lists and product rows.

The words of every different text are counted and ranked with a SQL window, and a line is fitted through its
rank-frequency curve in logarithms: its slope, how far the curve is from it (residual), the share of different words, the
share of the most frequent word of content (spike), and the divergence from prose: the mean, over a text's words, of
the share of its language's texts that contain the word. Each is compared with the quartile of the texts of the same
language and length at which prose lies, and a logistic function of these ten figures and the length (``WEIGHTS``, fitted
to labelled rows by ``stuffing_fit``) gives the odds that the text is stuffed.

The curve decides wherever the odds are clear (98 % of texts). Only texts between ``NO`` and ``YES`` are read unit by unit
(``is_stuffed``).

Equal texts are judged once. A text's words are counted within its own partition after one shuffle of the texts, so
neither the counts nor the window move data again. What is broadcast is bounded: a language's core has at most
``1 / SHARE`` times as many words as its texts have different words on average, since each of its words is in a share of
``SHARE`` of them, and there are at most 676 two-letter codes; a core of more than ``BROADCAST`` words is joined by a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.sentences import unit_starts
from millrace.sources.staging import staged

#: Share of a language's texts that have a word of its core; words of all cores that are broadcast at most; fewest words of a stuffed text.
SHARE, BROADCAST, LEAST = 0.04, 1_000_000, 5
#: Fitted by ``stuffing_fit``: of each figure and its square, of these times the length's logarithm, and the constant.
WEIGHTS = [
    -1.709, -1.0438, 0.11805, 0.14856, 1.1096, -0.065504, 0.36516, -14.27, -19.496, -0.96008, -6.6438, 5.9326, -0.23823, -1.6747, 8.7789, -0.51526, -26.474, 10.465, -9.5483, -1.9944, 1.5296, -0.062559,
    -0.79666, 0.50094, -0.17445, 0.025372, 0.2208, -0.19777, -3.3076, 3.0482, 2.2775, 0.44262, -1.6064, -0.65864, -0.19611, -0.007475, 1.5286, 1.7444, 7.3834, 3.1497, -0.26664, 1.6078, -0.062559, -0.031248, -1.6029,
]
#: Odds, as a probability, up to which a text is not stuffed and from which it is.
NO, YES = 0.01, 0.985
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}"
#: Words; scripts without spaces give runs of two or three characters of one script.
WORD_JAVA = (
    r"[a-z0-9]++(?![\p{L}\p{M}\p{N}])|"  # most words, without the costly class
    rf"[\p{{IsHan}}]{{1,2}}|[\p{{IsHiragana}}]{{1,3}}|[\p{{IsKatakana}}ー]{{1,4}}|[\p{{IsThai}}]{{1,3}}|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SPACELESS}]]++"
)
WORD_PYTHON = r"(?V1)\p{Han}{1,2}|\p{Hiragana}{1,3}|[\p{Katakana}ー]{1,4}|\p{Thai}{1,3}|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]]+"
# Three-letter language codes and their two-letter ones.
CODES = {"eng": "en", "fra": "fr", "fre": "fr", "ger": "de", "deu": "de", "spa": "es", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "ara": "ar", "tha": "th", "hin": "hi"}


def language_code(lang: Column) -> Column:
    """Two-letter code of a language tag as found (``EN``, ``ru-XX``, ``ger``), NULL for none."""
    base = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    short = F.coalesce(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[base], base)
    return F.when(F.length(short) == 2, short)


def text_key(text: Column) -> list[Column]:
    """Two hashes that together tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.hash(text, F.length(text)).alias("k2")]


def different(pages: DataFrame) -> DataFrame:
    """(k1, k2, page, lang): the least page of each different text that isn't NULL, and a language it is tagged with."""
    keyed = pages.where(F.col("text").isNotNull()).select(*text_key(F.col("text")), "page", "lang")
    return keyed.groupBy("k1", "k2").agg(F.min("page").alias("page"), F.max("lang").alias("lang"))


def word_counts(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """(page, lang, word, n, place) of the texts whose first page is in ``firsts``: each word's count and its place in the text's ranking.

    The texts move once, hashed by page; counting and ranking then stay within a page's partition.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD_JAVA), F.lit(0))
    texts = pages.select("page", "text").join(firsts.select("page", "lang").hint("shuffle_hash"), "page")
    counts = texts.select("page", "lang", F.explode(words).alias("word")).groupBy("page", "lang", "word").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "word")))


def prose_core(counts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(word, shares MAP<lang, share>): the words that a share of ``SHARE`` or more of a language's different texts have, over all texts and languages."""
    df = counts.where(F.col("lang").isNotNull() & ~F.col("word").rlike(r"^\d+$")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    sizes = firsts.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    kept = df.join(F.broadcast(sizes), "lang").select("lang", "word", (F.col("df") / F.col("texts")).alias("share")).where(F.col("share") >= SHARE)  # sizes: at most 676 rows
    return kept.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("shares"))


def curves(counts: DataFrame, core: DataFrame) -> DataFrame:
    """One row a text: words, types, ttr, slope, residual, spike, prose (mean share in the language that fits best) and fit (that language)."""
    n = core.count()
    langs = sorted(r[0] for r in core.select(F.explode(F.map_keys("shares"))).distinct().collect())  # at most 676
    table = core.select("word", F.array(*[F.coalesce(F.col("shares")[x], F.lit(0.0)) for x in langs] or [F.lit(0.0)]).alias("shares"))
    table = table.withColumn("common", F.array_max("shares"))
    ranked = counts.join(F.broadcast(table) if n <= BROADCAST else table, "word", "left")
    ranked = ranked.withColumns({"x": F.ln(F.col("place").cast("double")), "y": F.ln(F.col("n").cast("double"))})
    fits = [F.coalesce(F.sum(F.get("shares", F.lit(i)) * F.col("n")), F.lit(0.0)) for i in range(max(1, len(langs)))]
    common = F.coalesce("common", F.lit(0.0))
    sums = {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    made = ranked.groupBy("page").agg(
        F.sum("n").alias("words"), F.count(F.lit(1)).alias("types"), *[F.sum(c).alias(k) for k, c in sums.items()],
        F.max(F.when((common < 0.3) & ~F.col("word").rlike(r"^\d+$"), F.col("n"))).alias("top"), F.array(*fits).alias("fits"),
    )
    k = F.col("types")
    sxx, sxy, syy = F.col("xx") - F.col("sx") * F.col("sx") / k, F.col("xy") - F.col("sx") * F.col("sy") / k, F.col("yy") - F.col("sy") * F.col("sy") / k
    slope = F.when(k > 1, sxy / F.nullif(sxx, F.lit(0.0)))
    made = made.withColumns({"slope": F.coalesce(slope, F.lit(0.0)), "residual": F.sqrt(F.greatest(F.lit(0.0), syy - F.coalesce(sxy * slope, F.lit(0.0)))) / F.sqrt(k.cast("double"))})
    best = F.array_max("fits")
    fit = F.get(F.array(*[F.lit(x) for x in langs or ["und"]]), (F.array_position("fits", best) - 1).cast("int"))
    return made.select(
        "page", "words", "types", (F.col("types") / F.col("words")).alias("ttr"), "slope", "residual",
        (F.coalesce("top", F.lit(0)) / F.col("words")).alias("spike"), (best / F.col("words")).alias("prose"), fit.alias("fit"),
    )


#: Quartile of each figure at which the prose of a class lies.
SIDE = {"prose": 0.75, "spike": 0.25, "ttr": 0.75, "slope": 0.75, "residual": 0.25}


def compared(rows: DataFrame) -> DataFrame:
    """``curves`` with the eleven figures of each text, ``v0`` to ``v10``: against the class of its language and length (powers of two of its words), as they are, and the length's logarithm."""
    rows = rows.withColumn("size", F.floor(F.log2("words")))
    norm = rows.groupBy("fit", "size").agg(*[F.percentile_approx(c, q, 1000).alias("q_" + c) for c, q in SIDE.items()])
    rows = rows.join(F.broadcast(norm), ["fit", "size"])  # languages x powers of two of a text's words: bounded
    ratio = lambda c, d: F.ln((F.col(c) + d) / (F.col("q_" + c) + d))
    v = [ratio("prose", 0.02), ratio("spike", 0.005), ratio("ttr", 0.01), F.col("slope") - F.col("q_slope"), F.col("residual") - F.col("q_residual")]
    v += [F.col(c) for c in ("prose", "slope", "residual", "spike", "ttr")] + [F.ln("words")]
    return rows.select("page", "words", "fit", *[x.cast("double").alias(f"v{i}") for i, x in enumerate(v)])


#: Columns of the figures.
FIGURES = [f"v{i}" for i in range(11)]


def odds(figures: list[Column]) -> Column:
    """Probability that a text of these figures is stuffed: logistic in the figures and their squares, each alone and times the length's logarithm, the last figure."""
    n, last, z = len(figures), figures[-1], F.lit(WEIGHTS[-1])
    for i, x in enumerate(figures):
        a, b, c, d = WEIGHTS[2 * i], WEIGHTS[2 * i + 1], WEIGHTS[2 * (n + i)], WEIGHTS[2 * (n + i) + 1]
        z = z + x * (a + c * last) + x * x * (b + d * last)
    return 1 / (1 + F.exp(-z))


#: Tags, links, and product rows (a code and then its price).
_MARK = re.compile(r"#\S{4,}|https?://\S+|\]\(\S+|>> \S+|\b[\w-]+\.[\w.-]+/\w|\b\w+\.? \d{2,8} [$€£¥]\s?\d")
_ENDED = re.compile(r"[.!?…。！？।؟۔][\"'”’»」』）)\]]*\s*$")
_CUT = re.compile(r"(\.{3}|…|\[\.{3}\])\s*$")


_JOINT = re.compile(r"(?<=[.!?…。！？।؟])\s*[,|]\s+|\s+\|\s+")
_LIST = re.compile(r"\s[·•/|>»–-]\s|[;,،、|]\s")


def _units(text: str) -> list[str]:
    """Sentence units, cut once more where a list is joined on by a separator."""
    starts = unit_starts(text)
    return [x for a, b in zip(starts, [*starts[1:], len(text)], strict=True) for x in _JOINT.split(text[a:b], maxsplit=1) if x.strip()]


def _repeats(units: list[list[str]], share: dict[str, float]) -> tuple[set, set]:
    """Words of content, and pairs with at least one, that make up much of the text."""
    ones: dict = {}
    twos: dict = {}
    for u in units:
        for w in u:
            ones[w] = ones.get(w, 0) + 1
        for w in zip(u, u[1:], strict=False):
            twos[w] = twos.get(w, 0) + 1
    least = max(3, 0.025 * sum(ones.values()))
    content = lambda w: share.get(w, 0.0) < 0.6
    return {w for w, n in ones.items() if n >= least and content(w)}, {w for w, n in twos.items() if n >= least and (content(w[0]) or content(w[1]))}


def is_stuffed(text: str | None, share: dict[str, float], find, prose: float = 0.15, loud: float = 0.3) -> bool:
    """Apart from an opening sentence no unit is prose, and what remains is stuffed.

    A unit is prose if it ends like a sentence (or is the text's last, or in a script without sentence marks), its
    different words are common enough in the language's prose, and neither repeated words of content nor links and
    tags make up much of it. What remains is stuffed if it repeats itself so, or has links or tags in half of its
    units, or has a long unit that is a list or without any common word. One loud sentence alone is no case.
    """
    if not text or not text.strip():
        return False
    raw = _units(text)
    units = [[w for w in find(u.lower()) if not w.isdigit()] for u in raw]
    ones, twos = _repeats(units, share)
    words = again = marked = tags = kept = long = only_loud = 0
    for i, (r, u) in enumerate(zip(raw, units, strict=True)):
        if not u:
            continue
        types = set(u)
        common = sum(share.get(w, 0.0) for w in types) / len(types)
        pair = [w in twos for w in zip(u, u[1:], strict=False)]
        echo = sum(w in ones or (k > 0 and pair[k - 1]) or (k < len(pair) and pair[k]) for k, w in enumerate(u))
        marks = len(_MARK.findall(r))
        last = i == len(raw) - 1
        ended = bool(_ENDED.search(r)) and not _CUT.search(r)
        joints = len(_LIST.findall(r))
        listed = joints >= 5 and 5 * joints >= len(u) and not ended
        thai = "\u0e00" <= r[0] <= "\u0e7f"
        quiet = common >= prose * (2.2 if thai else 1.0 if ended or i else 1.3) and 8 * marks < len(u) and not listed
        if quiet and echo < loud * len(u) and (ended or last or thai) and (len(u) >= 5 or last):
            if i and (ended or not last):
                return False
            continue
        words, again, marked, tags, kept = words + len(u), again + echo, marked + (marks > 0), tags + marks, kept + 1
        if quiet and (ended or last):
            only_loud += 1
        elif len(u) >= 8 and not ended and (listed or common < 0.5 * prose or 6 * joints >= len(u)):
            long += 1
    if words < 5 or (kept == only_loud == 1):
        return False
    return again >= 0.3 * words or (2 * marked >= kept and tags >= 2) or long > 0


def stuffed_pages(pages: DataFrame) -> DataFrame:
    """``page`` of every stuffed one among ``pages`` (page BIGINT unique, lang STRING, text STRING).

    NULL, empty and blank texts and those of fewer than ``LEAST`` words are never stuffed; repeated texts are judged alike;
    an empty table gives no row.
    """
    firsts = staged(different(pages), "different-texts")
    counts = staged(word_counts(pages, firsts), "word-counts")
    core = staged(prose_core(counts, firsts), "prose-core")
    rows = compared(staged(curves(counts, core), "curves"))
    judged = staged(rows.where(F.col("words") >= LEAST).select("page", "fit", odds([F.col(x) for x in FIGURES]).alias("p")).where(F.col("p") > NO), "judged")
    doubtful = judged.where(F.col("p") < YES).join(pages.select("page", "text"), "page")
    shares: dict[str, dict[str, float]] = {}
    for r in core.limit(BROADCAST).select("word", F.explode("shares").alias("lang", "share")).toLocalIterator():
        shares.setdefault(r.lang, {})[r.word] = r.share
    known = pages.sparkSession.sparkContext.broadcast(shares)

    def run(batches):
        import regex

        find = regex.compile(WORD_PYTHON).findall
        for b in batches:
            keep = [is_stuffed(t, known.value.get(f, {}), find) for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["page"])

    read = doubtful.select("page", "fit", "text").mapInArrow(run, "page bigint")
    found = judged.where(F.col("p") >= YES).select("page").unionByName(read)
    keys = found.join(firsts, "page").select("k1", "k2")
    return pages.where(F.col("text").isNotNull()).select("page", *text_key(F.col("text"))).join(keys, ["k1", "k2"], "left_semi").select("page")
