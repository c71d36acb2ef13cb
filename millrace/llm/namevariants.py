"""Spellings of one body or person brought together.

Every different stored spelling is parsed once into what kind of body it names (words such as "health department",
abbreviated or not, in any order) and its proper name (a place, or a person's given and family name). Proper names
meet in a symmetric-delete index: each is entered under itself and itself less any one letter, so two names within
one edit share an entry. Within an entry, what a name lacks there says which others are one edit away: those that lack a
letter at the same place (substitution), the entry itself (deletion, insertion), those that lack the same letter one place
on (swap). For each of these keys only the best attested name is kept (the one that most spellings contain), so every name
finds its best partner one edit away although no entry's names are paired with each other. A rare name joins a better
attested one; names of like standing stay apart.

Then words are aligned: given names, initials and nicknames against the full given names known with that family name,
and by optimal assignment each person's words against those of the class, middle initials too, and the kind words of a
body of one spelling against the better attested kinds of its place, where it may leave out a qualifier or misspell a
short word. What fits nowhere is a class of its own.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged

# Words that tell what a body is; their irregular short forms; acronyms; words that tell nothing; short forms in place names; nicknames.
KINDS = (
    "academy administration agency airport association authority board borough bureau center city clinic college commission commonwealth community consolidated corporation council "
    "county court department development district division economic education elementary emergency environmental facilities federal finance fire foundation general government health high hospital "
    "housing human independent institute irrigation joint library medical memorial metropolitan ministry municipal museum office parish park parks planning police port protection province public recreation regional "
    "resources safety sanitation school schools secretary services sewer sheriff social state system systems technical technology town township trade transit transportation tribal trust unified university utilities utility "
    "village water welfare works"
).split()
SHORT = {
    "dept": "department", "dpt": "department", "hlth": "health", "cnty": "county", "co": "county", "cty": "county", "dist": "district", "prot": "protection", "sch": "school", "schl": "school", "wtr": "water", "swr": "sewer",
    "hosp": "hospital", "univ": "university", "u": "university", "uni": "university", "ofc": "office", "off": "office", "mem": "memorial", "meml": "memorial", "auth": "authority", "govt": "government", "pub": "public", "wks": "works",
    "sheriffs": "sheriff", "sherriff": "sheriff", "svcs": "services", "svc": "services", "comm": "commission", "ctr": "center", "centre": "center", "twp": "township", "trans": "transit", "assn": "association", "div": "division", "unif": "unified",
}
ACRONYMS = {
    "fpd": "fire protection district", "usd": "unified school district", "isd": "independent school district", "dpw": "department public works", "ta": "transit authority", "wsd": "water sewer district",
    "pd": "police department", "dph": "department public health", "dot": "department transportation", "so": "sheriff office", "mh": "memorial hospital", "chd": "county health department", "pw": "public works",
}
EMPTY = set("of the and for de la von der des & a an purchasing procurement attn attention contracts contracting buyer buyers bid bids c/o".split())
PLACES = {"mt": "mount", "mnt": "mount", "ft": "fort", "lk": "lake", "st": "saint", "ste": "sainte", "pt": "port", "n": "north", "s": "south", "e": "east", "w": "west"}
PLACEHOLDERS = set("unknown|n/a|na|none|null|nil|tbd|tba|-|--|—|?|not available|not provided|see notice|various|multiple|government agency|federal agency|state agency|local agency|agency|organization|buyer|other|anonymous|test".split("|"))
#: Legal forms: a name with one, and no kind word, is a company, which all its other words name.
COMPANIES = set("inc incorporated corp llc llp ltd limited plc gmbh ag kg sarl sas srl spa bv nv oy ab pty".split())
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin", "chuck": "charles", "charlie": "charles", "chris": "christopher", "cathy": "catherine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "don": "donald", "ed": "edward", "eddie": "edward", "ted": "theodore", "theo": "theodore", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "betsy": "elizabeth", "frank": "francis", "paco": "francisco", "pancho": "francisco", "kiko": "francisco", "fred": "frederick", "greg": "gregory", "hank": "henry", "harry": "henry", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer",
    "jack": "john", "johnny": "john", "jon": "jonathan", "joe": "joseph", "joey": "joseph", "jo": "josephine", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "kay": "katherine", "ken": "kenneth", "larry": "lawrence",
    "len": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "nate": "nathan", "nick": "nicholas", "nicky": "nicholas", "pam": "pamela", "pat": "patricia",
    "patty": "patricia", "pete": "peter", "ray": "raymond", "becky": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel", "sandy": "sandra",
    "steve": "steven", "sue": "susan", "susie": "susan", "terry": "teresa", "tess": "teresa", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victor", "bill": "william", "billy": "william", "will": "william",
    "willie": "william", "liam": "william", "zhenya": "yevgenia", "zhenia": "yevgenia", "sasha": "alexandra", "masha": "maria", "misha": "mikhail", "vova": "vladimir", "pepe": "jose", "lupe": "guadalupe", "nacho": "ignacio", "hans": "johannes", "fritz": "friedrich",
}
#: Words of form, left out where another kind word says what the body does.
FORMS = {"department", "office", "division", "agency", "bureau"}
#: Words that a body's spelling may leave out where no other body of the place has its other words.
QUALIFIERS = set("borough city community consolidated county general government independent joint municipal parish province public regional state town township unified village".split())
_KINDSET = set(KINDS)
_NOTE = re.compile(r"\((?:[^()]*)\)|\battn\b[:.]?", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|&", re.U)


def one_edit(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@lru_cache(100_000)
def kind_word(token: str) -> str:
    """The kind word that a token states, abbreviates or misspells, or ''."""
    if token in _KINDSET:
        return token
    if token in SHORT:
        return SHORT[token]
    if token.endswith("s") and token[:-1] in _KINDSET:
        return token[:-1]
    if len(token) >= 6:
        near = [k for k in KINDS if len(k) >= 6 and one_edit(token, k)]
        return near[0] if near else ""
    return ""


def slips(org: str) -> list[tuple[str, str]]:
    """(kind, name) of a body's spelling under each reading of one short word of its name as a misspelt kind word."""
    kind, name, _, _ = parse(org)
    if not kind or kind == "person" or not name:
        return []
    out = []
    for w in {x.lower() for x in _TOKEN.findall(unicodedata.normalize("NFKC", org))}:
        if 4 <= len(w) <= 5 and not kind_word(w) and (bare := _letters(w)) in name and bare != name:
            for k in KINDS:
                if w[0] == k[0] and one_edit(w, k):
                    words = set(kind.split()) | {k}
                    out.append((" ".join(sorted(words - FORMS or words)), name.replace(bare, "", 1)))
    return out


def _letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalnum())


def parse(org: str) -> tuple[str, str, str, str]:
    """(kind, name, given, middle) of a spelling: kind words in order of the alphabet for a body, 'person' for a person; '' for a placeholder.

    name: letters of the place or family name run together, so that spaces and hyphens that were dropped, added or
    moved make no difference.
    """
    text = unicodedata.normalize("NFKC", org).strip()
    if not text or text.lower().strip(" .") in PLACEHOLDERS:
        return "", "", "", ""
    bare = _NOTE.sub(" ", text)
    if not _TOKEN.search(bare):
        bare = text
    bare = re.sub(r"\s+[-–—]\s+(purchasing|procurement)\b.*$", "", bare, flags=re.I)
    words = [w.lower().replace("'", "").replace("’", "") for w in _TOKEN.findall(bare)]
    kinds, rest = set(), []
    for k, w in enumerate(words):
        if w in EMPTY and not (len(w) == 1 and w.isalpha() and w == "a"):
            continue
        if w in ACRONYMS and (k == len(words) - 1 or k == 0):
            kinds.update(ACRONYMS[w].split())
            continue
        found = kind_word(w) if len(w) > 1 or w == "u" and "of" in words[k + 1 : k + 3] else ""
        if found:
            kinds.add(found)
        elif w != "s" or rest:
            rest.append(w)
    for m in _NOTE.findall(text):
        kinds.update(x for w in _TOKEN.findall(m.lower()) if (x := kind_word(w)))
    if kinds - {"office"}:
        kinds = kinds - FORMS or kinds
        if not rest:
            return " ".join(sorted(kinds)), "", "", ""
        head = rest[0]
        short = next((p for p in sorted(PLACES, key=len, reverse=True) if head == p), "")
        if short and len(rest) > 1:
            rest[0] = PLACES[short]
        name = "".join(_letters(w) for w in rest)
        glued = re.search(r"\b(?i:(mt|ft|lk|st))(?:\.[A-Za-z]|[A-Z][a-z])", bare)
        if glued and name.startswith(glued.group(1).lower()):
            name = PLACES[glued.group(1).lower()] + name[len(glued.group(1)) :]
        return " ".join(sorted(kinds)), name, "", ""
    forms = [w for w in rest if w in COMPANIES]
    if forms and len(rest) > len(forms):
        return "company", "".join(_letters(w) for w in rest if w not in COMPANIES), "", ""
    people = [w for w in rest if w]
    if not people:
        return "", "", "", ""
    if "," in bare and _letters(bare.split(",", 1)[1]):
        family = _letters(bare.split(",", 1)[0].split("of ")[-1] if "office of" in bare.lower() else bare.split(",", 1)[0])
        others = [w.lower() for w in _TOKEN.findall(bare.split(",", 1)[1])]
    else:
        family, others = _letters(people[-1]), people[:-1]
        if len(family) <= 2 and len(people) > 1:
            family, others = _letters(max(people, key=len)), [w for w in people if w != max(people, key=len)]
    others = [_letters(w) for w in others if w not in EMPTY or w == "a"]
    given = others[0] if others else ""
    return "person", family, NICKNAMES.get(given, given), others[1][:1] if len(others) > 1 else ""


@lru_cache(50_000)
def _cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    s, t = sorted((a, b), key=len)
    if s and s[0] == t[0] and (len(s) == 1 or (len(s) < len(t) and all(c in it for it in [iter(t)] for c in s))):
        return 0.1
    if NICKNAMES.get(a, a) == NICKNAMES.get(b, b):
        return 0.1
    return 0.3 if one_edit(a, b) else 1.0


def alignment(a: list[str], b: list[str]) -> float:
    """Least mean cost of matching the shorter word list into the longer: an optimal assignment by shortest augmenting paths."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, m = len(a), len(b)
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, used = [9e9] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            used[at] = True
            row, step, to = owner[at], 9e9, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = _cost(a[row - 1], b[j - 1]) - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at], at = owner[way[at]], way[at]
    return sum(_cost(a[owner[j] - 1], b[j - 1]) for j in range(1, m + 1) if owner[j]) / n


def _fits(kind: str, a: tuple[str, str, str], b: tuple[str, str, str], other: str = "") -> bool:
    """Whether two parsed spellings (name, given, middle) align: of one kind, or of bodies of kinds ``kind`` and ``other``."""
    if kind != "person":
        x, y = set(kind.split()), set((other or kind).split())
        return x == y or bool(x & y - QUALIFIERS) and (x ^ y) <= QUALIFIERS and (x < y or y < x) and alignment([*x], [*y]) <= 0.1
    if a[2] and b[2] and a[2] != b[2]:
        return False
    return alignment([x for x in (a[1], a[0]) if x], [x for x in (b[1], b[0]) if x]) <= 0.5


def _joined(both: DataFrame) -> DataFrame:
    """``both`` (world, kind, hub, who, alts ...) with bodies of one spelling moved to the class they align with, if there is exactly one such of more spellings."""
    known = both.where("world = 'place'").groupBy("kind", "hub").agg(F.count(F.lit(1)).alias("m"))
    alone = both.where("world = 'place'").join(known.where("m = 1"), ["kind", "hub"])
    slipped = alone.select("org", F.explode("alts").alias("alt")).select("org", F.col("alt.kind").alias("to_kind"), F.col("alt.name").alias("to_hub"), F.lit(True).alias("fit"))

    @F.pandas_udf("boolean")
    def align(kind: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([_fits(k, ("", "", ""), ("", "", ""), o) for k, o in zip(kind, other, strict=True)], index=kind.index)

    stated = known.where("m > 1").select(F.col("kind").alias("to_kind"), F.col("hub").alias("to_hub"))
    short = alone.select("org", "kind", "hub").join(stated, F.col("hub") == F.col("to_hub")).where(F.col("kind") != F.col("to_kind"))
    short = short.select("org", "to_kind", "to_hub", align("kind", "to_kind").alias("fit"))
    to = slipped.join(stated, ["to_kind", "to_hub"]).select("org", "to_kind", "to_hub", "fit").unionByName(short).where("fit")
    to = to.groupBy("org").agg(F.collect_set(F.struct("to_kind", "to_hub")).alias("to")).where(F.size("to") == 1).select("org", F.col("to")[0].alias("to"))
    got = both.join(to, "org", "left")
    kind = F.coalesce("to.to_kind", "kind")
    return got.withColumn("who", F.when(F.col("world") == "place", kind).otherwise(F.col("who"))).withColumn("hub", F.coalesce("to.to_hub", "hub")).withColumn("kind", kind).drop("to")


def _partners(names: DataFrame) -> DataFrame:
    """(world, name, hub): of each name (world, name, spellings, n) the best attested one a single edit away, if it stands so much higher that the name counts as its slip."""
    at = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.struct(F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.length("name"))).alias("entry"), i.alias("i"), F.substring(F.col("name"), i, F.lit(1)).alias("c")))
    lacks = names.select("*", F.explode(at).alias("e")).select("world", "name", "spellings", "n", "e.entry", "e.i", "e.c")
    standing = F.struct("spellings", "n", "name")
    key = lambda *parts: F.concat_ws("\x01", *parts)
    i = F.col("i").cast("string")
    # keys under which a name offers itself, and under which it looks for others
    offers = F.array(key("entry", F.lit("place"), i), key("entry", F.lit("any")), key("entry", F.lit("swap"), "c", i), key("entry", F.lit("swap"), "c", (F.col("i") + 1).cast("string")))
    looks = F.array(key("entry", F.lit("place"), i), key("entry", F.lit("self")), key("entry", F.lit("swap"), "c", i), key("entry", F.lit("swap"), "c", (F.col("i") + 1).cast("string")))
    whole = names.select("world", "name", "spellings", "n")
    offered = lacks.select("world", F.explode(offers).alias("key"), standing.alias("who")).unionByName(whole.select("world", key("name", F.lit("self")).alias("key"), standing.alias("who")))
    best = offered.groupBy("world", "key").agg(F.max("who").alias("hub"))
    sought = lacks.select("world", "name", "spellings", "n", F.explode(looks).alias("key")).unionByName(whole.select("world", "name", "spellings", "n", key("name", F.lit("any")).alias("key")))
    near = sought.distinct().join(best, ["world", "key"]).where((F.col("hub.name") != F.col("name")) & (F.col("hub") > standing))
    more = F.col("hub.spellings") / F.col("spellings")
    slip = F.when(F.length("name") < 5, (F.col("spellings") == 1) & (F.col("hub.spellings") >= 3)).otherwise((F.col("spellings") == 1) | (F.col("spellings") == 2) & (more > 1) | (more >= 3))
    return near.where(slip).groupBy("world", "name").agg(F.max("hub").getField("name").alias("hub"))


def classes(rows: DataFrame, column: str = "organization") -> DataFrame:
    """(org, class_id): every spelling that names a body or person, with its class; spellings of one class name the same.

    NULL, blank and placeholder values have no row. The result has one row a different stored value.
    """
    orgs = rows.select(F.col(f"`{column}`").alias("org")).where(F.col("org").isNotNull()).groupBy("org").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for b in batches:
            made = pd.DataFrame([parse(o) for o in b.org], columns=["kind", "name", "given", "middle"], index=b.index)
            made["alts"] = [[{"kind": k, "name": n} for k, n in slips(o)] for o in b.org]
            yield pd.concat([b, made], axis=1)

    parsed = orgs.mapInPandas(run, "org string, n bigint, kind string, name string, given string, middle string, alts array<struct<kind:string,name:string>>").where(F.col("kind") != "")
    parsed = staged(parsed.withColumn("world", F.when(F.col("kind") == "person", "person").otherwise("place")), "parsed-names")

    link = _partners(parsed.where(F.col("name") != "").groupBy("world", "name").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")))
    # a hub that joined a better one passes its names on
    second = link.select("world", F.col("name").alias("hub"), F.col("hub").alias("top"))
    link = link.join(second, ["world", "hub"], "left").select("world", "name", F.coalesce("top", "hub").alias("hub"))
    placed = staged(parsed.join(link, ["world", "name"], "left").withColumn("hub", F.coalesce("hub", "name")), "linked-names")

    bodies = placed.where("world = 'place'").withColumn("who", F.col("kind"))
    people = placed.where("world = 'person'")
    full = people.where(F.length("given") > 1)
    known = full.groupBy("hub", "given").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    of_initial = known.groupBy("hub", F.substring("given", 1, 1).alias("first")).agg(F.max(F.struct("spellings", "n", "given")).alias("best"), F.collect_set(F.when(F.col("spellings") > 1, F.col("given"))).alias("often"))
    people = people.withColumn("first", F.substring("given", 1, 1)).join(of_initial, ["hub", "first"], "left")
    slip = (F.length("given") > 1) & (F.col("given") != F.col("best.given")) & (F.levenshtein("given", F.col("best.given")) <= 2) & (F.length("given") >= 5) & ~F.array_contains("often", F.col("given"))
    alone = F.size("often") <= 1
    people = people.withColumn("who", F.when(F.coalesce(slip, F.lit(False)), F.col("best.given")).when((F.length("given") <= 1) & (F.length("given") > 0) & alone, F.coalesce("best.given", "given")).otherwise(F.col("given")))
    cols = ["org", "n", "world", "kind", "name", "given", "middle", "hub", "who", "alts"]
    both = staged(_joined(staged(bodies.select(*cols).unionByName(people.select(*cols)).where(F.col("hub") != ""), "placed-names")), "joined-names")
    # the middle initial that most rows of a class have; other initials are other persons
    middles = both.where("middle != ''").groupBy("kind", "hub", "who", "middle").agg(F.sum("n").alias("n"))
    top = middles.groupBy("kind", "hub", "who").agg(F.max(F.struct("n", "middle")).getField("middle").alias("initial"))

    @F.pandas_udf("boolean")
    def fits(kind: pd.Series, name: pd.Series, given: pd.Series, middle: pd.Series, hub: pd.Series, who: pd.Series, initial: pd.Series) -> pd.Series:
        return pd.Series([_fits(k, (n, g, m), (h, w, i)) for k, n, g, m, h, w, i in zip(kind, name, given, middle, hub, who, initial, strict=True)], index=kind.index)

    got = both.join(top, ["kind", "hub", "who"], "left").withColumn("initial", F.coalesce("initial", F.lit("")))
    fit = fits("kind", "name", "given", "middle", "hub", "who", "initial")
    own = F.when(fit, F.xxhash64("kind", "hub", "who")).otherwise(F.xxhash64("kind", "name", "given", "middle"))
    return got.select("org", "n", own.alias("class_id"), "kind", "hub", "who")


def pairs(classed: DataFrame, block: int = 256) -> DataFrame:
    """(org_a, org_b) for every two spellings of a class, the smaller first. A class of very many is spread over tasks in blocks of ``block``."""
    size = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    rows = classed.select("org", "class_id").join(size, "class_id").withColumn("parts", F.ceil(F.col("m") / block).cast("int"))
    left = rows.select("class_id", F.col("org").alias("org_a"), F.pmod(F.xxhash64("org"), F.col("parts").cast("bigint")).cast("int").alias("part"))
    right = rows.select("class_id", F.col("org").alias("org_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["class_id", "part"]).where(F.col("org_a") < F.col("org_b")).select("org_a", "org_b")
