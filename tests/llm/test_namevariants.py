import pytest

from millrace.llm import namevariants as N

SAME = [
    ["Balna Varlford County Health Department", "BALNA VARLFORD CNTY HLTH DEPT", "Balna Varlfrod County Health Department", "Health Department, Balna Varlford County", "County of BalnaVarlford Health Department", "Balna-Varlford Co. Health Dept.,"],
    ["Balna Varlford Memorial Hospital", "Memorial Hospital of Balna Varlford", "balna varlford memorial hosp"],
    ["Mount Kenpint Ningrwick Fire Protection District", "Mt. Kenpint Ningrwick FPD", "Fire Protection Dist. of Mount Kenpin tNingrwick", "Mt. Kenpint Ningrwick Fire Prot. District"],
    ["City of Torsume Grosswmarsh", "The City of Torsume Grosswmarsh", "Torsume Grosswmarsh City", "CITY OF Torsume Groswsmarsh - Purchasing"],
    ["Theodore Centahossgun", "Ted Centahossgun", "Office of T. Centahossgun", "Centahossgun, Theo", "Attn: Theodore R. Cenntahossgun"],
    ["Yevgenia Centahossgun", "Zhenya G. Centahossgun", "CENTAHOSSGUN, YEVGENIA"],
]
NONE = [None, "", "  ", "N/A", "Unknown", "Federal Agency", "-"]


def test_classes_and_pairs(spark):
    values = [o for g in SAME for o in g] + NONE
    rows = [(o, 1) for o in values] * 2 + [(g[0], 1) for g in SAME] * 3
    got = N.classes(spark.createDataFrame(rows, "organization string, class_id int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_id, set()).add(r.org)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, SAME))
    pairs = {(r.org_a, r.org_b) for r in N.pairs(spark.createDataFrame([(r.org, r.class_id) for r in got], "org string, class_id long"), block=2).collect()}
    assert pairs == {(a, b) for g in SAME for a in g for b in g if a < b}


def test_kind_words_and_middle_initials_are_aligned(spark):
    one = ["Balna Varlford County Health Department", "BALNA VARLFORD CNTY HLTH DEPT", "Balna Varlford Health Department"]
    two = ["Kenpint Ningrwick School District", "Kenpint Ningrwick Sch. Dist.", "Kenpint Ningrwick Schol District"]
    three = ["Balna Varlford County", "County of Balna Varlford"]
    four, five = ["Theodore R. Centahossgun", "Theodore Centahossgun"], ["Theodore K. Centahossgun"]
    rows = [(o,) for g in (one, two, three, four, five) for o in g] + [(o,) for o in four] * 2
    by = {}
    for r in N.classes(spark.createDataFrame(rows, "organization string")).collect():
        by.setdefault(r.class_id, set()).add(r.org)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [one, two, three, four, five]))


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "organization string")
    assert N.pairs(N.classes(df)).count() == 0 and N.pairs(N.classes(df.limit(0))).count() == 0


@pytest.mark.parametrize("a,b,near", [("abc", "abc", True), ("abc", "ac", True), ("abc", "acb", True), ("abc", "xbc", True), ("abc", "cba", False), ("abcd", "ab", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert N.one_edit(a, b) is near


def test_alignment_takes_initials_and_abbreviations():
    assert N.alignment(["t", "lee"], ["lee", "theodore"]) < 0.1
    assert N.alignment(["dept", "health"], ["health", "department"]) < 0.1
    assert N.alignment(["ann", "lee"], ["bob", "ray"]) == 1.0


def test_companies_and_middle_initials_stay_apart(spark):
    apart = ["Acme Widgets Inc", "Acme Gadgets Inc", "Siemens Healthcare GmbH", "Siemens Energy GmbH", "John A. Smith", "John B. Smith"]
    same = ["Acme Widgets, Inc.", "ACME WIDGETS INC"]
    got = {r.org: r.class_id for r in N.classes(spark.createDataFrame([(o,) for o in apart + same], "organization string")).collect()}
    assert len({got[o] for o in apart}) == len(apart) and {got[o] for o in same} == {got["Acme Widgets Inc"]}


def test_every_name_finds_its_best_partner(spark):
    rows = [("place", "marxin", 1, 1), ("place", "martin", 4, 9), ("place", "marina", 8, 20), ("place", "marin", 3, 5), ("place", "renl", 1, 1), ("place", "reno", 5, 9), ("place", "matrin", 1, 2)]
    got = {r.name: r.hub for r in N._partners(spark.createDataFrame(rows, "world string, name string, spellings long, n long")).collect()}
    assert got["marxin"] == "martin" and got["matrin"] == "martin" and got["renl"] == "reno" and "reno" not in got and "martin" not in got
