import random

from pyspark.sql import functions as F

from millrace.llm import boilerplate as B
from millrace.llm import stuffing as S

PAGE = """Skip to main content
Home | Services | News
Home > Services > News
We use cookies to improve this site. By continuing you accept them.
Accept all
Request for Proposals: Road works
The county will keep records for ten years and the board will meet in May.
Cookies and privacy at our kiosks
Contact the clerk in person if the form is missing.

Share this page
Read more about road works
The panel will review all of the offers before the close of business.
Privacy Policy | Terms of Use | Accessibility
© 2024 Balna Varlford
Back to top"""


def test_furniture_lines():
    assert B.furniture_lines(PAGE) == [1, 2, 3, 4, 5, 11, 12, 14, 15, 16]
    assert B.body(PAGE).startswith("Request for Proposals") and B.body(None) is None
    assert B.furniture_lines(None) == B.furniture_lines("") == B.furniture_lines(" \n ") == []


def test_running_heads_and_page_numbers():
    pages = "Form G-231\nThe county keeps the records for ten years.\n1\nFORM G-231\nThe board will meet again in the month of May.\n2\nForm G-231\nThe panel reviews the offers.\n3"
    assert B.furniture_lines(pages) == [1, 3, 4, 6, 7, 9]


def test_region_takes_unseen_furniture():
    prose = "The county will keep records for ten years and the board will meet in May.\nThe panel will review all of the offers before the close of business."
    page = f"Search our calendar\nHome | Services | News\n{prose}\nPrivacy Policy | Terms of Use\nNewsletter signup\nStaff directory\nBack to top\n{prose}\nBack to top"
    assert B.furniture_lines(page) == [1, 2, 5, 6, 7, 8, 11]
    menu = " | ".join(["Home", "Services", "News", "Contact", "Search", "Calendar"] * 12)
    notice = "We and your council site use cookies by which we count visits, and by use of this website you give your consent to the policy; read more about data, log in to your account or contact us to choose which categories of tracking apply to your browser."
    assert B.furniture_lines(f"{menu}\n{prose}\n{notice}\n{prose}") == [1, 4]


def test_regions_decide_and_unseen_menus_go():
    prose = "The county will keep records for ten years and the board will meet in May.\nThe panel will review all of the offers before the close of business."
    unseen = ["Home | Products | Pricing | Blog", "Produkte | Preise | Blog", "We value your privacy and use trackers"]
    assert B.furniture_lines("\n".join([unseen[0], unseen[1], prose, unseen[2]])) == [1, 2, 5]
    long = "We use cookies and similar tracking on this site to improve the website and to count visits; by continuing to use this website you accept our cookie policy and privacy policy, and you can opt out at any time by the settings of your browser, read our policy for details, or reject all cookies in the cookie settings of this page. " * 2
    assert len(long) > 600 and B.furniture_lines(f"{long}\n{prose}") == [1]
    # a doubtful line goes with its region: kept within the body, gone between furniture
    doubtful = min((x for x in ("Pricing", "Overview", "Submission", "Site visit") if B.SURE < B.line_score(x) < B.MOST), key=B.line_score)
    assert B.furniture_lines(f"{prose}\n{doubtful}\n{prose}") == []
    assert not B.body_regions([B.line_score(x) for x in unseen])


def test_body_regions_are_maximal():
    assert B.body_regions([1, -5, 3, -2, 4, -9, 2]) == [(0, 0), (2, 4), (6, 6)] and B.body_regions([-1, 0]) == []


def test_best_region_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-3, -1, 0, 1, 2, 5]) for _ in range(rng.randint(1, 12))]
        a, b = B.best_region(s)
        best = max(sum(s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1))
        assert max(0, sum(s[a : b + 1])) == max(0, best)


def test_find_furniture_operator(spark):
    df = spark.createDataFrame([(1, PAGE, 0), (2, None, 0), (3, "", 0)], "page long, text string, line_no int")
    assert sorted(r.line_no for r in B.find_furniture(df).where("page = 1").collect()) == B.furniture_lines(PAGE)
    assert B.find_furniture(df).where("page > 1").count() == 0 and B.find_furniture(df.limit(0)).count() == 0


def corpus():
    rng = random.Random(5)
    who = "the county;the board;the medical director;a local partner;every applicant;the purchasing office".split(";")
    does = "will keep the records for ten years;may extend the agreement for two months;asks for weekly reports on the work;must submit copies of the proposal;has opened a second office in the town".split(";")
    when = "before the close of business;after the pilot phase;without additional cost;in accordance with the attached schedule;for all new hires".split(";")
    sentence = lambda: " ".join([rng.choice(who).capitalize(), rng.choice(does), rng.choice(when)]) + "."
    prose = [" ".join(sentence() for _ in range(rng.randint(2, 12))) for _ in range(250)]
    keys = "cdl exam;gloves bulk;flu shot;hearing test price;masks wholesale".split(";")
    bad = [", ".join(rng.choice(keys) for _ in range(60)) for _ in range(4)]
    bad += [" ".join("#" + rng.choice(keys).replace(" ", "-") for _ in range(40)), "\n".join(f"[{k}](http://x.example/{i})" for i, k in enumerate(keys * 5)), sentence() + "\n" + " | ".join(rng.choice(keys) for _ in range(50))]
    bad += ["Cdl exam is the cdl exam for all flu shot and cdl exam needs! Looking for cdl exam or flu shot, choose cdl exam because cdl exam beats flu shot. Get cdl exam, cdl exam, flu shot, cdl exam today."]
    return prose, bad


def test_stuffed_pages(spark):
    prose, bad = corpus()
    odd = [None, "", " ", "N/A", "No description available"]
    rows = [(i, "en", t) for i, t in enumerate(prose + odd)] + [(1000 + i, None, t) for i, t in enumerate(bad)]
    got = {r.page for r in S.stuffed_pages(spark.createDataFrame(rows, "page long, lang string, text string")).collect()}
    assert got == {1000 + i for i in range(len(bad))}


def test_the_curve_decides(spark):
    prose, bad = corpus()
    rows = [(i, "en", t) for i, t in enumerate(prose + bad)] + [(5000 + i, "en", bad[0]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page long, lang string, text string")
    firsts = S.different(pages)
    assert firsts.count() == len(set(prose + bad))
    counts = S.word_counts(pages, firsts)
    judged = S.compared(S.curves(counts, S.prose_core(counts, firsts))).withColumn("p", S.odds([F.col(x) for x in S.FIGURES])).collect()
    by = {r.page: r.p for r in judged}
    assert sum(by[i] <= S.NO for i in range(len(prose))) >= 0.8 * len(set(prose)) and max(by[len(prose) + i] for i in range(len(bad))) >= S.YES
    assert {r.page for r in S.stuffed_pages(pages).collect()} >= {5000 + i for i in range(40)}


def test_many_languages_have_their_own_core(spark):
    rows = [(100 * k + i, f"{chr(97 + k // 26)}{chr(97 + k % 26)}", f"w{k} and v{k} u{i % 3} t{k}") for k in range(30) for i in range(6)]
    pages = spark.createDataFrame(rows, "page long, lang string, text string")
    firsts = S.different(pages)
    core = {r.word: r.shares for r in S.prose_core(S.word_counts(pages, firsts), firsts).collect()}
    assert len(core["and"]) == 30 and core["w29"] == {"bd": 1.0}


def test_stuffed_empty(spark):
    assert S.stuffed_pages(spark.createDataFrame([], "page long, lang string, text string")).count() == 0


def test_language_codes(spark):
    df = spark.createDataFrame([("EN",), ("ru-XX",), ("ger",), (None,), ("??",)], "l string")
    assert [r.c for r in df.select(S.language_code(F.col("l")).alias("c")).collect()] == ["en", "ru", "de", None, None]
