"""Quality features equal a plain version; rules keep clean texts and drop failing lines."""

import re

from plotmark.llm import quality
from plotmark.llm.queries import QUERIES


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(repeated),
        n < 20 or 100 * len(repeated) > 30 * n,
    )


SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank today."
TEXTS = [
    None,
    "",
    " \n\t\x0b ",
    SENTENCE,
    "\n".join([SENTENCE, "A second sentence has other words and ends well."]),
    " ".join([SENTENCE] * 3),
    " ".join(["a b c d e f g h i j"] * 40),
    "x " * 30_000,
    "\n".join(f"{SENTENCE} {k}." for k in range(10)) + "\nx\nx\n x\n\n\n",
    "a\x0bb\x0cc\rd\te  f 漢字 😀é",
    " ".join(f"w{k}" for k in range(20)) + " " + " ".join(f"w{k}" for k in range(4, 20)),
]


def test_features(spark):
    rows = [(k, t, "n", True) for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], "n", False), (3, TEXTS[3], "n", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = quality.assess(df).select("row.doc_id", "row.text", "q.*").collect()
    assert len(got) == len(rows)
    for r in got:
        values = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert values == slow(r.text), r.text and r.text[:60]
        assert not (r.kept and r.base_failed)
    assert quality.assess(df.limit(0)).count() == quality.keep_clean(df.limit(0)).count() == 0


def test_lines(spark):
    lines = {
        SENTENCE: True,
        "": True,
        "  ": True,
        "Home | About | Contact | Help us": False,
        "Home": False,
        "Yes.": True,
        "(see below)": True,
        "Five words without an end": True,
        "We use cookies to improve this site for you.": False,
        "All rights reserved.": False,
        "Licensed under CC BY-NC 4.0.": False,
        "WOW!! SO!! LOUD!! THIS!!": False,
        "one*** two### three$$$ four five six": False,
        "Costs rose by 5% in May, to $7 a share, and fell after that.": True,
        SENTENCE * 30 + " click here": True,
    }
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {r.x: r.p for r in df.select("x", quality.line_passes(df["x"]).alias("p")).collect()}
    assert got == lines


def test_sentences_with_words_of_notices_stay(spark):
    clean = [
        "The library keeps a catalog in every room of the building.",
        "He found a cookie recipe that his mother wrote in 1950.",
        "The team chose to design upgrades for the bridge.",
        "They share this view of the matter with most of their friends.",
        "People sign up for the course in spring and log in from home.",
        "She wanted to read more books about the old kings.",
        "Many subscribe to the theory that the river moved.",
        "The blog in question uses cookiecutter templates.",
    ]
    notices = ["Log in", "» Sign up now", "Read more...", "Click here for the list.", "Share on social media", "Subscribe to our newsletter!",
               "Please enable JavaScript to view this page.", "© 2019 A. Author", "See our privacy policy.", "This site uses cookies."]
    df = spark.createDataFrame([(x,) for x in clean + notices], "x string")
    got = {r.x for r in df.filter(quality.line_passes(df["x"])).collect()}
    assert got == set(clean)
    texts = [(k, " ".join(three)) for k, three in enumerate(zip(clean, clean[1:], clean[2:]))]
    kept = quality.keep_clean(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == texts


def test_removal(spark):
    good = f"{SENTENCE}\nAnother line follows, which says other things and then ends."
    rows = [
        (1, f"Home | About\n{good}\nAll rights reserved.", "a"),
        (2, f"{good}\n" + "\n".join(["Menu | Links | Other | Pages | Shop | Login | Cart"] * 20), "b"),
        (None, good, None),
        (4, "too short.", "c"),
        (5, None, "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, cleaned string")
    got = quality.keep_clean(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, good, "a"), (None, good, None)]


def test_plan_has_no_exchange_and_no_python(spark, sf):
    plan = QUERIES["op10_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
