import duckdb
import pandas as pd
from chronofold.llm import licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit int, place string, words int"
MIT = next(w for n, _, w in licenses.TEMPLATES if n == "mit-grant")


def run(spark, rows):
    return sorted(map(tuple, licenses.scan(spark.createDataFrame([(k, t, "en", "s", 1, 2, "x", 3) for k, t in rows], SCHEMA)).collect()), key=str)


ROWS = [
    (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose here."),
    (2, "some prose licensed under the apache license version 2 0 among other words that make it another line altogether"),
    (3, "  LICENSED   under the APACHE license -- version 2.0 "),
    (4, MIT.replace(", to deal", ",\nto deal").replace("publish,", "publish,\n")),
    (5, "Head.\n\n" + MIT.replace(", to deal", ",\nto deal") + "\n\nTail of the text."),
    (6, None), (7, ""), (8, "word"), (9, "\n\n\n"), (None, "Released under the MIT License."), (10, "Released under the MIT License."), (10, "Released under the MIT License."),
    (11, "Released under the\n\nMIT License."), (12, "é " * 3000 + "\nLicensed under CC BY-NC 4.0.\n" + "x" * 5000),
]


def test_finds_notices_and_spans(spark):
    found = {(r[0], r[1], r[2], r[3]) for r in run(spark, ROWS)}
    assert (1, "line", 1, "apache-2.0-short") in found and (3, "line", 0, "apache-2.0-short") in found
    assert (4, "paragraph", 0, "mit-grant") in found and (5, "paragraph", 1, "mit-grant") in found
    assert (11, "text", 0, "mit-short") in found and (12, "line", 1, "cc-by-nc-4.0-short") in found
    assert not any(k in (2, 6, 7, 8, 9) for k, *_ in found)


def test_matches_sql(spark):
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"])  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql("SELECT doc_id, unit, place, template, license, bigrams, dice FROM (" + licenses.sql() + ")").fetchall()
    assert run(spark, ROWS) == sorted(want, key=str)


def test_size_bounds_lose_nothing(spark):
    """Dice of every line with every template, without bounds."""
    got = {(r[0], r[2], r[3]): r[6] for r in run(spark, ROWS) if r[1] == "line"}
    for key, text in ROWS:
        for place, line in enumerate((text or "").split("\n")):
            own = set(licenses.bigrams(licenses.normal_words(line)))
            for name, _, wording in licenses.TEMPLATES:
                other = set(licenses.bigrams(licenses.normal_words(wording)))
                dice = 2 * len(own & other) / (len(own) + len(other)) if own else 0
                assert (dice >= 0.8) == ((key, place, name) in got)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_anchors_are_in_every_match():
    """A unit that lacks all of a template's anchors cannot reach the threshold: the best such unit has all other bigrams."""
    for _, _, wording in licenses.TEMPLATES:
        own = licenses.bigrams(licenses.normal_words(wording))
        chosen = licenses.anchors(own, 0.8)
        left = [b for b in own if not chosen & {*b.split(" ")}]
        assert 2 * len(left) / (len(left) + len(own)) < 0.8


def test_lines_of_exactly_the_least_coefficient(spark):
    """1.5 times or two thirds of a template's bigrams, all of the smaller set shared: the coefficient is 0.8."""
    rows = [(1, "This work is licensed under CC BY-NC 4.0."), (2, "Code is released under the MIT License.")]
    for k, (_, _, wording) in enumerate(licenses.TEMPLATES):
        words = licenses.normal_words(wording)
        n = len(licenses.bigrams(words))
        rows.append((10 + k, " ".join([*words, *(f"x{j}" for j in range(n // 2))])))
        rows.append((40 + k, " ".join(words[: 2 * n // 3 + 1])))
    got = {(r[0], r[3]): r[6] for r in run(spark, rows) if r[1] == "line"}
    assert got[1, "cc-by-nc-4.0-short"] == got[2, "mit-short"] == 0.8
    want = {}
    for key, text in rows:
        own = set(licenses.bigrams(licenses.normal_words(text)))
        for name, _, wording in licenses.TEMPLATES:
            other = set(licenses.bigrams(licenses.normal_words(wording)))
            if 10 * len(own & other) >= 4 * (len(own) + len(other)):
                want[key, name] = round(2 * len(own & other) / (len(own) + len(other)), 9)
    assert got == want and sum(d == 0.8 for d in got.values()) > 8
