import random
import re

from chronofold.llm import urls
from pyspark.sql import functions as F

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def shapes(path):
    hexed = re.sub(r"(?:^|(?<=[/._-]))(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}(?=$|[/._-])", "{h}", path)
    parts = re.sub("[0-9]+", "{n}", hexed).split("/", urls.DEPTH)
    return tuple(parts[1:])


def plain_templates(pages):
    """The tree, level by level, over rows (host, shapes, label or None)."""
    state = [[h, s, y, ""] for h, s, y in pages]
    for level in range(max((len(s) for _, s, _ in pages), default=0)):
        groups = {}
        for row in state:
            if len(row[1]) > level:
                groups.setdefault((row[0], row[3]), []).append(row)
        for rows in groups.values():
            kids = {}
            for row in rows:
                kids.setdefault(row[1][level], []).append(row)
            marks = [r[2] for r in rows if r[2] is not None]
            variable = len(kids) >= urls.MANY and len(kids) > urls.MANY_SHARE * len(rows)
            names = {}
            for seg, own in kids.items():
                mine = [r[2] for r in own if r[2] is not None]
                rest, bad = len(marks) - len(mine), sum(marks) - sum(mine)
                rate = (sum(marks) + 1) / (len(marks) + 2)
                alike = len(mine) >= urls.OWN and rest > 0 and abs(sum(mine) / len(mine) - bad / rest) <= urls.SIMILAR * (rate * (1 - rate) * (1 / len(mine) + 1 / rest)) ** 0.5
                names[seg] = "*" if alike or (variable and len(mine) < urls.OWN) else seg
            for row in rows:
                row[3] += "/" + names[row[1][level]]
    marks = [r[2] for r in state if r[2] is not None]
    bad = (sum(marks) + 1) / (len(marks) + 2)

    def smoothed(rows, prior):
        own = [r[2] for r in rows if r[2] is not None]
        return (sum(own) + urls.PRIOR * prior) / (len(own) + urls.PRIOR)

    return [(r[3], round(1 - smoothed([x for x in state if (x[0], x[3]) == (r[0], r[3])], smoothed([x for x in state if x[0] == r[0]], bad)), 9)) for r in state]


def made(n=500, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        host = rng.choice(["hot.example.com"] * 3 + ["A.example.NET", "b.example.org", "spam.io", "example.net"])
        section = rng.choice(["en", "de", "fr", "deals", "wiki"])
        tail = rng.choice([f"{k}", f"{k}.html", f"{k}/", f"item-{rng.randrange(9)}", f"{rng.getrandbits(48):012x}", ""])
        rows.append((k, f"https://{host}/{section}/{tail}" + rng.choice(["", "?q=1", "#top"])))
        if rng.random() < 0.6:
            labels.append((k, int(rng.random() < (0.95 if section == "deals" else 0.1))))
    return rows, labels


def run(spark, rows, labels):
    pages = spark.createDataFrame([(k, u, "<p>", "h", 1) for k, u in rows], "page_id long, url string, html string, host string, bad int")
    return urls.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"))


def check(spark, rows, labels):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"]) for r in run(spark, rows, labels).collect()), key=str)
    marks = dict(labels)
    parsed = [parse(u) for _, u in rows]
    made_ = plain_templates([(h, shapes(p), marks.get(k)) for (k, _), (h, p) in zip(rows, parsed, strict=True)])
    want = []
    for (k, _), (h, p), (template, purity) in zip(rows, parsed, made_, strict=True):
        verdict, name = rule(h, p)
        want.append((k, h, p, name, verdict or ("allow" if purity >= 0.5 else "block"), template, purity))
    assert [g[:6] for g in got] == [w[:6] for w in sorted(want, key=str)]
    assert all(abs(g[6] - w[6]) < 1e-8 for g, w in zip(got, sorted(want, key=str), strict=True))
    return got


def test_matches_brute_force(spark):
    got = check(spark, *made())
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
    assert any("*" in r[5] for r in got)


def test_odd_urls(spark):
    odd = [None, "", "nonsense", "http://", "http://NET", "http://net/", "http://xnet/", "http://a.net?x=/en/", "http://a.example.net/en", "http://a.example.net/en/", "https://É.org/fr/a#b?c", "ftp://example.com/de/x://y/", "a://b://c/d", "http://example.com:80/de/", "http://x/" + "a/" * 50, "http://x/" + "y" * 9000]
    check(spark, [*enumerate(odd), (3, "http://x/1"), (3, "http://x/1"), (None, "http://x/2")], [(3, 1), (1, 0)])
    assert run(spark, [], []).count() == 0
    assert run(spark, [(1, "http://x/")], []).first()["purity"] == 0.5


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://x/en/25.html?p=7"), (2, "http://x/3/9/"), (3, "http://x/"), (4, None), (5, "http://x/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(25, 0, 0), (9, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.page_labels(pages, labels).collect())) == [(1, 1), (2, 1)]
    assert pages.select(F.count("*")).first()[0] == 5


def test_labelled_branch_beside_many_slugs(spark):
    """A bad directory keeps its template and verdict at a level of one-off slugs; a slug with one bad label has none."""
    slugs = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(120)]
    rows = [(k, f"http://h.info/{s}/page") for k, s in enumerate(slugs)] + [(200 + k, "http://h.info/malware/page") for k in range(30)]
    got = {r["page_id"]: r for r in run(spark, rows, [(k, int(k >= 200 or k == 7)) for k, _ in rows]).collect()}
    assert {(got[k]["template"], got[k]["verdict"]) for k in range(200, 230)} == {("/malware/page", "block")}
    assert {(got[k]["template"], got[k]["verdict"]) for k in range(120)} == {("/*/page", "allow")}
