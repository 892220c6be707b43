"""URL filters: fixed rules, and path-template trees that labelled pages judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import cut

#: Path segments that get a level of the tree unless another number is given; what is deeper stays in the last one.
DEPTH = 8
#: A node is a variable when it has so many branches, and so many of each row; a branch's labels say something from OWN on.
MANY, MANY_SHARE, OWN = 8, 0.2, 8
#: Standard errors under which a branch's labels are like its siblings'.
SIMILAR = 2.0
#: Labelled rows that a prior weighs.
PRIOR = 8.0
#: The most templates, and bytes of them, that are broadcast; with more they are joined by a shuffle.
BROADCAST_TEMPLATES, BROADCAST_BYTES = 100_000, 16 << 20

Rule = tuple[str, str]
RULES: list[Rule] = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule ``host/path`` that fits a host or its parent domains and begins the path; null without one."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, begin = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + begin)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def shapes_of(path: Column, depth: int = DEPTH) -> Column:
    """A path's segments with runs of digits as ``{n}`` and long hexadecimal words as ``{h}``, ``depth`` at most."""
    hexed = F.regexp_replace(path, r"(?<=^|[/._-])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}(?=$|[/._-])", "{h}")
    return F.slice(F.split(F.regexp_replace(hexed, "[0-9]+", "{n}"), "/", depth + 1), 2, depth)


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, shapes, template, purity) of the tree over ``pages`` (host, shapes, labelled 0 or 1, bad 0 or 1).

    Rows are first summed by host and shapes, so a host of any size is as many rows as it has shapes. Level by level,
    two kinds of a node's branches become one wildcard: in a variable (``MANY``, ``MANY_SHARE``) those with under
    ``OWN`` labels, which say little; and those with more whose share of bad labels is within ``SIMILAR`` standard
    errors of their siblings'. A branch that nothing is known of keeps its name where its node is no variable. A
    template's purity is its share of good labels, smoothed with ``PRIOR`` rows of its host's share, itself smoothed
    with that of all.
    """
    held = cut(pages.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")).withColumn("prefix", F.lit("")))
    deepest = held.agg(F.max(F.size("shapes"))).first()[0] or 0
    for level in range(deepest):
        deep = held.where(F.size("shapes") > level).withColumn("seg", F.get("shapes", F.lit(level)))
        kids = deep.groupBy("host", "prefix", "seg").agg(*(F.sum(c).alias(c) for c in "nlb"))
        nodes = kids.groupBy("host", "prefix").agg(F.count("*").alias("k"), *(F.sum(c).alias(c.upper()) for c in "nlb"))
        joined = kids.join(nodes.select("host", "prefix", "k", F.col("N").alias("all"), F.col("L").alias("ll"), F.col("B").alias("bb")), ["host", "prefix"])
        rest, rate = F.col("ll") - F.col("l"), (F.col("bb") + 1.0) / (F.col("ll") + 2.0)
        error = F.sqrt(rate * (1 - rate) * (1.0 / F.col("l") + 1.0 / rest))
        known = F.coalesce((F.col("l") >= OWN) & (rest > 0), F.lit(False))
        alike = known & (F.abs(F.col("b") / F.col("l") - (F.col("bb") - F.col("b")) / rest) <= SIMILAR * error)
        variable = (F.col("k") >= MANY) & (F.col("k") > MANY_SHARE * F.col("all"))
        named = joined.select("host", "prefix", "seg", F.when((variable & (F.col("l") < OWN)) | F.coalesce(alike, F.lit(False)), F.lit("*")).otherwise(F.col("seg")).alias("to"))
        moved = deep.join(named, ["host", "prefix", "seg"]).select("host", "shapes", "n", "l", "b", F.concat("prefix", F.lit("/"), "to").alias("prefix"))
        held = cut(moved.unionByName(held.where(F.size("shapes") <= level)))
    total = held.agg(F.sum("l"), F.sum("b")).first()
    bad = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    hosts = held.groupBy("host").agg(((F.sum("b") + PRIOR * bad) / (F.sum("l") + PRIOR)).alias("host_bad"))
    sums = held.groupBy("host", "prefix").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).join(hosts, "host")
    pure = sums.select("host", "prefix", (1 - (F.col("b") + PRIOR * F.col("host_bad")) / (F.col("l") + PRIOR)).alias("purity"))
    return held.join(pure, ["host", "prefix"]).select("host", "shapes", F.col("prefix").alias("template"), F.round("purity", 9).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules: list[Rule] = RULES, least: float = 0.5, depth: int = DEPTH) -> DataFrame:
    """One row (key, host, path, rule, verdict, template, purity) for each page.

    ``labels`` has rows (key, bad 0 or 1). The verdict is that of the longest fitting rule, else ``allow`` where the
    purity of the page's template is ``least`` or more. A null URL, or one without ``://``, has an empty host and
    path and is judged as the template of those. A null key takes no label; of several labels for a key the worst
    holds; repeated rows are judged each. Without any label a template's purity is 0.5. Empty tables give no rows;
    other columns are not read.
    """
    worst = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col("bad").cast("int")).alias("bad")).where("bad IN (0, 1)")
    parsed = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    shaped = parsed.withColumn("shapes", shapes_of(F.col("path"), depth))
    known = shaped.join(worst, "key", "left").select("host", "shapes", F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    tree = cut(templates(known))
    size = tree.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("template") + F.octet_length(F.concat_ws("/", "shapes"))), F.lit(0))).first()
    tree = F.broadcast(tree) if size[0] <= BROADCAST_TEMPLATES and size[1] <= BROADCAST_BYTES else tree
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*(F.lit(x) for verdict, name in rules for x in (name, verdict))) if rules else None
    found = shaped.join(tree, ["host", "shapes"]).withColumn("rule", rule)
    own = F.when(F.col("purity") >= least, "allow").otherwise("block")
    return found.select(F.col("key").alias(key), "host", "path", "rule", (F.coalesce(verdicts[F.col("rule")], own) if rules else own).alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (page_id, bad) of pages through the document whose id is the last number of their path.

    A page is bad where its document has quality 0 or is toxic. Numbers beyond 18 digits name no document.
    """
    document = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})(?![0-9])[^0-9]*$", 1)
    named = pages.select("page_id", F.when(document != "", document).cast("long").alias("doc_id"))
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return named.where("doc_id IS NOT NULL").join(bad, "doc_id").select("page_id", "bad")
