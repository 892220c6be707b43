"""Scores of reconstructions against truth. Nothing that reconstructs imports this package."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.text import is_annex, is_renumbering, is_repealed_stub
from chronofold.operators import numbering, oplog
from chronofold.operators.align import similarity, spread

STRICT, OCR, CONTAMINATED, GATE = 0.98, 0.90, 0.999, 0.97


def rate(hit: Column) -> Column:
    """The share of rows for which something holds, as double."""
    return F.avg(F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)))


def compared(recon: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """``truth`` (key, text) with the reconstruction's text, empty where there is none, and their similarity."""
    joined = spread(truth.select(*key, F.col("text").alias("truth")), *key).join(spread(recon.select(*key, F.col("text").alias("recon")), *key), key, "left")
    return joined.withColumn("recon", F.coalesce("recon", F.lit(""))).withColumn("sim", similarity(F.col("recon"), F.col("truth")))


def in_scope(truth: DataFrame, stubs: bool) -> DataFrame:
    """Provisions that count: no convention annexes, and with ``stubs`` no placeholders of repealed ones (those of today only)."""
    kept = truth.where(~is_annex(F.col("para")))
    return kept.where(~is_repealed_stub(F.col("text"))) if stubs else kept


def tau(is_ocr: Column) -> Column:
    return F.when(is_ocr, F.lit(OCR)).otherwise(F.lit(STRICT))


def law_scores(scored: DataFrame, by: list[str], bar: Column) -> DataFrame:
    """One row for each law (and date): provisions, matched, rate, mean, and those below the bar."""
    missed = F.array_sort(F.collect_list(F.when(F.col("sim") < bar, F.struct("para", F.round("sim", 3).alias("sim")))))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("sim") >= bar, 1)).alias("matched"), rate(F.col("sim") >= bar).alias("rate"), F.avg("sim").alias("mean"), missed.alias("flags"))


def corpus_mean(per_law: DataFrame) -> DataFrame:
    """The mean of the laws' rates, each law alike, and the laws whose rate is below the strict bar."""
    below = F.array_sort(F.collect_list(F.when(F.col("rate") < STRICT, F.col("law"))))
    return per_law.agg(F.count("*").alias("n_laws"), F.round(F.avg("rate"), 4).alias("rate_mean"), below.alias("laws_below_bar"))


def convergence(recon: DataFrame, current: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row over all laws: matched at each law's bar, at the strict one, provisions, annexes, stubs, and the rates."""
    marked = current.withColumn("annex", is_annex(F.col("para"))).withColumn("stub", ~F.col("annex") & is_repealed_stub(F.col("text")))
    scored = compared(recon, marked.where("NOT annex AND NOT stub"), ["law", "para"]).join(ocr.select("law", "is_ocr").distinct(), "law", "left")
    bar = tau(F.coalesce("is_ocr", F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    sums = scored.agg(count(F.col("sim") >= bar).alias("matched"), count(F.col("sim") >= STRICT).alias("strict"), F.count("*").alias("total"))
    scope = marked.agg(count(F.col("annex")).alias("annex"), count(F.col("stub")).alias("repealed"))
    share = lambda c: (F.col(c) / F.greatest("total", F.lit(1))).alias(f"{c}_rate")
    return sums.join(scope).select("*", share("matched"), share("strict"))


def breadth(per_law: DataFrame, value: str = "rate") -> DataFrame:
    """Exact median, mean, and how many laws reach 0.90 and 0.98."""
    return per_law.agg(F.count("*").alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.count(F.when(F.col(value) >= 0.90, 1)).alias("at_90"), F.count(F.when(F.col(value) >= 0.98, 1)).alias("at_98"))


def point_in_time(folded_at: DataFrame, truth: DataFrame, ocr: DataFrame) -> DataFrame:
    """Scores by law and date; stubs stay, as what is repealed today was in force then."""
    scored = compared(folded_at, in_scope(truth, stubs=False), ["law", "date", "para"]).join(ocr.select("law", "is_ocr").distinct(), "law", "left")
    return law_scores(scored, ["law", "date"], tau(F.coalesce("is_ocr", F.lit(False))))


def fidelity(recon: DataFrame, truth: DataFrame, amended: DataFrame) -> DataFrame:
    """OCR fidelity over provisions that were never amended: n, passed at the strict bar, mean and least similarity."""
    scored = compared(recon, truth, ["law", "para"]).join(amended.select("law", "para").distinct(), ["law", "para"], "left_anti")
    return scored.agg(F.count("*").alias("n"), F.count(F.when(F.col("sim") >= STRICT, 1)).alias("passed"), F.avg("sim").alias("mean"), F.min("sim").alias("least"))


def contaminated(base: DataFrame, current: DataFrame, ops: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Amended provisions whose base is today's text: the base came from the answer.

    Only operations after the base's own date count as amendments.
    """
    late = ops.join(snapshots.select("law", "base_as_of"), "law", "left").where("para IS NOT NULL AND (base_as_of IS NULL OR date > base_as_of)")
    amended = base.join(late.select("law", "para").distinct(), ["law", "para"], "left_semi")
    return compared(amended, current, ["law", "para"]).where((F.col("sim") >= CONTAMINATED) & (F.col("recon") != "")).select("law", "para", "sim")


#: Below it a miss is another text, from it on up to the bar the same with noise; under every bar, so that each law can have both.
NEAR = 0.85
#: What each bucket of misses calls for, and how safe that is (fixed values).
LEVERS = {
    "base-missing": "base", "uncaptured-amdt": "coverage", "applied-wrong": "coverage", "engine-gap:ledd": "sub-document editor", "engine-gap:struct": "renumbering", "base-ocr-noise": "OCR", "applied-ocr-noise": "OCR",
}


def misses(scored: DataFrame, base: DataFrame, ops: DataFrame, flags: DataFrame, bar: Column) -> DataFrame:
    """Provisions below the bar with the reason for it, the first that fits.

    ``ops`` (law, para, kind, instruction) and ``flags`` are summed up by provision first, so each joins once.
    """
    seen = ops.where("para IS NOT NULL").groupBy("law", "para").agg(F.bool_or(is_renumbering(F.col("instruction"))).alias("renumbered"), F.bool_or(F.col("kind") == "subprovision").alias("part"))
    flagged = flags.where("para IS NOT NULL").select("law", "para").distinct().withColumn("flagged", F.lit(True))
    low = scored.where(F.col("sim") < bar).join(seen, ["law", "para"], "left").join(flagged, ["law", "para"], "left")
    has, flag = F.col("renumbered").isNotNull(), F.coalesce("flagged", F.lit(False))
    empty = F.when(~has, "base-missing").when(flag & F.col("renumbered"), "engine-gap:struct").when(flag & F.col("part"), "engine-gap:ledd").otherwise("base-missing")
    wrong = F.when(flag & F.coalesce("renumbered", F.lit(False)), "engine-gap:struct").when(flag, "engine-gap:ledd").when(~has, F.when(F.col("sim") < NEAR, "uncaptured-amdt").otherwise("base-ocr-noise")).otherwise(F.when(F.col("sim") < NEAR, "applied-wrong").otherwise("applied-ocr-noise"))
    return low.select("law", "para", F.when(F.col("recon") == "", empty).otherwise(wrong).alias("bucket"), "sim")


def miss_table(missed: DataFrame) -> DataFrame:
    """Counts of buckets by law, and over all laws (law null), with the lever."""
    table = F.create_map(*(F.lit(x) for pair in LEVERS.items() for x in pair))
    return missed.groupingSets([[F.col("law"), F.col("bucket")], [F.col("bucket")]], "law", "bucket").agg(F.count("*").alias("n")).withColumn("lever", F.try_element_at(table, F.col("bucket")))


def examples(missed: DataFrame, most: int = 12) -> DataFrame:
    """The worst misses (bucket, place from 0, law, para, sim) of each bucket, ``most`` at most; ties by law and provision."""
    worst = numbering.top_of_each(missed, ["bucket"], [F.col("sim"), F.col("law"), F.col("para")], most)
    return worst.select("bucket", (F.col("place") - 1).alias("place"), "law", "para", "sim")


def verdict(row, guards: dict[str, list[str]] | None = None) -> int:
    """The gate's exit code: 3 where a guard has findings, which no rate outweighs; 0 where the matched rate reaches the bar; else 1."""
    if any((guards or {}).values()):
        return 3
    return 0 if row["matched_rate"] >= GATE else 1


def imports_of(source: str) -> set[str]:
    """The modules that a Python source imports, wherever it does."""
    found = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found |= {name.name for name in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module, *(f"{node.module}.{name.name}" for name in node.names)}
    return found


def guards(sources: dict[str, str], contaminations: DataFrame, held: str = "chronofold.evaluate") -> dict[str, list[str]]:
    """Findings by guard: sources (name to text) of the reconstruction that import what is held out, and contaminated bases."""
    leaks = [name for name, source in sorted(sources.items()) if any(m == held or m.startswith(held + ".") for m in imports_of(source))]
    bases = [f"{r['law']} {r['para']}" for r in contaminations.select("law", "para").orderBy("law", "para").limit(100).collect()]  # a report; one is enough to fail
    return {"import": leaks, "base": bases}


def snapshot(row, guards_found: dict[str, list[str]], laws: DataFrame, sources: dict[str, DataFrame]) -> dict:
    """A status as plain values: the score, the guards' findings, laws by their rate, and rows by source."""
    return {
        "matched": row["matched"], "total": row["total"], "rate": row["matched_rate"], "exit": verdict(row, guards_found), "guards": guards_found,
        "laws": breadth(laws).first().asDict(), "sources": {name: rows.count() for name, rows in sources.items()},
    }


def render(row) -> str:
    """A status line in Markdown."""
    return f"| {row['matched']}/{row['total']} | {row['matched_rate']:.4f} | strict {row['strict']}/{row['total']} | annexes {row['annex']} | repealed {row['repealed']} | {'PASS' if verdict(row) == 0 else 'IN PROGRESS'} |"


def histogram(rows: DataFrame, by: str) -> DataFrame:
    """Rows (``by``, n): how many rows there are of each kind, null being one."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def coverage(versions: DataFrame) -> DataFrame:
    """One row (laws, versions) over truth versions (law, date): distinct laws, and distinct versions of them."""
    return versions.select("law", "date").distinct().agg(F.countDistinct("law").alias("laws"), F.count("*").alias("versions"))


def unresolved_reasons(lost: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows (reason, n, place) of operations that found no target: the most common reason first, ties by its name."""
    counts = histogram(lost.where(F.col(reason).isNotNull()), reason)
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), reason)))  # a row for each reason


def replayed(ops: DataFrame, folded: DataFrame, current: DataFrame) -> DataFrame:
    """One row (law, n_ops, reach, scored, matched, flagged) for each law of a log typed by kind that was folded from nothing.

    Within reach are provisions whose last operation gives their whole text; those that the current text has are scored.
    """
    reach = oplog.reconstructable(ops).select("law", "para")
    scored = compared(folded.select("law", "para", "text"), current.join(reach, ["law", "para"], "left_semi"), ["law", "para"])
    count = lambda rows, name: rows.groupBy("law").agg(F.count("*").alias(name))
    hits = scored.groupBy("law").agg(F.count("*").alias("scored"), F.count(F.when(F.col("sim") >= STRICT, 1)).alias("matched"))
    flagged = folded.groupBy("law").agg(F.sum(F.coalesce(F.size("flags"), F.lit(0))).cast("long").alias("flagged"))
    out = count(ops, "n_ops").join(count(reach, "reach"), "law", "left").join(hits, "law", "left").join(flagged, "law", "left")
    return out.select("law", "n_ops", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("reach", "scored", "matched", "flagged")))
