"""The recovery sweep: quotes that a model gave for whole acts become verified operations, or say why they don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import text as t
from chronofold.operators import segment

HEAD = 80


def recover(acts: DataFrame, mentions: DataFrame, quotes: DataFrame, targets: DataFrame, source: str = "recovered") -> DataFrame:
    """Recovered operations and dead letters of acts (act, text), all acts in one plan.

    ``mentions`` (act, n, anchor, cite) are the laws that an act is said to amend, ``quotes`` (act, part, n, para, unit,
    kind, head, tail) the operations of its section ``part``, counted from 0 among the sections found; ``targets`` (law)
    bounds the laws wanted. Rows without a ``reason`` are operations (with a ``flag`` where a payload's words are not the
    section's own), the others mentions that came to nothing: not found, or a section without a cue of amendment. An
    act's own law is none of its targets. ``writers.recovered`` takes the two apart.
    """
    located = segment.located_targets(acts, mentions, ["act"])
    lost = located.where("reason IS NOT NULL").select("act", "reason", "cite", F.substring("anchor", 1, HEAD).alias("anchor"))
    wanted = located.where("reason IS NULL AND target_law <> act").join(targets.select(F.col("law").alias("target_law")).distinct(), "target_law", "left_semi")
    amends = t.is_amendatory(F.col("section"))
    idle = wanted.where(~amends).select("act", F.lit("no-amendatory-cue").alias("reason"), F.concat(F.lit("lov/"), "target_law").alias("cite"), F.substring(t.squeeze(F.col("section")), 1, HEAD).alias("anchor"))
    sections = wanted.where(amends).select("act", F.col("place").alias("part"), "target_law", "section")
    ops = segment.verified_ops(sections, quotes, ["act", "part"]).join(sections.drop("section"), ["act", "part"])
    good = ops.select("act", "target_law", F.col("para").alias("paragraph"), "change_type", "instruction", "new_text", "flag", F.lit(source).alias("source"))
    return good.unionByName(lost.unionByName(idle), allowMissingColumns=True)
