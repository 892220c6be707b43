"""What did law L say on date t: all laws in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronofold.operators import fold, oplog


def _log(bases: DataFrame, streams: list[DataFrame], date: str | None, recovery: int | None, overrides: DataFrame | None) -> DataFrame:
    raw = oplog.union(*streams)
    if overrides is not None:
        raw = oplog.override(raw, overrides, ["act_refid", "target_law", "instruction"], "new_text")
    ops = oplog.load(raw, len(streams) if recovery is None else recovery)
    return oplog.as_of(oplog.since_snapshot(ops, bases.select("law", "base_as_of").distinct()), date)


def reconstruct(bases: DataFrame, streams: list[DataFrame], date: str | None = None, recovery: int | None = None, overrides: DataFrame | None = None, reforms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(provisions, flags) of all laws as of a date (null: today).

    ``bases`` (law, para, text, base_as_of), ``streams`` raw operations in order of rank, of which those from index
    ``recovery`` on only fill gaps. Overrides replace cut-off payloads; a snapshot base takes later operations only;
    reforms come last, whatever their date among the operations.
    """
    folded = fold.fold(bases.select("law", "para", "text"), _log(bases, streams, date, recovery, overrides))
    provisions = fold.provisions(folded)
    return (provisions if reforms is None else fold.reform(provisions, reforms, date)), fold.flags(folded)


def state(bases: DataFrame, streams: list[DataFrame], date: str | None = None, recovery: int | None = None, overrides: DataFrame | None = None, reforms: DataFrame | None = None) -> DataFrame:
    """The provisions of ``reconstruct`` alone, from a compacted log: what a provision's last whole text replaced is not folded."""
    provisions = fold.state_at(bases.select("law", "para", "text"), _log(bases, streams, date, recovery, overrides))
    return provisions if reforms is None else fold.reform(provisions, reforms, date)
