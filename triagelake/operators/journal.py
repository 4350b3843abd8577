"""Batch journals as tables: pairing, orphans, diagnostics, counters.

Journal rows are (sequence, entry_id, path, record_type admission or terminal, status, reason,
report_id, location, selected_bytes, has_actionable). Every check is a relation that must be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("complete", "limited", "failed", "skipped", "cancelled")


def entries(journal: DataFrame) -> DataFrame:
    """One row for each entry: its admission joined to its terminal record."""
    admitted = journal.where("record_type = 'admission'").select("entry_id", F.col("sequence").alias("admitted"), F.col("path").alias("admitted_path"))
    ended = journal.where("record_type = 'terminal'").select("entry_id", F.col("sequence").alias("ended"), "path", "status", "reason", "report_id", "location", "selected_bytes", "has_actionable")
    return admitted.join(ended, "entry_id", "full_outer")


def pair_faults(journal: DataFrame) -> DataFrame:
    """Entries without an end, with other paths, ends before admission, or admissions of skipped entries."""
    e = entries(journal)
    fault = (
        F.when(F.col("ended").isNull(), "no_terminal")
        .when((F.col("status") == "skipped") & F.col("admitted").isNotNull(), "skipped_admitted")
        .when((F.col("status") != "skipped") & F.col("admitted").isNull(), "not_admitted")
        .when(F.col("admitted_path") != F.col("path"), "path_differs")
        .when(F.col("ended") <= F.col("admitted"), "order")
    )
    return e.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("entry_id", "fault")


def gaps(journal: DataFrame) -> DataFrame:
    """One row: whether sequences and entry ids are 1..n without gaps, counted without a sort."""
    return journal.agg(
        (F.count_distinct("sequence") == F.max("sequence")).alias("sequences_gapless"),
        (F.count_distinct("entry_id") == F.max("entry_id")).alias("entries_gapless"),
        (F.count(F.lit(1)) == F.count_distinct("sequence")).alias("sequences_unique"),
    )


def duplicates(journal: DataFrame, column: str = "path") -> DataFrame:
    """Paths (or reports) of more than one terminal record."""
    ended = journal.where((F.col("record_type") == "terminal") & F.col(column).isNotNull())
    return ended.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(artifacts: DataFrame, journal: DataFrame) -> DataFrame:
    """Artifacts (location) that no terminal record names."""
    return artifacts.join(journal.where("location IS NOT NULL").select("location").distinct(), "location", "left_anti")


def diagnostic_faults(errors: DataFrame, journal: DataFrame) -> DataFrame:
    """File diagnostics without an entry that explains them, and failures without a diagnostic."""
    ended = journal.where("record_type = 'terminal'").select("entry_id", "status", "reason")
    of_file = errors.where("scope = 'file'")
    linked = of_file.join(ended, "entry_id", "left")
    ok = ((F.col("status") == "failed") & (F.col("reason") == F.col("code"))) | (F.col("status") == "limited")
    loose = linked.where(~F.coalesce(ok, F.lit(False))).select("entry_id", F.lit("unexplained_diagnostic").alias("fault"))
    silent = ended.where("status = 'failed'").join(of_file.select("entry_id").distinct(), "entry_id", "left_anti").select("entry_id", F.lit("failure_without_diagnostic").alias("fault"))
    return loose.unionByName(silent)


def counters(journal: DataFrame) -> DataFrame:
    """The counters recomputed from the journal."""
    t = journal.where("record_type = 'terminal'")
    s = lambda x: F.count_if(F.col("status") == x)
    return t.agg(
        F.count(F.lit(1)).alias("observed_entries"), F.count_if(F.col("status") != "skipped").alias("eligible"), s("complete").alias("complete"), s("limited").alias("limited"), s("failed").alias("failed"),
        s("cancelled").alias("cancelled"), s("skipped").alias("policy_skipped"),
        F.count_if("has_actionable").alias("files_with_indicators"), F.count_if(F.col("has_actionable") & (F.col("status") == "limited")).alias("limited_files_with_indicators"),
    )


def selected_bytes(journal: DataFrame) -> DataFrame:
    """Reported totals; the eligible total is null while an eligible entry is unreported."""
    t = journal.where("record_type = 'terminal' AND status <> 'skipped'")
    out = t.agg(F.coalesce(F.sum("selected_bytes"), F.lit(0)).alias("reported_total"), F.count("selected_bytes").alias("reported_entries"), F.count_if(F.col("selected_bytes").isNull()).alias("unreported_eligible_entries"))
    return out.withColumn("eligible_total", F.when(F.col("unreported_eligible_entries") == 0, F.col("reported_total")))


def outcome_reasons(journal: DataFrame) -> DataFrame:
    """How often each reason of failed, skipped and cancelled entries occurs."""
    return journal.where("record_type = 'terminal' AND reason IS NOT NULL").groupBy(F.col("status").alias("outcome"), "reason").agg(F.count(F.lit(1)).alias("entries"))


def exit_code(counts: dict, discovery_complete: bool = True, interrupted: bool = False) -> int:
    """0 complete, 1 something failed, was limited or cut short, 130 interrupted."""
    if interrupted:
        return 130
    return int(not discovery_complete or any(counts.get(k, 0) for k in ("failed", "limited", "cancelled", "discovery_errors")))
