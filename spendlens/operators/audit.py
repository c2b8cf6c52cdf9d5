"""All audit reports of an export from the one pass that writes its snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.text import is_tagged
from ..sources.files import snapshot
from .clean import default_rules, drop_tagged_dups, identities


def _null_counts(df: DataFrame) -> dict[tuple[str, str, str], Column]:
    return {("nulls", c, "nulls"): F.count_if(F.col(c).isNull()) for c in df.columns}


def _row_counts(df: DataFrame, exact_like: bool) -> dict[tuple[str, str, str], Column]:
    return {
        ("rows", "raw", "rows"): F.count(F.lit(1)),
        ("rows", "tagged_duplicates", "rows"): F.count_if(is_tagged("row_id", exact_like=exact_like)),
    }


def _rule_counts(rules: Mapping[str, Column]) -> dict[tuple[str, str, str], Column]:
    out = {}
    for name, holds in rules.items():
        out["rules", name, "broken_rows"] = F.count_if(~holds)
        out["rules", name, "unchecked_rows"] = F.count_if(holds.isNull())
    return out


def _identity_counts(tolerance: float) -> dict[tuple[str, str, str], Column]:
    out = {}
    for name, (stored, formula) in identities().items():
        gap = F.abs(F.col(stored).cast("double") - formula)
        out["identities", name, "checked_rows"] = F.count(gap)
        out["identities", name, "mismatches"] = F.count_if(rnd(gap, 8) > tolerance)
        out["identities", name, "one_sided_nulls"] = F.count_if(F.col(stored).isNull() != formula.isNull())
        out["identities", name, "largest_gap"] = rnd(F.max(gap), 6)
    return out


def _observed(df: DataFrame, metrics: Mapping[tuple[str, str, str], Column]) -> tuple[DataFrame, Observation]:
    watch = Observation()
    return df.observe(watch, *[m.alias("|".join(name)) for name, m in metrics.items()]), watch


def audited_snapshot(
    raw: DataFrame,
    path: str,
    version: int,
    rules: Mapping[str, Column] | None = None,
    tolerance: float = 0.01,
    exact_like: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Write the rows without tagged duplicates as a snapshot; return it and the audit of the export.

    The audit (report, item, figure, value) holds the NULL count of each column
    and the rows and tagged duplicates of ``raw``, and for the rows that were
    written their number, the broken and unchecked rows of each rule and the
    figures of each identity: what ``null_audit``, ``count_tagged_dups``,
    ``validate``, ``check_identities`` and a count give, each with a pass of its
    own. Here they are observed while the snapshot is written, so the export is
    read once. A retried task is counted once.

    Counts over no rows are 0, the largest gap of no rows is NULL.
    """
    watched, of_raw = _observed(raw, _null_counts(raw) | _row_counts(raw, exact_like))
    kept = drop_tagged_dups(watched, exact_like)
    written = {("rows", "written", "rows"): F.count(F.lit(1))}
    kept, of_kept = _observed(kept, written | _rule_counts(dict(rules or default_rules())) | _identity_counts(tolerance))
    stored = snapshot(kept, path, version)
    figures = [(*name.split("|"), None if v is None else float(v)) for watch in (of_raw, of_kept) for name, v in watch.get.items()]
    report = raw.sparkSession.createDataFrame(figures, "report string, item string, figure string, value double")
    return stored, report
