"""Label ladders: ordered conditions, first match wins, an ELSE label at the end.

A NULL input makes a condition unknown, so the row falls through to the ELSE
label. That is kept; ``flag_nulls`` adds a column that tells such rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..labels import (
    FATIGUE_BANDS,
    FATIGUE_STATUS,
    PERFORMANCE_CATEGORIES,
    PROFIT_STATUS,
    RECOMMENDATION,
    SCALABILITY,
)
from .numeric import as_column, exact


@dataclass(frozen=True)
class Ladder:
    """``branches`` of (condition, label), the ELSE label and the columns they read."""

    branches: tuple[tuple[Column, str], ...]
    otherwise: str
    inputs: tuple[Column, ...]

    def _choose(self, values: Sequence[Column], default: Column) -> Column:
        pairs = list(zip((c for c, _ in self.branches), values))
        first_condition, first_value = pairs[0]
        chain = F.when(first_condition, first_value)
        for condition, value in pairs[1:]:
            chain = chain.when(condition, value)
        return chain.otherwise(default)

    @property
    def label(self) -> Column:
        return self._choose([F.lit(text) for _, text in self.branches], F.lit(self.otherwise))

    @property
    def rank(self) -> Column:
        """Position of the branch that matched, from 1; the ELSE branch is last."""
        positions = [F.lit(i + 1) for i in range(len(self.branches))]
        return self._choose(positions, F.lit(len(self.branches) + 1))

    @property
    def is_null_input(self) -> Column:
        return reduce(Column.__or__, (c.isNull() for c in self.inputs))

    def columns(self, name: str, flag_nulls: bool = False) -> list[Column]:
        found = [self.label.alias(name)]
        if flag_nulls:
            found.append(self.is_null_input.alias(f"{name}_is_null_input"))
        return found

    def add_to(self, df: DataFrame, name: str, flag_nulls: bool = False) -> DataFrame:
        return df.select("*", *self.columns(name, flag_nulls))


def below(value: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Ladder:
    """``labels[i]`` where value < ``cuts[i]``, the last label from the last cut on."""
    column = as_column(value)
    steps = tuple((column < exact(cut), text) for cut, text in zip(cuts, labels))
    return Ladder(steps, labels[-1], (column,))


def at_least(value: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Ladder:
    """``labels[i]`` where value >= ``cuts[i]``, tried from the first cut on."""
    column = as_column(value)
    steps = tuple((column >= exact(cut), text) for cut, text in zip(cuts, labels))
    return Ladder(steps, labels[-1], (column,))


def fatigue_status(score, cuts=(4, 7), labels=FATIGUE_STATUS) -> Ladder:
    """Fatigue bucket; the half-open edges are assumed (the source says 0-4, 4-7, 7-10)."""
    return below(score, cuts, labels)


def fatigue_band(score, edges=(2, 4, 6, 8), labels=FATIGUE_BANDS) -> Ladder:
    return below(score, edges, labels)


def profit_status(profit, labels=PROFIT_STATUS) -> Ladder:
    gained = as_column(profit)
    return Ladder(((gained > 0, labels[0]), (gained == 0, labels[1])), labels[2], (gained,))


def scalability(roas, breakeven, status, statuses=FATIGUE_STATUS, labels=SCALABILITY) -> Ladder:
    """Scale and monitor what clears breakeven, optimise what is fresh but does not."""
    roas, breakeven, status = map(as_column, (roas, breakeven, status))
    clears, fresh, tiring = roas >= breakeven, status == statuses[0], status == statuses[1]
    return Ladder(
        (
            (clears & fresh, labels[0]),
            (clears & tiring, labels[1]),
            ((roas < breakeven) & fresh, labels[2]),
        ),
        labels[3],
        (roas, breakeven, status),
    )


def recommendation(
    profit, roas, breakeven, fatigue, strong=1.2, near=0.9, worn=5, labels=RECOMMENDATION
) -> Ladder:
    """Budget advice. A profitable, fresh ad with ROAS under ``strong`` x breakeven
    meets no condition and gets the ELSE label."""
    profit, roas, breakeven, fatigue = map(as_column, (profit, roas, breakeven, fatigue))
    earns = profit > 0
    return Ladder(
        (
            (earns & (roas >= breakeven * exact(strong)) & (fatigue < exact(worn)), labels[0]),
            (earns & (fatigue >= exact(worn)), labels[1]),
            ((profit <= 0) & (roas >= breakeven * exact(near)), labels[2]),
        ),
        labels[3],
        (profit, roas, breakeven, fatigue),
    )


def performance_category(
    roas, breakeven, cuts=(1.5, 1.05, 0.95), floor=1.5, labels=PERFORMANCE_CATEGORIES
) -> Ladder:
    """Five classes of ROAS against breakeven; all cut points are assumed."""
    roas, breakeven = as_column(roas), as_column(breakeven)
    steps = [(roas >= breakeven * exact(cut), text) for cut, text in zip(cuts, labels)]
    steps.append((roas >= exact(floor), labels[3]))
    return Ladder(tuple(steps), labels[4], (roas, breakeven))


def position_in(value: Column | str, order: Sequence[str]) -> Column:
    """Position of a label in a listed order, for ORDER BY; unlisted labels share the last place."""
    column = as_column(value)
    chain = F.when(column == order[0], F.lit(1))
    for place, text in enumerate(order[1:-1], start=2):
        chain = chain.when(column == text, F.lit(place))
    return chain.otherwise(F.lit(len(order)))
