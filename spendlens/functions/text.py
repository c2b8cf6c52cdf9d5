"""Text clean-up expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import DUPLICATE_TAG, NAME_SUFFIXES
from .numeric import as_column


def is_tagged(row_id: Column | str, tag: str = DUPLICATE_TAG, exact_like: bool = False) -> Column:
    """Does the id end with ``tag``?

    ``exact_like`` gives the literal LIKE pattern instead, in which the
    underscore stands for any one character ('Adup' matches '%_dup').
    """
    column = as_column(row_id)
    return column.like(f"%{tag}") if exact_like else column.endswith(tag)


def without_suffix(name: Column | str, suffixes: Iterable[str] = NAME_SUFFIXES, stacked: bool = False) -> Column:
    """Drop one trailing suffix, or with ``stacked`` every trailing suffix."""
    choice = "|".join(re.escape(s) for s in suffixes)
    return F.regexp_replace(as_column(name), f"({choice}){'+' if stacked else ''}$", "")


def spelling_key(value: Column | str) -> Column:
    return F.lower(F.trim(as_column(value)))


def canonical(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Canonical spelling from ``mapping`` (lower-case key -> spelling); NULL if unmapped."""
    pairs = [F.lit(text) for key, spelling in mapping.items() for text in (key.strip().lower(), spelling)]
    return F.try_element_at(F.create_map(*pairs), spelling_key(value))


def spellings(values: Iterable[str]) -> dict[str, str]:
    """Mapping for ``canonical`` that restores the case of the given values."""
    return {v.strip().lower(): v for v in values}
