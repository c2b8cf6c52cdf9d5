"""Calendar attributes of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_COLUMNS = (
    "day_of_week",
    "week_number",
    "month_number",
    "month_name",
    "quarter",
    "quarter_label",
    "year",
    "year_quarter",
    "year_month",
    "is_weekend",
)


def calendar(day: str = "date") -> list[Column]:
    """The ten attributes in ``CALENDAR_COLUMNS``.

    Weeks are ISO weeks; ``year_quarter`` and ``year_month`` sort in time order
    as text; Saturday and Sunday are the weekend.
    """
    return [
        F.expr(f"{sql} as {name}")
        for name, sql in {
            "day_of_week": f"date_format({day}, 'EEEE')",
            "week_number": f"weekofyear({day})",
            "month_number": f"month({day})",
            "month_name": f"date_format({day}, 'MMMM')",
            "quarter": f"quarter({day})",
            "quarter_label": f"concat('Q', quarter({day}))",
            "year": f"year({day})",
            "year_quarter": f"concat(year({day}), '-Q', quarter({day}))",
            "year_month": f"date_format({day}, 'yyyy-MM')",
            "is_weekend": f"dayofweek({day}) in (1, 7)",
        }.items()
    ]
