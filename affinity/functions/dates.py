"""The loosely written dates of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms, first that fits (month before day where both can be meant).
DATE_FORMATS = ["d MMM y", "d MMMM y", "MMM d, y", "MMMM d, y", "yyyy-M-d", "M/d/yy", "M/d/yyyy", "d/M/yyyy"]
#: Shapes that the forms may have; years of the two-digit form from 69 on are in the last century.
_SHAPES = [r"\d{1,2} \p{L}+ \d{4}", r"\d{1,2} \p{L}+ \d{4}", r"\p{L}+ \d{1,2}, \d{4}", r"\p{L}+ \d{1,2}, \d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}/\d{1,2}/\d{4}"]


def parse_connected_on(raw: Column) -> Column:
    """The date, or NULL."""
    s = F.btrim(F.regexp_replace(raw, r"(?U)\s+", " "))
    tries = []
    for form, shape in zip(DATE_FORMATS, _SHAPES):
        d = F.try_to_date(F.when(s.rlike(f"^{shape}$"), s), form)
        if form == "M/d/yy":
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
        tries.append(d)
    return F.coalesce(*tries)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")
