"""Grounding (G1–G7): keep the facts whose value can be found in the text.

Per (entity, fact) row with the entity's abstract joined on the entity key
(J1, an equi-join — never documents × values); the date list of an abstract
is extracted once per row by regex patterns (G3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import label_is_special, simplify_label

L = F.lit

# Month names and date layouts recognised in free text (fixed values).
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
_M = "(?:" + "|".join(MONTHS) + ")"
DATE_LAYOUTS = [
    (_M + r" [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"),
    (r"[0-9]{1,2} " + _M + r" [0-9]{4}", "d MMMM yyyy"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"),
]


def extract_dates(text: Column) -> Column:
    """Every date in the text, any of the layouts, as distinct yyyy-MM-dd."""
    def parse(fmt):
        return lambda x: F.date_format(F.try_to_date(x, fmt), "yyyy-MM-dd")
    per_layout = [F.transform(F.regexp_extract_all(text, L(rx), 0), parse(fmt)) for rx, fmt in DATE_LAYOUTS]
    return F.array_distinct(F.filter(F.flatten(F.array(*per_layout)), lambda d: d.isNotNull()))


def found_string(abstract: Column, value: Column) -> Column:
    """G1 case-insensitive substring, G2 accent-insensitive fallback."""
    g1 = F.contains(F.lower(abstract), F.lower(value))
    g2 = F.contains(F.collate(abstract, "UNICODE_CI_AI"), F.collate(value, "UNICODE_CI_AI"))
    return g1 | g2


def grounded_value(abstract: Column, dates: Column, value: Column, datatype: Column) -> Column:
    """G4/G5/G6 cascade by datatype; returns the value kept (the simplified
    label when only that was found), or null."""
    date_hit = F.array_contains(dates, value)
    year_hit = F.exists(dates, lambda d: F.substring(d, 1, 4) == value)
    simple = simplify_label(value)
    s_hit = found_string(abstract, value)
    s2_hit = label_is_special(value) & (simple != "") & found_string(abstract, simple)
    return (F.when(datatype == "xsd:date", F.when(date_hit, value))
            .when(datatype == "xsd:gYear", F.when(year_hit, value))
            .otherwise(F.when(s_hit, value).when(s2_hit, simple)))
