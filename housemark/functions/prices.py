"""Column expressions that clean and label price-paid rows."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from housemark.schemas import OLD_NEW, POSTCODE_AREA_PATTERN, PROPERTY_TYPES


def decode(code: Column, meanings: Mapping[str, str]) -> Column:
    """Replace known codes; anything else, NULL included, passes through."""
    (first, meaning), *rest = meanings.items()
    cases = F.when(code == first, meaning)
    for value, text in rest:
        cases = cases.when(code == value, text)
    return cases.otherwise(code)


def decode_by_map(code: Column, meanings: Mapping[str, str]) -> Column:
    """The same through a literal map, filled from the code where it has no entry."""
    entries = F.create_map(*[F.lit(part) for pair in meanings.items() for part in pair])
    return F.coalesce(F.try_element_at(entries, code), code)


def decode_property_type(code: Column) -> Column:
    return decode(code, PROPERTY_TYPES)


def decode_old_new(code: Column) -> Column:
    return decode(code, OLD_NEW)


def postcode_area(postcode: Column, no_match_as_null: bool = False) -> Column:
    """Leading one or two capitals; without any, ``''`` or on request NULL."""
    area = F.regexp_extract(postcode, POSTCODE_AREA_PATTERN, 1)
    return F.nullif(area, F.lit("")) if no_match_as_null else area


def month_tag(date: Column) -> Column:
    return F.date_format(date, "yyyy_MM")


def year_month(year: Column, month: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))
