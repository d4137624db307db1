"""Traits of a person: age, age band, birth-year class, class codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_YEAR = 2020
# fixed values
GENDER_CODES = {"male": 0, "female": 1}
OCCUPATION_CODES = {"sports": 0, "performer": 1, "creator": 2, "politics": 3}
BIRTHYEAR_CLASSES = ((1940, 1955, 1947), (1956, 1969, 1963), (1970, 1980, 1975), (1981, 1989, 1985), (1990, 1999, 1994))
AGE_BANDS = ("<20", "20-29", "30-39", "40-49", "50+", "unknown")


def age(birthyear: Column, year: int = REFERENCE_YEAR) -> Column:
    return F.lit(year) - birthyear


def age_band(birthyear: Column, year: int = REFERENCE_YEAR) -> Column:
    """Band of ten years; a null birth year has none."""
    years = age(birthyear, year)
    band = F.when(years < 20, AGE_BANDS[0]).when(years < 30, AGE_BANDS[1]).when(years < 40, AGE_BANDS[2]).when(years < 50, AGE_BANDS[3])
    return F.when(years.isNotNull(), band.otherwise(AGE_BANDS[4]))


def birthyear_class(birthyear: Column) -> Column:
    """Centre of the class that holds the year; null outside all classes."""
    out = F.lit(None).cast("int")
    for low, high, centre in BIRTHYEAR_CLASSES:
        out = F.when(birthyear.between(low, high), F.lit(centre)).otherwise(out)
    return out


def encode(value: Column, codes: Mapping[str, int]) -> Column:
    """Code of a class name; null for an unknown one, which ``evaluate.unknown_classes`` lists."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), value)


def decode(code: Column, codes: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for name, n in codes.items() for x in (n, name)]), code.cast("int"))


def band_order(group: Column) -> Column:
    """Sort key of age bands: the bands in order, then any other group."""
    place = F.array_position(F.array(*[F.lit(b) for b in AGE_BANDS]), group)
    return F.coalesce(F.nullif(place, F.lit(0)), F.lit(999))
