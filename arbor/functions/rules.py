"""Rule tables for turning listing text into typed columns.

Rules are data: an ordered list of replaces, a table of keyword flags and a
table of extraction patterns. The operators in ``arbor.operators.textrules``
apply a whole table in one ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These must equal the reference for equal results.
# Short feature list, floor element: word replaces, applied in this order.
FLOOR_WORD_REPLACES = [
    ("Mezzanine", "1 floor"),
    ("Basement", "-1 floor"),
    ("Semi-basement", "-1 floor"),
    ("Floor -1", "-1 floor"),
    ("Floor -2", "-2 floor"),
    ("Ground", "0"),
]
# Short feature list, floor element: texts removed after the split, in order.
FLOOR_NOISE = [
    "exterior without lift",
    "interior with lift",
    "exterior with lift",
    "with lift",
    "Parking included",
    "exterior",
    "interior without lift",
    "without lift",
]
# Ordinal suffixes removed from the short-path floor, in order.
SHORT_ORDINALS = ["st", "nd", "th", "rd"]
# Long-path floor: replaces applied in this order before the int cast.
LONG_FLOOR_REPLACES = [
    ("ground", "0"),
    ("mezzanine", "1"),
    ("floor", ""),
    ("st", ""),
    ("nd", ""),
    ("rd", ""),
    ("th", ""),
]
# Boolean flags from the lower-cased long feature text:
# (output column, keyword, negate). "swimming_pool" uses its own keyword
# (the reference's "garden" there is a slip, survey quirk Q1).
KEYWORD_FLAGS = [
    ("terrace", "terrace", False),
    ("balcony", "balcony", False),
    ("exterior", "exterior", False),
    ("heating", "no heating", True),
    ("lift", "with lift", False),
    ("second_hand", "second hand", False),
    ("air_conditioning", "air conditioning", False),
    ("needs_renovating", "needs renovating", False),
    ("parking", "parking space included", False),
    ("swimming_pool", "swimming pool", False),
    ("garden", "garden", False),
]
# Characters removed from the long text before extraction.
LONG_TEXT_REMOVE = ["[", "]", "'"]
# Removed from the text after the floor-area extract and before the floor
# extract (so that "m² floor area" is not read as a floor).
FLOOR_AREA_TOKEN = " m² floor area"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Extract:
    """One extraction rule: output column, one-group pattern, literal tokens
    removed from the match, the match that means zero, the target type and
    whether a comma is the decimal point."""

    name: str
    pattern: str
    strip: tuple[str, ...] = ()
    zero_token: str | None = None
    dtype: str = "string"
    decimal_comma: bool = False


# Patterns and cleaning tokens of the long-text extracts.
EXTRACTS = [
    Extract("sq_m_built", r"(\d*,*\d* m² built)", (" m² built", ","), dtype="double"),
    Extract("sq_m_floor_area", r"(\d*,*\d* m² floor area)", (" m² floor area", ","),
            dtype="double"),
    Extract("bedrooms", r"(\d* bedroom)", (" bedroom",), zero_token=" bedroom", dtype="int"),
    Extract("bathrooms", r"(\d* bathroom)", (" bathroom",), zero_token=" bathroom",
            dtype="int"),
    Extract("year_built", r"(built in \d*)", ("built in ",), dtype="double"),
    Extract("central_heating", r"(\w* heating)", (" heating",)),
    Extract("heating_type", r"(heating: \w*)", ("heating: ",)),
    Extract("consumption_kwh_m2_year", r"(consumption:\d*,*\d* kwh/m² year)",
            ("consumption:", " kwh/m² year"), dtype="double", decimal_comma=True),
    Extract("emissions_kgco2_m2_year", r"(emissions:\d*,*\d* kg co2/m² year)",
            ("emissions:", " kg co2/m² year"), dtype="double", decimal_comma=True),
    Extract("orientation", r"(orientation \w*)", ("orientation ",)),
]
# Floor is extracted from the text without the floor-area token.
FLOOR_PATTERN = r"(\d*\w* floor)"

# Title and place rules.
TYPE_PATTERN = r"(.* for sale)"
TYPE_STRIP = " for sale"
ADDRESS_PATTERN = r"(in .*)"
ADDRESS_PREFIX = r"^in "
PLACE_SEPARATOR = ", "
