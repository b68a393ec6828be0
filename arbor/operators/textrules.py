"""Text-to-columns operators (survey 2.10, 2.11): each applies a whole rule
table in one ``select`` of built-in expressions, so a table of N rules is
one projection over one scan, inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.functions import rules as RU
from arbor.functions import text as T


def short_feature_cols(list_col: str) -> dict[str, Column]:
    """Short feature list (text repr of a list) -> size, bedrooms, floor,
    exterior, lift (the ``info_features`` path), as named expressions."""
    c0, c1, c2 = (T.repr_item(list_col, i) for i in range(3))
    size = T.first_word(T.remove_all(c0, ["'", ","])).try_cast("int")
    bed_txt = F.when(T.contains(c1, "bed", lower=False), c1)
    n_bed = F.coalesce(T.first_word(T.remove_all(bed_txt, ["'"])), F.lit("0")).try_cast("int")
    # the bedrooms element holds the floor text when it is not about bedrooms
    floor_src = F.when(T.contains(c1, "bed", lower=False) | (c1 == ""), c2).otherwise(c1)
    floor = T.split_first(T.replace_chain(floor_src, RU.FLOOR_WORD_REPLACES), " floor")
    floor = T.remove_all(T.remove_all(floor, RU.FLOOR_NOISE), RU.SHORT_ORDINALS)
    return {
        "size_in_m2": size,
        "n_bedrooms": n_bed,
        "floor": F.coalesce(floor, F.lit("404")),
        "exterior": T.contains(floor_src, "exterior"),
        "lift": T.contains(floor_src, "with lift"),
    }


def short_features(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"),
                     *[c.alias(n) for n, c in short_feature_cols(list_col).items()])


def keyword_flags(text: Column, table=RU.KEYWORD_FLAGS) -> dict[str, Column]:
    """``str_keyword_flags``: one boolean per (name, keyword, negate) on the
    lower-cased text; a NULL text gives NULL."""
    out = {}
    for name, kw, neg in table:
        hit = T.contains(text, kw, lower=True, na=None)
        out[name] = ~hit if neg else hit
    return out


def _clean(match: Column, rule: RU.Extract) -> Column:
    v = match
    if rule.zero_token is not None:
        v = F.when(v == rule.zero_token, F.lit("0" + rule.zero_token)).otherwise(v)
    if rule.decimal_comma:
        return T.parse_decimal_comma(v, rule.strip)
    v = T.remove_all(v, rule.strip)
    if rule.dtype == "string":
        return v
    if rule.dtype == "int":
        return v.try_cast("int")
    return v.try_cast(rule.dtype)


def long_feature_cols(text_col: str, extracts: Sequence[RU.Extract] = RU.EXTRACTS,
                      basement: bool = False) -> dict[str, Column]:
    """Long feature text -> 11 flags and 11 typed extracts (``str_extract_suite``
    + cleaning), as named expressions for one projection. A basement or
    semi-basement is floor 0 unless ``basement`` makes it -1, as in the short path
    (a stated floor -1 or -2 still decides)."""
    raw = F.col(text_col)
    low = F.lower(raw)
    text = F.lower(T.remove_all(raw, RU.LONG_TEXT_REMOVE))
    no_area = T.replace(text, RU.FLOOR_AREA_TOKEN, "")
    cols = dict(keyword_flags(raw))
    for rule in extracts:
        cols[rule.name] = _clean(T.extract(text, rule.pattern), rule)
    # floor: extract, then the mezzanine / missing / negative masks in the
    # reference's order, then the replace chain and the int cast
    fl = T.extract(no_area, RU.FLOOR_PATTERN)
    fl = F.when(T.contains(low, "mezzanine", lower=False, na=False), F.lit("mezzanine")).otherwise(fl)
    fl = F.coalesce(fl, F.lit("ground"))
    if basement:
        fl = F.when(T.contains(low, "basement", lower=False, na=False), F.lit("-1")).otherwise(fl)
    fl = F.when(T.contains(low, "floor -1", lower=False, na=False), F.lit("-1")).otherwise(fl)
    fl = F.when(T.contains(low, "floor -2", lower=False, na=False), F.lit("-2")).otherwise(fl)
    cols["floor"] = T.strip(T.replace_chain(fl, RU.LONG_FLOOR_REPLACES)).try_cast("int")
    return cols


def long_features(df: DataFrame, id_col: str, text_col: str, extracts: Sequence[RU.Extract] = RU.EXTRACTS,
                  basement: bool = False) -> DataFrame:
    return df.select(F.col(id_col).alias("id"),
                     *[c.alias(n) for n, c in long_feature_cols(text_col, extracts, basement).items()])


def price_title_place_cols(title: str = "title", place: str = "neighborhood",
                           price: str = "price") -> dict[str, Column]:
    """Price (thousands comma), property type and address from the title,
    neighbourhood and city from the place text (``re_price_title_place``)."""
    ptype = T.strip(T.replace(T.extract(title, RU.TYPE_PATTERN), RU.TYPE_STRIP, ""))
    address = T.replace_regex(T.extract(title, RU.ADDRESS_PATTERN), RU.ADDRESS_PREFIX, "")
    hood, city = T.split_expand(place, RU.PLACE_SEPARATOR, 2)
    return {"price": T.parse_thousands(price), "property_type": ptype, "address": address,
            "neighborhood": hood, "city": city}


def price_title_place(df: DataFrame) -> DataFrame:
    return df.select("id", *[c.alias(n) for n, c in price_title_place_cols().items()])
