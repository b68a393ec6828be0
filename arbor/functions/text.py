"""String column functions (survey section 2.10).

All are built-in expressions (JVM side, inside whole-stage codegen). Regex
patterns follow Python semantics: ``\\d``/``\\w`` match Unicode, so every
pattern is compiled with Java's ``(?U)`` flag; a pattern with ``.`` also gets
``(?d)`` so that ``.`` stops only at ``\\n`` as in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _regex_literal(text: str) -> str:
    """Quote a literal for ``split`` (which takes a regex)."""
    return "\\Q" + text + "\\E"


def java_pattern(pattern: str) -> str:
    """Python-like regex in Java's dialect (R5)."""
    flags = "U"
    if "." in pattern.replace(r"\.", ""):
        flags += "d"
    return f"(?{flags}){pattern}"


def replace(c: ColumnOrName, old: str, new: str = "") -> Column:
    """``str_replace``: literal replace of every occurrence."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def replace_chain(c: ColumnOrName, pairs: Iterable[tuple[str, str]]) -> Column:
    """``str_replace_chain``: literal replaces applied in the given order."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])),
                  pairs, _c(c))


def remove_all(c: ColumnOrName, tokens: Iterable[str]) -> Column:
    """Ordered literal removals (a replace chain with empty targets)."""
    return replace_chain(c, [(t, "") for t in tokens])


def replace_regex(c: ColumnOrName, pattern: str, new: str = "") -> Column:
    """``str_replace_regex``."""
    return F.regexp_replace(_c(c), java_pattern(pattern), new)


def _group_is_whole(pattern: str) -> bool:
    if not (pattern.startswith("(") and pattern.endswith(")")) or pattern.startswith("(?"):
        return False
    depth = 0
    for i, ch in enumerate(pattern):
        if ch == "(" and (i == 0 or pattern[i - 1] != "\\"):
            depth += 1
        elif ch == ")" and (i == 0 or pattern[i - 1] != "\\"):
            depth -= 1
            if depth == 0 and i != len(pattern) - 1:
                return False
    return True


def extract(c: ColumnOrName, pattern: str) -> Column:
    """``str_extract``: group 1 of the first match, NULL when there is no
    match (R4). A pattern whose group is the whole pattern uses
    ``regexp_substr`` (one regex pass); otherwise ``regexp_extract`` guarded
    by ``regexp_like`` (``regexp_extract`` alone gives '' on no match)."""
    p = F.lit(java_pattern(pattern))
    if _group_is_whole(pattern):
        out = F.regexp_substr(_c(c), p)
    else:
        out = F.when(F.regexp_like(_c(c), p), F.regexp_extract(_c(c), java_pattern(pattern), 1))
    hint = required_literal(pattern)
    if len(hint) >= 3:
        # a row without the pattern's mandatory literal cannot match: skip
        # the regex scan for it (same result, far less work)
        out = F.when(F.contains(_c(c), F.lit(hint)), out)
    return out


_META = set("\\^$.|?*+()[]{}")


def required_literal(pattern: str) -> str:
    """Longest run of plain characters that every match must contain, for
    patterns without alternation; '' when none can be proven."""
    if "|" in pattern or "[" in pattern or "{" in pattern or ")?" in pattern or ")*" in pattern \
            or "(?" in pattern:
        return ""  # alternatives, classes, and groups that may be absent or are no text
    best, run, i = "", "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            best, run = max(best, run, key=len), ""
            i += 2
            continue
        if ch in "*?":
            run = run[:-1]  # the quantified char is optional
            best, run = max(best, run, key=len), ""
        elif ch in _META:
            best, run = max(best, run, key=len), ""
        else:
            run += ch
        i += 1
    return max(best, run, key=len)


def contains(c: ColumnOrName, keyword: str, lower: bool = True,
             na: bool | None = False) -> Column:
    """``flt_contains`` / ``str_contains_flag``: substring test on the
    (lower-cased) text. ``na`` is the value for a NULL input (pandas
    ``na=``); ``None`` keeps NULL."""
    s = F.lower(_c(c)) if lower else _c(c)
    hit = F.contains(s, F.lit(keyword))
    return hit if na is None else F.coalesce(hit, F.lit(na))


def strip(c: ColumnOrName) -> Column:
    """``str_strip``: trim all leading/trailing whitespace (Python strip)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def first_word(c: ColumnOrName) -> Column:
    """``str_split_index`` on whitespace: ``.str.split().str[0]``."""
    return F.get(F.split(strip(c), r"(?U)\s+"), 0)


def split_first(c: ColumnOrName, sep: str) -> Column:
    """``str_split_index`` on a literal: ``.str.split(sep).str[0]``."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def split_expand(c: ColumnOrName, sep: str, n: int) -> list[Column]:
    """``str_split_expand``: first ``n`` parts as columns; missing -> NULL."""
    parts = F.split(_c(c), F.lit(_regex_literal(sep)))
    return [F.get(parts, i) for i in range(n)]


def concat_strict(*cols: ColumnOrName) -> Column:
    """``str_concat`` with NULL propagation (pandas ``+``, R7)."""
    return F.concat(*[_c(x) for x in cols])


def parse_thousands(c: ColumnOrName, strip_tokens: Sequence[str] = ()) -> Column:
    """``str_decimal_comma`` (thousands form): drop tokens and the comma
    thousands separator, then ``try_cast`` to double."""
    s = remove_all(c, list(strip_tokens) + [","])
    return s.try_cast("double")


def parse_decimal_comma(c: ColumnOrName, strip_tokens: Sequence[str] = ()) -> Column:
    """``str_decimal_comma`` (decimal form): drop tokens, comma becomes the
    decimal point, then ``try_cast`` to double."""
    s = F.replace(remove_all(c, strip_tokens), F.lit(","), F.lit("."))
    return s.try_cast("double")


def repr_list(c: ColumnOrName) -> Column:
    """``src_repr_list``: the text repr of a Python list of strings back to
    an array: drop ``[`` ``]``, split on ``', '``, strip each element and its
    quotes (quirk Q2)."""
    return F.transform(_repr_parts(c), _repr_text)


def repr_item(c: ColumnOrName, i: int) -> Column:
    """Element ``i`` of :func:`repr_list` (NULL beyond the end); the other
    elements are not cleaned."""
    return _repr_text(F.get(_repr_parts(c), i))


def _repr_parts(c: ColumnOrName) -> Column:
    return F.split(F.translate(_c(c), "[]", ""), ", ")


def _repr_text(part: Column) -> Column:
    return F.regexp_replace(strip(part), r"^'|'$", "")


def ragged(arr: ColumnOrName, width: int, prefix: str = "c") -> list[Column]:
    """``src_ragged``: positional columns of an array; short rows -> NULL."""
    return [F.get(_c(arr), j).alias(f"{prefix}{j}") for j in range(width)]
