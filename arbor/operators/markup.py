"""Elements of a page as a tree parser sees them, in built-in expressions.

A page is cut into tokens (tags and texts). The tags that shape lists and
blocks are folded over a stack of open elements (``aggregate`` on the token
array), with HTML's implied ends: a list item ends at the next item of its
list, at the end of the list or of what holds it; a paragraph ends at the next
block; what is open at the end ends there. An element is its place among
the tokens and the place of its end, so its text and links are read from a
slice. Names may be in capitals, attributes quoted in any way; comments,
scripts and styles are dropped first; named and numeric character references
are decoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.functions import text as T

NOISE = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>")
_QUOTED = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_NO_TAG = r"<(?![a-zA-Z/!?])"
TOKEN = rf"<[a-zA-Z/!?]{_QUOTED}>|(?:[^<]|{_NO_TAG})[^<]*(?:{_NO_TAG}[^<]*)*|<"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
# Elements whose start ends an open paragraph, and list elements.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "div", "footer", "form", "header", "li", "main", "nav",
          "p", "pre", "section", "table", *HEADINGS, *LISTS)
#: Elements that are matched beside those.
INLINE = ("span",)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


#: Named references (HTML's), and numeric ones to C1 controls, which mean
#: windows-1252, as browsers read them.
NAMED = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
C1 = {code: bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)}


# ------------------------------------------------------------ text of tokens
def _reference(name: Column) -> Column:
    """The character of a reference without ``&`` and ``;``, NULL if unknown."""
    code = F.when(F.startswith(name, F.lit("#x")) | F.startswith(name, F.lit("#X")),
                  F.conv(F.substring(name, 3, 8), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 10))
    code = code.try_cast("long")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    numeric = F.coalesce(F.try_element_at(_map(C1), code.cast("int")), char)
    return F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(_map(NAMED), name))


def decoded(text: Column) -> Column:
    """Text with its character references decoded; unknown ones stay."""
    pieces = F.split(text, "&")

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,10}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        char = F.when(name != "", _reference(name))
        return F.when(i == 0, p).when(char.isNull(), F.concat(F.lit("&"), p)).otherwise(
            F.concat(char, F.substr(p, F.length(name) + 2)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def is_tag(token: Column) -> Column:
    return F.rlike(token, F.lit(r"^<[a-zA-Z/!?]"))


def text_of(tokens: Column) -> Column:
    """Text of a slice of tokens: each text stripped, decoded, joined."""
    texts = F.filter(tokens, lambda t: ~is_tag(t))
    return F.array_join(F.transform(texts, lambda t: T.strip(decoded(t))), "")


def attribute(token: Column, name: str) -> Column:
    """Decoded value of a tag's attribute, NULL without it."""
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    other = r"""\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
    pattern = rf"(?i)^<[a-z][^\s>]*(?:{other})*?\s+{name}{value}"
    parts = [F.regexp_extract(token, pattern, g) for g in (1, 2, 3)]
    return F.when(F.rlike(token, F.lit(pattern)), decoded(F.concat(*parts)))


# ------------------------------------------------------------------ elements
def tokens(html: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), NOISE, ""), F.lit(TOKEN), F.lit(0))


def tags(tokens: Column) -> Column:
    """The tags that shape blocks and lists: place, name, whether it is an end."""
    every = F.transform(tokens, lambda t, i: F.struct(
        i.alias("at"), F.lower(F.regexp_extract(t, TAG_NAME, 1)).alias("name"),
        F.startswith(t, F.lit("</")).alias("end")))
    return F.filter(every, lambda x: x["name"].isin(*BLOCKS, *INLINE))


_OPEN = "array<struct<at:int,name:string>>"
_DONE = "array<struct<at:int,stop:int,name:string>>"


def elements(tags: Column, n_tokens: Column, wanted: Sequence[str]) -> Column:
    """Elements of the ``wanted`` names in document order: place of the start
    tag, place of the end, name. A fold over the tags with a stack of what is open."""

    def closed(stack: Column, depth: Column, stop: Column) -> Column:
        top = F.slice(stack, F.size(stack) - depth + 1, depth)
        top = F.filter(top, lambda e: e["name"].isin(*wanted))
        return F.transform(top, lambda e: F.struct(e["at"].alias("at"), stop.alias("stop"), e["name"].alias("name")))

    def step(acc: Column, x: Column) -> Column:
        names = F.reverse(acc["open"]["name"])
        pos = lambda n: F.array_position(names, n).cast("int")  # noqa: E731  from the top, 0: not open
        lists = [pos(n) for n in LISTS]
        edge = F.least(*[F.when(p > 0, p).otherwise(2**30) for p in lists])
        item, par, same = pos("li"), pos("p"), pos(x["name"])
        item, par = F.when(item < edge, item).otherwise(0), F.when(par < edge, par).otherwise(0)
        ends = F.when(x["name"].isin("li", "p"), F.when(same < edge, same).otherwise(0)).otherwise(same)
        starts = F.when(x["name"] == "li", F.greatest(item, par)).when(x["name"].isin(*INLINE), 0).otherwise(par)
        depth = F.when(x["end"], ends).otherwise(starts)
        kept = F.slice(acc["open"], 1, F.size(acc["open"]) - depth)
        opened = F.when(x["end"], F.array().cast(_OPEN)).otherwise(F.array(F.struct(x["at"].alias("at"), x["name"].alias("name"))))
        done = F.when(depth > 0, F.concat(acc["done"], closed(acc["open"], depth, x["at"]))).otherwise(acc["done"])
        return F.struct(F.concat(kept, opened).alias("open"), done.alias("done"))

    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(tags, start, step, lambda acc: F.array_sort(
        F.concat(acc["done"], closed(acc["open"], F.size(acc["open"]), n_tokens))))


def parsed(pages: DataFrame, wanted: Sequence[str], html: str = "html") -> DataFrame:
    """``pages`` without ``html`` and with ``_tokens`` and ``_elements``."""
    rest = [c for c in pages.columns if c != html]
    cut = pages.select(*rest, tokens(F.col(html)).alias("_tokens"))
    return cut.withColumn("_elements", elements(tags(F.col("_tokens")), F.size("_tokens"), wanted))


def inner(tokens: Column, element: Column) -> Column:
    """The tokens inside an element."""
    return F.slice(tokens, element["at"] + 2, element["stop"] - element["at"] - 1)
