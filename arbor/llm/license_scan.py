"""License scans: Aho-Corasick over words, and SPDX expressions.

The lower-cased text is cut into words and joined by single spaces, so one
automaton finds notice phrases and the identifier tag wherever their words
stand consecutively. Where the tag is found, the expression after it is parsed
by a shunting-yard parser (``and``, ``or``, ``with``, parentheses) and
evaluated: each licence has a permissiveness, ``and`` takes the smaller,
``or`` the larger, ``with`` lifts a licence towards 1.

Defined cases: a null text counts as empty; a text without notices has no
labels and score 0; a malformed expression gives the licences read up to the
fault and the label ``invalid-expression``; prose after the tag gives nothing;
operands are identifiers of a table (a parameter); overlapping phrases all count;
rows are scanned one by one, so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, slices

# Base phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, as words, and labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Permissiveness of licence families, by the start of the label.
VALUES = (("mit", 1.0), ("bsd", 1.0), ("isc", 1.0), ("0bsd", 1.0), ("unlicense", 1.0),
          ("public-domain", 1.0), ("cc0", 1.0), ("apache", 0.95), ("zlib", 0.95),
          ("cc-by-nc", 0.1), ("cc-by-nd", 0.1), ("cc-by-sa", 0.5), ("cc-by", 0.8),
          ("mpl", 0.6), ("epl", 0.6), ("lgpl", 0.5), ("agpl", 0.1), ("gpl", 0.3),
          ("proprietary", 0.0), ("licenseref", 0.0), ("invalid", 0.0))
UNKNOWN = 0.2

# Licence identifiers, lower-cased. ``-only``, ``-or-later`` and ``+`` follow by rule.
IDENTIFIERS = frozenset("""
0bsd aal afl-1.1 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-2.0
artistic-1.0 artistic-1.0-perl artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-source-code bsl-1.0 busl-1.1 bzip2-1.0.6
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0
cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0
cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0 efl-2.0 epl-1.0
epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg ipa ipl-1.0
isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 lppl-1.3c mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl
mulanpsl-2.0 ncsa nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.1 osl-3.0 php-3.0
php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016
unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
none noassertion
""".split())
# Exceptions that may follow ``with``, lower-cased.
EXCEPTIONS = frozenset("""
389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception
classpath-exception-2.0 ecos-exception-2.0 font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0
gcc-exception-3.1 gpl-3.0-linking-exception gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception
ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0
qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_TAG = re.compile(r"(?i)spdx[\W_]+license[\W_]+identifier[ \t]*:?")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_BLANK = re.compile(r"[ \t]*")
#: Inside brackets an expression goes on over line ends and comment signs.
_BLANK_INSIDE = re.compile(r"[ \t]*(?:\r?\n[ \t]*(?:#+|//+|\*+|--|;+|%+)?[ \t]*)*")
_REF = re.compile(r"(?:documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def value(label: str) -> float:
    for start, v in VALUES:
        if label.startswith(start):
            return v
    return UNKNOWN


def is_licence(word: str, known: frozenset[str] = IDENTIFIERS) -> bool:
    """A lower-case identifier of the table, with ``+``, ``-only`` or
    ``-or-later`` after it if it is one, or a ``LicenseRef-``."""
    stem = word.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return stem in known or word in known or _REF.fullmatch(word) is not None


def parse(text: str, start: int = 0, known: frozenset[str] = IDENTIFIERS) -> tuple[list[str], bool]:
    """Shunting-yard: the expression at ``start`` in postfix order, and
    whether it is well formed.

    Operands are identifiers of the table; after ``with`` only an exception
    may stand. The expression ends where no token of it can follow: a line end
    outside brackets, two operands side by side, or a word of prose, whose
    operator is then prose too (``MIT and use it freely`` is ``MIT``). A word
    of prose is one of letters alone; any other unknown word is a fault, as
    are open brackets, an operator before the line's end, and nothing at all.
    """
    out: list[str] = []
    stack: list[str] = []
    due = True  # an operand or "(" is due
    whole, prose = True, False
    depth, end, last = 0, start, ""
    while True:
        end = (_BLANK_INSIDE if depth else _BLANK).match(text, end).end()
        m = _TOKEN.match(text, end)
        if m is None:
            break
        end = m.end()
        low = m[0].lower().rstrip(".:")
        if low in "()":
            if (low == "(") != due or (low == ")" and not depth):
                break
            if low == "(":
                if stack and stack[-1] == "with":
                    whole = False
                    break
                stack.append(low)
                depth += 1
            else:
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
                depth -= 1
        elif low in _RANK:
            if due:
                break
            if low == "with" and not is_licence(last, known):
                whole = False
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            due = True
        else:
            if not due:
                break
            after_with = bool(stack) and stack[-1] == "with"
            if not (low in EXCEPTIONS if after_with else is_licence(low, known)):
                prose = low.isalpha() and not depth and not is_licence(low, known)
                whole = whole and prose
                break
            out.append(low)
            due = False
        last = low
    if due and not prose:  # an operator without its right side, or nothing at all
        whole = False
    if due and stack and stack[-1] in _RANK:
        stack.pop()
    if depth and out:
        whole = False
    out.extend(t for t in reversed(stack) if t != "(")
    return out, whole


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """Permissiveness of an expression, and its licences (``x with y`` as one)."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((value(token), [token]))
            continue
        if len(stack) < 2:
            continue
        (rv, rl), (lv, ll) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((lv + 0.25 * (1 - lv), [f"{a}-with-{b}" for a in ll for b in rl]))
        else:
            stack.append(((min if token == "and" else max)(lv, rv), ll + rl))
    if not stack:
        return 0.0, []
    return min(v for v, _ in stack), [x for _, ls in stack for x in ls]


def automaton():
    """Phrase words bounded by spaces -> (length in words, base label, label)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES | {TAG: None}).items():
        auto.add_word(f" {phrase} ", (len(phrase) + 2, BASE.get(phrase), label))
    auto.make_automaton()
    return auto


def scan_text(text: str, auto, known: frozenset[str] = IDENTIFIERS) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score."""
    words = _WORD.findall(text.translate(_LOWER))
    line = f" {' '.join(words)} "
    starts, base, labels, values, tagged = [], set(), set(), [], False
    for end, (size, base_label, label) in auto.iter(line):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        values.append(value(label))
        if base_label:
            base.add(base_label)
            starts.append(end - size + 1)
    if tagged:
        for m in _TAG.finditer(text):
            postfix, whole = parse(text, m.end(), known)
            v, found = evaluate(postfix)
            labels.update(found)
            if found:
                values.append(v)
            if not whole:
                labels.add("invalid-expression")
                values.append(value("invalid"))
    at = [line.count(" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
    return (len(words), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(labels)),
            min(values, default=0.0))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
         identifiers: frozenset[str] = IDENTIFIERS) -> DataFrame:
    """One row per document with its notices, licences and score;
    ``identifiers`` (lower case) are the operands that expressions may hold."""
    ship_code(docs.sparkSession)
    fields = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
              ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
              ("score", pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in slices(batches, "t"):
            rows = [scan_text(t or "", auto, identifiers) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"i": batch.column("i"), **{
                name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(fields)}})

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
            .mapInArrow(run, f"i {kind}, n_words long, n_base long, first_word long, "
                             "last_word long, base_labels string, labels string, score double")
            .withColumnRenamed("i", doc_id))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
