"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are brought to one form (NFKC), lower-cased, homoglyphs and digit
substitutions are folded to one letter each, and everything that is not a
letter or digit becomes a single space, so ``1d10t``, ``ｉdiоt`` and ``Idiot!``
are one word. A second reading drops marks (``ïdiot``), joins letters spelled
out one by one (``i.d.i.o.t``) and takes a sign before a word as a letter
(``$tupid``); there only words of the fixed lexicon count, as marks tell
harmless words from learned terms. One automaton
holds the lexicon (whole words and word beginnings, each with a weight) and
the exception phrases; a hit inside an exception phrase does not count. The
summed weight is normalised by the text's length in a logistic score.

``learn`` takes weights and score coefficients from labelled rows, one text of
each sampled id: word counts are a Spark aggregation, and only the bounded
lexicon and a few numbers for each sampled row reach the driver.

Defined cases: null and empty texts score as a text without hits and words;
repeated rows score alike; extra columns are kept by ``reject`` and ignored
by ``score``; null labels and null ids are not learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, slices, stage_table

# General insults with a start weight, used whatever the labels.
BASE_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic",
                "disgusting", "clown", "imbecile", "dumbass", "scumbag", "bastard")
BASE_WEIGHT = 4.0
# Phrases in which lexicon words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "idiot proof",
              "class clown", "clown fish", "circus clown", "stupid simple", "sore loser",
              "winner and loser", "loser bracket", "pond scum", "soap scum")
# Look-alikes of other scripts, digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "l": "i",  # l, I and 1 look alike: one letter for the three
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Signs stand for letters only between letters: ``tr@sh`` but not ``trash$$$``.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}

_SIGN = re.compile(r"(?<=\w)[@$!|+€](?=\w)")
_FIRST_SIGN = re.compile(r"(?<!\w)[@$!|+€][^\W\d_]\w*")
#: Four or more single letters with one and the same sign or space between them.
_SPELLED = re.compile(r"(?<!\w)[^\W_]([.\-_* ])[^\W_](?:\1[^\W_]){2,}(?!\w)")
_MARKS = re.compile(r"[\u0300-\u036f]+")
_MARKED_WORD = re.compile(r"[\w\u0300-\u036f]+")
_WORD = re.compile(r"[^\W_]+")
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}


def _signs_inside(text: str) -> str:
    if any(c in text for c in SIGNS) and _SIGN.search(text):
        return _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_signs_inside(text.lower()).translate(_TABLE))


_FIXED = frozenset(w for word in BASE_LEXICON for w in fold(word))


def second_reading(text: str) -> list[str]:
    """Words of the fixed lexicon that show only without marks, with spelled-out
    letters joined, or with the sign before a word as a letter."""
    found: list[str] = []
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if _MARKS.search(text):
            found += [_MARKS.sub("", w) for w in _MARKED_WORD.findall(text) if _MARKS.search(w)]
            text = _MARKS.sub("", text)
    found += [m[0].replace(m[1], "") for m in _SPELLED.finditer(text)]
    if any(c in text for c in SIGNS):
        found += [SIGNS[w[0]] + w[1:] for w in _FIRST_SIGN.findall(text)]
    return [w for w in fold(" ".join(found)) if w in _FIXED] if found else found


@dataclass(frozen=True)
class ToxicityModel:
    """``terms``: (folded term, weight); a term starts with a space, and ends
    with one if it is a whole word. ``coef``: intercept and the coefficients
    of log summed weight, log words and the largest weight."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coef: tuple[float, float, float, float]

    def matcher(self) -> Callable[[str], tuple[float, float, int]]:
        """Function from a text to (summed weight, largest weight, words)."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for phrase in self.exceptions:
            term = f" {' '.join(fold(phrase))} "
            auto.add_word(term, (len(term), None))
        for term, weight in self.terms:
            auto.add_word(term, (len(term), weight))
        if len(auto):
            auto.make_automaton()

        def match(text: str) -> tuple[float, float, int]:
            words, other = fold(text), second_reading(text)
            best: dict[int, float] = {}
            shielded: list[tuple[int, int]] = []
            if len(auto) and words:
                # two spaces apart, so that no phrase reaches over
                line = f" {' '.join(words)} " + "".join(f" {w} " for w in other)
                for end, (size, weight) in auto.iter(line):
                    start = end - size + 1
                    if weight is None:
                        shielded.append((start, end))
                    elif weight > best.get(start, 0.0):
                        best[start] = weight
            for lo, hi in shielded:
                for start in [s for s in best if lo <= s < hi]:
                    del best[start]
            return sum(best.values()), max(best.values(), default=0.0), len(words)

        return match

    def probability(self, total: float, largest: float, words: int) -> float:
        a, b, c, d = self.coef
        z = a + b * math.log1p(total) + c * math.log1p(words) + d * largest
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def base_model() -> ToxicityModel:
    """The fixed lexicon with coefficients for use without labels."""
    return ToxicityModel(_base_terms(), EXCEPTIONS, (-2.0, 2.5, -0.6, 0.4))


def _base_terms() -> tuple[tuple[str, float], ...]:
    return tuple((f" {' '.join(fold(w))} ", BASE_WEIGHT) for w in BASE_LEXICON)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _features(text: str, longest: int) -> set[str]:
    out = set()
    for word in set(fold(text)):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(3, min(len(word), longest + 1)))
    return out


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", max_rows: int = 20_000, max_terms: int = 4_000,
          min_docs: int = 6, min_odds: float = 1.5, longest: int = 8) -> ToxicityModel:
    """Lexicon and coefficients from at most ``max_rows`` labelled rows (the
    smallest id hashes; ``max_rows`` is the documented bound of the sample). Of
    several rows under one id the text of the smallest hash is taken.

    A term enters if the 2-sigma lower bound of its log odds exceeds
    ``min_odds``; the ``max_terms`` strongest stay. Without labelled rows of
    both classes, :func:`base_model` is returned.
    """
    spark = docs.sparkSession
    ship_code(spark)
    known = (labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
             .where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
             .groupBy("i").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("i"), "i").limit(max_rows))
    sample = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = stage_table(
        sample.join(F.broadcast(known), "i")  # at most max_rows rows of two numbers
        .groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")), "toxicity-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            seen: Counter = Counter()
            bad: Counter = Counter()
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
                found = _features(t, longest)
                seen.update(found)
                if y:
                    bad.update(found)
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(keys, pa.string()), "n": pa.array([seen[k] for k in keys], pa.int64()),
                "p": pa.array([bad[k] for k in keys], pa.int64())})

    size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    rows, toxic = int(size[0]), int(size[1])
    if toxic == 0 or toxic == rows:
        return base_model()
    p, q = F.col("p") + 0.5, F.col("n") - F.col("p") + 0.5
    odds = F.log(p / (toxic + 1.0)) - F.log(q / (rows - toxic + 1.0))
    sure = odds - 2 * F.sqrt(1 / p + 1 / q)
    terms = (sample.mapInArrow(counts, "term string, n long, p long")
             .groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
             .where(F.col("n") >= min_docs).select("term", odds.alias("w"), sure.alias("sure"))
             .where(F.col("sure") > min_odds)
             .orderBy(F.desc("sure"), "term").limit(max_terms).collect())  # max_terms rows
    weights = dict(_base_terms()) | {r["term"]: float(r["w"]) for r in terms}
    rough = ToxicityModel(tuple(sorted(weights.items())), EXCEPTIONS, (0.0, 0.0, 0.0, 0.0))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = rough.matcher()
        for batch in slices(batches, "t"):
            found = [match(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "total": pa.array([f[0] for f in found], pa.float64()),
                "largest": pa.array([f[1] for f in found], pa.float64()),
                "words": pa.array([f[2] for f in found], pa.int64()), "y": batch.column("y")})

    got = (sample.mapInArrow(inputs, "total double, largest double, words long, y int")
           .orderBy("total", "largest", "words", "y").collect())  # max_rows rows of four numbers
    return ToxicityModel(rough.terms, EXCEPTIONS, _logistic(got))


def _logistic(rows: list, ridge: float = 1.0) -> tuple[float, float, float, float]:
    x = np.array([(1.0, math.log1p(r["total"]), math.log1p(r["words"]), r["largest"]) for r in rows])
    y = np.array([float(r["y"] > 0) for r in rows])
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x.T * (p * (1 - p))) @ x + ridge * np.eye(4)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: ToxicityModel, *, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (score >= 0.5),
    summed weight, words. Whole texts; no shuffle."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in slices(batches, "t"):
            found = [match(t or "") for t in batch.column("t").to_pylist()]
            scores = [model.probability(*f) for f in found]
            yield pa.RecordBatch.from_pydict({
                "i": batch.column("i"), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                "weight": pa.array([f[0] for f in found], pa.float64()),
                "words": pa.array([f[2] for f in found], pa.int64())})

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
            .mapInArrow(run, f"i {kind}, score double, predicted int, weight double, words long")
            .withColumnRenamed("i", doc_id))


def reject(docs: DataFrame, model: ToxicityModel, *, text: str = "text",
           threshold: float = 0.5) -> DataFrame:
    """The documents scored under ``threshold``, with all their columns. Only
    the text goes to the Python workers, and only a flag comes back."""
    ship_code(docs.sparkSession)

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = model.matcher()
        for texts in batches:
            keep: list[bool] = []
            for part in slices([pa.RecordBatch.from_arrays([texts], ["t"])], "t", 4 << 20):
                keep += [model.probability(*match(t.as_py() or "")) < threshold for t in part.column("t")]
            yield pa.array(keep, pa.bool_())

    return docs.where(F.arrow_udf(clean, "boolean")(F.col(text)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = learn(docs, load(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                      "weight", "words")
