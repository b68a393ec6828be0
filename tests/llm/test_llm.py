"""The training-data operators against brute force on a small table that holds
nulls, empty and long texts, ties, repeated rows and clashing columns, and on
an empty table."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("arbor.llm")

import corpus_pipeline  # noqa: E402
from arbor.llm import (bpe, chat_format, exact_dedup, license_scan, line_dedup, minhash_dedup,  # noqa: E402
                       mixing, quality_rules, token_counts, toxicity)
from arbor.llm.common import text_batches  # noqa: E402

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, "
          "name string, rid long, size long, component_id long, __id long")


def _texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = prose(120)
    words = base.split()
    out = [(1, base, "a"), (2, base.replace(" ", "\n ", 3) + " ", "b"), (3, base, "c")]
    for k in range(40):  # a family of near copies, some too far from each other
        own = list(words)
        for _ in range(rnd.randint(1, 9)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        out.append((10 + k, " ".join(own), rnd.choice("abc")))
    out += [(60, None, "a"), (61, "", "b"), (62, " \t\n ", None), (63, "one", "c"), (64, "One", "c"),
            (65, prose(12000), "a"), (66, "ab " * 3000, "b"), (None, prose(30), "d"), (None, prose(40), None),
            (67, "You idiot, ｍоrоn and l0ser! " + prose(20), "a"), (68, "the trash can " + prose(20), "a"),
            (69, "MIT License. Apache License, General Public License " + prose(5), "b"),
            (70, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n" + prose(5), "b"),
            (71, "Здравствуй 中文 😀 <|endoftext|> é é \x1c\x85  \r\n end", "e")]
    out += [(80, "a repeated row of words", "a")] * 2
    return out + [(100 + k, prose(rnd.randint(1, 60)) + "\nshared line of boilerplate\nMenu\n" + prose(3), f"s{k % 9}")
                  for k in range(40)]


def wordy(rnd, n):
    """Prose-like text of about n bytes: word frequencies by rank, sentences."""
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeio") for _ in range(rnd.randint(1, 4)))
             + rnd.choice(["", "", "s", "n"]) for _ in range(3000)]
    out, size = [], 0
    while size < n:
        word = words[min(int(3000 ** rnd.random()), 2999)] + (". " if rnd.random() < 0.08 else " ")
        out.append(word)
        size += len(word)
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", s, 0, 0.5, True, "x", 7, 9, 3, 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(rows, width):
    out = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k:k + min(width, len(w))]) for k in range(max(1, len(w) - width + 1))) if w
                   else frozenset())
    return out


def _components(rows, width, percent=80):
    sets, up = _sets(rows, width), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if n and 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                up[find(x)] = find(y)
    best = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            best[find(x)] = min(best.get(find(x), i), i)
    return [(i, len(sets[x]), i if not sets[x] else best.get(find(x))) for x, (i, _, _) in enumerate(rows)]


def _key(rows):
    return sorted(rows, key=repr)


def test_near_dedup(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", 3)  # star rounds and cross pairs both run
    got = minhash_dedup.near_groups(docs, width=2)
    want = _components(rows, 2)
    assert _key((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _key(want)
    assert minhash_dedup.near_groups(empty, width=2).count() == 0


def test_short_texts_of_few_words_make_few_candidates(spark):
    """Many short sets from a small vocabulary: lists of the same values, few links."""
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice("abcdefghij") * 2 for _ in range(rnd.randint(2, 7))), "s") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(df, width=2).collect()}
    assert got == {i: c for (i, _, c) in _components(rows, 2)}
    sets = minhash_dedup.stage_table(minhash_dedup.sketches(df, "doc_id", "text", 2, 80), "t").dropDuplicates(["s1", "s2"])
    posts = (sets.where("n >= 4").select(F.col("rid").alias("c"), "n", F.explode(F.arrays_zip("vals", "places")).alias("p"))
             .selectExpr("c", "n", "p.vals AS val", "p.places AS at", "c AS g"))
    assert minhash_dedup._overlaps(posts, 80).distinct().count() < 10 * posts.count()


def test_near_dedup_keeps_one_of_each_group(spark, empty):
    rnd = random.Random(9)

    def family(n):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        return [" ".join(base) + f" end{k}" for k in range(n)]

    same, null, mixed = family(3), family(4), family(3)
    rows = [(5, t, k) for k, t in enumerate(same)]  # versions of a text under one id
    rows += [(None, t, k) for k, t in enumerate(null)]
    rows += [(None, mixed[0], 0), (9, mixed[1], 0), (8, mixed[2], 0)]
    rows += [(7, "five words that stand alone", k) for k in (2, 1, 1)]  # equal id and text
    rows += [(None, "another row of five words", k) for k in (1, 0)]
    rows += [(1, "", 0), (2, None, 0), (2, None, 0), (None, " ", 0)]  # no shingles: no group
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    for part in (df, df.repartition(5)):
        got = minhash_dedup.dedup(part, width=5, percent=80)
        assert got.columns == df.columns
        found = [tuple(r) for r in got.collect()]
        assert [r for r in found if r[0] == 5] == [r for r in found if r[1] in same] and set(found) <= set(rows)
        assert sorted(sum(r[1] in f for r in found) for f in (same, null, mixed)) == [1, 1, 1]
        assert [r for r in found if r[1] in mixed] == [(8, mixed[2], 0)]
        assert _key(r for r in found if r[1] not in same + null + mixed) == _key(
            [(7, "five words that stand alone", 1), (None, "another row of five words", 0), *rows[-4:]])
    assert minhash_dedup.dedup(empty).count() == 0


def test_exact_dedup(spark, docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        want += [(i, keep[2], len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in members]
    for options in ({}, {"size": 5}, {"size": 40, "fingerprint": lambda c: F.length(c).cast("long")}):
        got = exact_dedup.groups(docs, **options).collect()
        assert _key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _key(want)
        assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.groups(empty).count() == 0


def test_exact_dedup_keeps_the_same_row_however_it_is_dealt(spark, empty):
    rows = [(1, "a b", k) for k in range(40, 0, -1)] + [(1, "ab ", k) for k in range(40)] + [(None, "c", k) for k in (3, 2)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts, "extra")
        assert _key(tuple(r) for r in exact_dedup.dedup(df).collect()) == _key([(1, "ab ", 0), (None, "c", 2)])
    assert exact_dedup.dedup(empty).count() == 0


def test_reject_keeps_columns_and_rows_beside_long_texts(spark):
    rows = [(k, "fine words " * 200_000 if k == 3 else None if k == 4 else f"text {k}", {"a": k}) for k in range(9)]
    df = spark.createDataFrame([*rows, (9, "you idiot, moron and loser", {"a": 9})], "doc_id long, text string, m map<string,int>")
    got = toxicity.reject(df, toxicity.base_model()).collect()
    assert _key((r.doc_id, r.m["a"], r.text) for r in got) == _key((i, m["a"], t) for i, t, m in rows)


def test_mixing(spark, docs, rows, empty):
    got = mixing.plan(docs).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    open_, total, target = set(order), sum(size.values()), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.repeats <= 3
        taken[r.source] += r.size * r.repeats
    for s in order:
        largest = max(len(WORD.findall(t or "")) for _, t, x in rows if x == s)
        assert target[s] - largest <= taken[s] <= target[s] + 1e-6
    assert sum(taken.values()) > 0
    assert _key(map(tuple, got)) == _key(map(tuple, mixing.plan(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)
    assert mixing.plan(empty).count() == 0


def test_mixing_takes_equal_ids_one_by_one(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(rnd.randint(5, 15)))
    same = text()
    rows = [(k if k % 3 else None, text(), "abc"[k % 2]) for k in range(120)]  # a third on null ids
    rows += [(7, text(), "c") for _ in range(40)] + [(8, same, "d")] * 40  # one id; fully equal rows
    rows = [(i, t, s, k % 4) for k, (i, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    got = mixing.plan(df).collect()
    size = {(i, t, s): len(t.split()) for i, t, s, _ in rows}
    for s in "abcd":
        own = [r for r in got if r.source == s]
        assert len(own) == sum(r[2] == s for r in rows)
        short = own[0].target - sum(r.size * r.repeats for r in own)
        assert -1e-6 <= short < max(r.size for r in own)
    assert _key(map(tuple, got)) == _key(map(tuple, mixing.plan(df.repartition(5)).collect()))
    mixed = [tuple(r) for r in mixing.mix(df).collect()]
    assert set(mixed) <= set(rows)
    assert collections.Counter((i, size[i, t, s], s) for i, t, s, _ in mixed) == collections.Counter(
        {k: n for k, n in sum((collections.Counter({(r.doc_id, r.size, r.source): r.repeats}) for r in got),
                              collections.Counter()).items() if n})
    assert _key(mixed) == _key(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_quality_rules(docs, rows, empty):
    got = quality_rules.judge(docs).collect()
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")),
                     len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    assert _key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                for r in got) == _key(want)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[1] and verdict[65] and not verdict[66] and not verdict[61]
    assert quality_rules.judge(empty).count() == 0
    import zstandard
    z = zstandard.ZstdCompressor(level=3)
    noise = os.urandom(9000)
    assert quality_rules.ratios(noise, z)[0] < quality_rules.band(len(noise))[0]


def test_quality_rules_reject_wrapped_base64(spark, rows):
    rnd = random.Random(11)

    def wrapped(n, width, sep):
        b64 = base64.b64encode(rnd.randbytes(n)).decode()
        return sep.join(b64[k:k + width] for k in range(0, n, width))[:n]

    prose = {k: wordy(rnd, k) for k in (150, 200, 240, 300, 350, 400, 480, 700, 900, 3000, 9000, 40000, 90000)}
    junk = [(n, wrapped(n, w, sep)) for n in prose for w in (6, 12, 64) for sep in " \n"
            if n >= 224 and n / (w + 1) >= 21]  # shorter texts overlap with prose
    assert {n for n, _ in junk} == {n for n in prose if n >= 224}
    junk += [(-size, f"{text[:at]} {wrapped(size, w, sep)} {text[at:]}")
             for w, sep in ((64, "\n"), (12, " ")) for text, size in ((prose[9000], 4096), (prose[40000], 8192),
                                                                     (prose[90000], 16384)) for at in (3000, 6001)]
    df = spark.createDataFrame([(k, t, True) for k, (_, t) in enumerate(junk)]
                               + [(-k, t, False) for k, t in prose.items()], "doc_id long, text string, junk boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [junk[k][0] for k in range(len(junk)) if got[k].kept] == []
    assert [k for k in prose if not got[-k].kept] == []


def test_license_scan(docs, rows, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[69].n_base == 3 and got[69].first_word == 0 and got[69].base_labels == "apache,gpl,mit"
    assert got[70].labels == "apache-2.0,bsd-3-clause,mit" and got[70].score == 1.0
    assert got[60].n_words == 0 and got[60].first_word is None and got[60].labels == ""
    assert license_scan.scan(empty).count() == 0


def test_license_base_counts_equal_brute_force(spark):
    rnd = random.Random(14)
    bits = ["MIT", "License", "license", "apache", "Apache", "general", "PUBLIC", "Public", "x", "é", "lICENSE", "2"]
    texts = [None, "", " ", "mit license", "mit license mit license"]
    texts += ["".join(rnd.choice(bits) + rnd.choice([" ", "-", ". ", "\n", "", "_"]) for _ in range(rnd.randint(1, 60)))
              for _ in range(2000)] + [" MIT license general public license" * 20_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[30])] * 3 + [(None, texts[31])]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, v) for k in range(len(w)) for p, v in phrases.items() if tuple(w[k:k + len(p)]) == p]
        at = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(at, default=None), max(at, default=None),
                     ",".join(sorted({v for _, v in hits}))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(df).collect()
    assert _key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == _key(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


@pytest.mark.parametrize("text,postfix,whole", [
    ("MIT", ["mit"], True),
    ("MIT OR Apache-2.0 AND GPL-2.0-only", ["mit", "apache-2.0", "gpl-2.0-only", "and", "or"], True),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["mit", "apache-2.0", "or", "bsd-3-clause", "and"], True),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"], True),
    ("MIT */", ["mit"], True), ("MIT and more words", ["mit"], True), ("MIT.", ["mit"], True),
    ("MIT OR", ["mit"], False), ("(MIT OR ISC", ["mit", "isc", "or"], False), ("", [], False),
    ("MIT and use it freely", ["mit"], True), ("see the file COPYING", [], True), ("tags in", [], True),
    ("is a tag", [], True), ("(see the file)", [], False), ("A WITH MIT WITH foo", [], True),
    ("GPL-2.0 WITH MIT", ["gpl-2.0"], False), ("GPL-2.0 WITH (MIT)", ["gpl-2.0"], False),
    ("GPL-2.0+ WITH GCC-exception-3.1 WITH LLVM-exception", ["gpl-2.0+", "gcc-exception-3.1", "with"], False),
    ("(MIT) WITH LLVM-exception", ["mit"], False), ("Foo-1.0", [], False), ("MIT OR Foo-1.0", ["mit"], False),
    ("LicenseRef-Own OR DocumentRef-x.1:LicenseRef-y", ["licenseref-own", "documentref-x.1:licenseref-y", "or"], True),
    ("GPL-3.0-or-later or LGPL-2.1-only", ["gpl-3.0-or-later", "lgpl-2.1-only", "or"], True),
    ("(MIT OR\r\n # (ISC AND\n# Zlib))\nand Vim", ["mit", "isc", "zlib", "and", "or"], True),
    ("MIT\nOR ISC", ["mit"], True), ("MIT ISC", ["mit"], True), ("MIT)", ["mit"], True), ("()", [], False),
    ("AND MIT", [], False),
])
def test_license_expressions(text, postfix, whole):
    assert license_scan.parse(text) == (postfix, whole)


def test_license_values():
    v = lambda s: license_scan.evaluate(license_scan.parse(s)[0])[0]
    assert v("MIT AND GPL-3.0") == 0.3 and v("MIT OR GPL-3.0") == 1.0
    assert v("GPL-2.0") < v("GPL-2.0 WITH Classpath-exception-2.0") < 1.0


def test_chat_template_is_reversible():
    rnd = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "\\", "\\\\", "|", "<", "\n", "n", "a", "é😀", "\\n", ""]
    for _ in range(3000):
        turns = [("".join(rnd.choices(parts, k=rnd.randint(0, 3))), "".join(rnd.choices(parts, k=rnd.randint(0, 6))))
                 for _ in range(rnd.randint(0, 4))] + [("assistant", "".join(rnd.choices(parts, k=4)))]
        text, spans = chat_format.format_turns(turns)
        assert chat_format.read_turns(text) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    # two trees: scores choose branches; a chain of 11; an orphan; a cycle; nulls
    nodes = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 3.0),
             ("t", 4, 3, "user", None, 2.0), ("t", 5, 2, None, "x", 9.0), ("t", 6, 99, "user", "orphan", 0.5),
             ("t", 7, 8, "user", "cycle", 9.0), ("t", 8, 7, "user", "cycle", 9.0)]
    nodes += [("u", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(11)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = chat_format.format_paths(df).collect()
    found = {(r.tree, r["rank"]): [t for _, t in chat_format.read_turns(r.formatted)] for r in got}
    assert found == {("t", 1): ["q", "bad", "x"], ("t", 2): ["q", "good", ""], ("t", 3): ["orphan"],
                     ("u", 1): [str(k) for k in range(11)]}
    best = chat_format.format_paths(df, top=1)
    assert _key((r.tree, r.leaf) for r in best.collect()) == [("t", 5), ("u", 10)]
    assert chat_format.format_paths(df.limit(0)).count() == 0
    plain = df.where("tree = 't' and node < 6").selectExpr("tree", "node", "parent", "role", "text", "if(node = 5, null, score) score")
    best = chat_format.format_paths(plain, top=1).collect()
    assert [(r.tree, r.leaf) for r in best] == [("t", 4)]


def test_chains(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 5, None, "x"),
            (2, None, "system", "s"), (2, 3, "user", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_paths(chat_format.chains(df), top=1).collect()
    assert {r.tree: chat_format.read_turns(r.formatted) for r in out} == {
        "=1": [("user", "a"), ("assistant", ""), ("assistant", "")], "": [("", "x")],
        "=2": [("system", "s"), ("user", "<|im_end|>")]}


def test_token_counts(spark, docs, rows, empty, scratch):
    from tokenizers import Tokenizer
    path, cache = P.path("word_bpe_49k.json"), f"{scratch}/cache"
    tok = Tokenizer.from_file(path)
    want = _key((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.count_tokens(docs, path, cache)
        assert _key((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count()
    # word_bpe drops white space itself: texts that differ in blanks are one content
    assert token_counts.drops_space(path) and not token_counts.drops_space(P.path("byte_bpe_50k.json"))
    blanks = spark.createDataFrame([(1, "two  words"), (2, "\ttwo\n words ")], "doc_id long, text string")
    found = token_counts.count_tokens(blanks, path, f"{scratch}/blanks").collect()
    assert len({r.content for r in found}) == 1 and {r.n_tokens for r in found} == {2}
    import sentencepiece
    piece = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece)
    some = docs.where("doc_id < 3 or doc_id between 60 and 71")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(some, piece, cache).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t, _ in rows if i and (i < 3 or 60 <= i <= 71)}
    assert token_counts.count_tokens(empty, path, f"{scratch}/none").count() == 0


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = _key((i, tok.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows)
    assert _key((r.doc_id, list(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(empty, path).count() == 0


def test_bpe_cuts_and_specials():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    own, tok, rnd = bpe.ByteBPE(path), Tokenizer.from_file(path), random.Random(4)
    parts = ["a", "aaa", "'s", "'S", " ", "  ", " \n", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "٣", "²", "中",
             "😀", "<|endoftext|>", "<|endof", "!!", "12", "\x00"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    ids = own.encode(texts)
    assert [list(x) for x in ids] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert own.decode(ids) == texts
    with pytest.raises(ValueError):
        own.decode([[10**6]])


def test_line_dedup(docs, rows, empty):
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                sites[line.strip(" \t\r\x0b\x0c")].add(s)
    gone = {x for x, s in sites.items() if len(s) >= 8}
    assert {"shared line of boilerplate", "Menu"} <= gone
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if x.strip(" \t\r\x0b\x0c") not in gone]
        want.append((i, "\n".join(left), len(lines) - len(left)))
    got = line_dedup.remove(docs, gone="taken_out")
    assert got.columns == [*docs.columns, "taken_out"]
    assert _key((r.doc_id, r.text or "", r.taken_out) for r in got.collect()) == _key(want)
    assert line_dedup.remove(empty).count() == 0


def test_toxicity(spark, docs, rows, empty):
    model = toxicity.base_model()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[67].predicted == 1 and got[67].weight == 3 * toxicity.BASE_WEIGHT
    assert got[68].predicted == 0 and got[68].weight == 0.0
    assert 0 <= got[60].score < 0.5 and got[60].score == got[61].score
    clean = toxicity.reject(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in toxicity.score(docs, model).collect())
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, no_labels) == model
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.learn(empty, no_labels) == model


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bcdfghkmnprtuvw") for _ in range(6))
    once = [(k, " ".join([word() for _ in range(10)] + ["zugbat"] * (k % 3 == 0)), int(k % 3 == 0)) for k in range(90)]
    labels = spark.createDataFrame([(i, y) for i, _, y in once], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, t) for i, t, _ in once], "doc_id long, text string")
    hot = [(i, t) for i, t, _ in once for _ in range(40 if i < 9 else 2)]
    others = spark.createDataFrame([(i, f"{t} {k}") for i, t in hot[:120] for k in range(3)], one.schema)
    sizes, fit = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda got: sizes.append(len(got)) or fit(got))
    options = {"max_rows": 60, "min_docs": 2, "min_odds": 0.5}
    want = toxicity.learn(one, labels, **options)
    assert want != toxicity.base_model()
    assert toxicity.learn(spark.createDataFrame(hot, one.schema), labels, **options) == want
    mixed = one.unionByName(others)
    assert toxicity.learn(mixed, labels, **options) == toxicity.learn(mixed.repartition(7), labels, **options)
    assert max(sizes) <= 60


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op1_toxicity(spark, sf)
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = out.where("held_out").join(lab, "doc_id").select("score", "toxic").collect()
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.93
    assert sum(s >= 0.5 for s in neg) <= 0.01 * len(neg)


def test_pipeline(spark, rows, scratch):
    own = [(k, t, "en", s, len(t or "")) for k, (_, t, s) in enumerate(rows)]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, scratch).collect())
    match, prob = toxicity.base_model().matcher(), toxicity.base_model().probability
    left = [(i, t, s) for i, t, _, s, _ in own if prob(*match(t or "")) < 0.5]
    groups = collections.defaultdict(list)
    for i, t, s in left:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t, s))
    left = [(i, t, s) for _, i, t, s in (min(g, key=lambda x: x[:2]) for g in groups.values())]
    left = [r for r, (i, _, c) in zip(left, _components(left, 5)) if i == c]
    plan = {r.doc_id: r.repeats for r in mixing.plan(spark.createDataFrame(
        left, "doc_id long, text string, source string")).collect()}
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter({(i, tuple(tok.encode(t or "", add_special_tokens=False).ids)): plan[i]
                                for i, t, _ in left if plan[i]})
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]


def test_bpe_takes_words_without_end():
    """Long letter runs, equal letters and base64 lines against the library; a
    word of 1 MB within a time limit."""
    import time

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(path)
    rnd = random.Random(12)
    run = lambda n, letters: "".join(rnd.choices(letters, k=n))
    texts = [run(n, letters) for n in (33, 70, 500, 20_000)
             for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "中文字符", "-=", "01")]
    texts += [base64.b64encode(rnd.randbytes(9000)).decode(), " ".join(run(300, "esti") for _ in range(40)),
              "x" * 65 + " " + "the" * 5000 + "\n" + " " * 700]
    texts += [run(rnd.randint(1, 400), "aeinrst") for _ in range(300)]
    for text, got in zip(texts, own.encode(texts)):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    started = time.monotonic()
    long = run(1_000_000, "abcdefghijklmnopqrstuvwxyz")
    got = own.encode([long])[0]
    assert time.monotonic() - started < 40
    assert got.tolist() == library.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "ïdiot", "İdiot", "𝗂𝖽𝗂𝗈𝗍", "𝕚𝕕𝕚𝕠𝕥", "ｉｄｉｏｔ", "i.d.i.o.t", "i d i o t", "I-D-I-O-T", "1d10t", "іdіоt", "id\u00adi\u200bot",
    "!diot", "@idiot", "idiot!!!", "i\u0301d\u0308iot", "$tupid", "st\u00fcpid", "s.t.u.p.i.d", "tr@sh", "l0ser", "(loser)", "$cum", "ìdìòt",
])
def test_folding_sees_through_disguises(text):
    match = toxicity.base_model().matcher()
    assert match(f"so {text} here")[0] == toxicity.BASE_WEIGHT


@pytest.mark.parametrize("text", [
    "the trash can", "tr@sh bin", "the U.S.A. and the E.U.", "a b c d e f", "$100 or $ 5", "naïve façade über İstanbul",
    "circus clown", "idiotic-free", "", "   ", "stup id", "@user said", "x+y", "i.d.",
])
def test_folding_leaves_clean_texts_alone(text):
    assert toxicity.base_model().matcher()(text)[0] == 0


def _plain_match(model, text):
    """Weights by a search for each term at each place, without an automaton."""
    words = toxicity.fold(text)
    line = f" {' '.join(words)} " + "".join(f" {w} " for w in toxicity.second_reading(text))
    best = {}
    for term, weight in model.terms:
        for at in range(len(line)):
            if line.startswith(term, at):
                best[at] = max(best.get(at, 0.0), weight)
    for phrase in model.exceptions:
        term = f" {' '.join(toxicity.fold(phrase))} "
        for at in range(len(line)):
            if line.startswith(term, at):
                for k in range(at, at + len(term) - 1):
                    best.pop(k, None)
    return sum(best.values()), max(best.values(), default=0.0), len(words)


def test_toxicity_scores_equal_brute_force(spark, docs, rows, empty):
    rnd = random.Random(15)
    bits = [*toxicity.BASE_LEXICON, *toxicity.EXCEPTIONS, "fine", "idiots", "clownish", "$tupid", "trash.can", "é", "0", "@"]
    texts = [" ".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(300)]
    start = toxicity.base_model()
    model = toxicity.ToxicityModel((*start.terms, (" id", 1.5), (" clown", 2.0)), start.exceptions, start.coef)
    all_rows = [(i, t) for i, t, _ in rows if len(t or "") < 5000] + list(enumerate(texts)) + [(3, texts[3])] * 2
    df = spark.createDataFrame(all_rows, "doc_id long, text string")
    got = toxicity.score(df, model).collect()
    want = []
    for i, t in all_rows:
        p = model.probability(*_plain_match(model, t or ""))
        want.append((i, round(p, 9), int(p >= 0.5)))
    assert _key((r.doc_id, round(r.score, 9), r.predicted) for r in got) == _key(want)
    assert toxicity.score(empty, model).count() == 0


def test_bitmaps_bound_what_two_sets_share(spark):
    """Never fewer than the sets share, and near the truth for sets of some hundred values."""
    rng = np.random.default_rng(7)
    rows = []
    for n, share in [(1, 1), (3, 2), (16, 16), (17, 12), (40, 0), (65, 60), (300, 240), (300, 299), (520, 400), (500, 20)]:
        a = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        for size in (n, max(share, n // 5), 2 * n):
            b = np.unique(np.concatenate([a[:share], rng.integers(0, 2**64 - 1, max(0, size - share), np.uint64)]))
            rows.append((len(a), minhash_dedup.bitmap(a).tolist(), len(b), minhash_dedup.bitmap(b).tolist(),
                         len(np.intersect1d(a, b))))
    df = spark.createDataFrame(rows, "na long, ba array<long>, nb long, bb array<long>, both long")
    got = df.select("na", "nb", "both", minhash_dedup._common("na", "ba", "nb", "bb").alias("most")).collect()
    assert all(r.both <= r.most <= min(r.na, r.nb) for r in got)
    assert next(r for r in got if (r.na, r.nb, r.both) == (300, 300, 240)).most < 256


def test_text_batches_puts_the_setting_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    with pytest.raises(ValueError):
        with text_batches(spark):
            assert int(spark.conf.get(key)) <= 1000
            raise ValueError
    assert spark.conf.get(key) == own
