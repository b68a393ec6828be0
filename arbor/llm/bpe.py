"""BPE encoding and decoding in batched numpy merge rounds.

Texts are cut by the byte-level pattern; the distinct words of a batch that
are not known yet become one flat array of byte symbols with word borders. In
each round every neighbouring pair inside a word is looked up by binary search
over the sorted pair keys, each word's lowest-rank pair is merged wherever it
stands, and finished words leave the array; the rounds end when none is left.
Words with more merges than ``ROUNDS`` go on in rounds of one rank each over a
linked list in arrays, which touch only the places where that rank stands.
Decoding gathers the bytes of all ids with flat index arithmetic.

Defined cases: a null text counts as empty and has no ids; special strings
inside texts become their ids; any Unicode text round-trips; ids unknown to
the vocabulary raise; rows are encoded one by one, so repeated rows and extra
columns change nothing. Very long texts are encoded whole; a word without end
takes one round for each merge that occurs in it, and work by its merges, not
by rounds times its length.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import load, ship_code, slices

#: Fixed value: the cut of byte-level BPE, with Unicode white space spelt out.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Chunks remembered between the batches of a task; emptied when full.
MEMORY = 300_000
#: Chunks longer than this are encoded but not remembered.
LONGEST_KEPT = 256
#: Rounds over the whole array; words not finished by then go on rank by rank.
ROUNDS = 32
NONE = np.int64(1 << 60)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file:
    printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(n)
            n += 1
    return [out[b] for b in range(256)]


_RUN = re.compile(r"\s (?=\s|\Z)")
_LOADED: dict[str, "ByteBPE"] = {}


def loaded(path: str) -> "ByteBPE":
    """The tokenizer of a file, read once by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


class Store:
    """Sequences of ids in one flat array, fetched by number."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[k]: end of sequence k - 1
        self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append sequences; returns the first one's number."""
        first, start = self.used, int(self.ends[self.used])
        while start + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + sizes.size + 1 > self.ends.size:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[start:start + ids.size] = ids
        self.ends[first + 1:first + 1 + sizes.size] = start + np.cumsum(sizes)
        self.used += sizes.size
        return first

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences one after the other, and their sizes."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        at = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        return self.flat[at], sizes


class ByteBPE:
    """Byte-level BPE of a ``tokenizers`` file without normaliser, dropout,
    prefix space or post-processor."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges")
                or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space")):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        table = [b""] * size
        self.known = np.zeros(size, bool)
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token)
            self.known[i] = True
        for token, i in self.specials.items():
            table[i] = token.encode("utf-8")
            self.known[i] = True
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.base = np.int64(size)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.slot_of = np.empty(order.size, np.int64)  # by rank: the place in the sorted keys
        self.slot_of[order] = np.arange(order.size)
        self.cut = regex.compile(PATTERN)
        self.special_cut = (regex.compile("|".join(map(regex.escape, sorted(
            self.specials, key=len, reverse=True)))) if self.specials else None)
        self.memory: dict[str, int] = {}
        self.store = Store()

    # ------------------------------------------------------------ merging
    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other and the number of each word's
        ids, by merge rounds over one flat array."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        done_ids, done_word = [], []
        turn = 0
        while flat.size:
            if turn == ROUNDS:
                flat, word = self._by_rank(flat, word)
                done_ids.append(flat)
                done_word.append(word)
                break
            turn += 1
            slot = self._lookup(flat, word)
            rank = np.where(slot >= 0, self.ranks[np.maximum(slot, 0)], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.concatenate([starts, [flat.size]]))
            lowest = np.repeat(lowest, lengths)
            done = lowest == NONE
            if done.any():
                done_ids.append(flat[done])
                done_word.append(word[done])
                stay = ~done
                flat, word, slot = flat[stay], word[stay], slot[stay]
                rank, lowest = rank[stay], lowest[stay]
                if not flat.size:
                    break
            hit = self._leftmost(rank == lowest)
            flat = np.where(hit, self.made[np.maximum(slot, 0)], flat)
            stay = np.concatenate([[True], ~hit[:-1]])
            flat, word = flat[stay], word[stay]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _by_rank(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, one rank a round. ``after`` and
        ``before`` link the symbols left; a place waits under the rank of the
        pair that begins there, and counts only if that is still its pair."""
        n = flat.size
        symbol = np.append(flat, -1)  # place n: beyond a word
        place = np.arange(n + 1)
        after, before = np.minimum(place + 1, n), place - 1
        border = np.flatnonzero(word[1:] != word[:-1])
        after[border], before[border + 1], before[0] = n, n, n
        alive = np.ones(n, bool)
        slot = np.append(self._lookup(flat, word), -1)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = self.ranks[slot[places]]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()] if ranks.size else []
            for a, b in zip(starts, [*starts[1:], ranks.size]):
                rank = int(ranks[a])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(places[a:b])

        wait(np.flatnonzero(slot >= 0))
        while queue:
            rank = heapq.heappop(queue)
            own = self.slot_of[rank]
            left = np.unique(np.concatenate(waiting.pop(rank)))
            left = left[slot[left] == own]
            if left.size > 1:  # of overlapping pairs, every other one from the left
                meets = np.concatenate([[False], after[left[:-1]] == left[1:]])
                if meets.any():
                    at = np.arange(left.size)
                    left = left[(at - np.maximum.accumulate(np.where(meets, 0, at))) % 2 == 0]
            if not left.size:
                continue
            gone = after[left]
            beyond = after[gone]
            symbol[left] = self.made[own]
            alive[gone], slot[gone] = False, -1
            after[left], before[beyond] = beyond, left
            changed = np.concatenate([left, before[left]])
            changed = np.unique(changed[changed < n])
            right = symbol[after[changed]]
            pair = symbol[changed] * self.base + right
            found = np.minimum(np.searchsorted(self.keys, pair), self.keys.size - 1)
            slot[changed] = np.where((right >= 0) & (self.keys[found] == pair), found, -1)
            wait(changed[slot[changed] >= 0])
        return symbol[:n][alive], word[alive]

    def _lookup(self, flat: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each symbol, the place of (it, its right neighbour) in the
        sorted pair keys, or -1."""
        slot = np.full(flat.size, -1, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        if inside.size and self.keys.size:
            pair = flat[inside] * self.base + flat[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), self.keys.size - 1)
            slot[inside] = np.where(self.keys[at] == pair, at, -1)
        return slot

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of overlapping hits (``aaa``), every other one from the left."""
        both = hit[1:] & hit[:-1]
        if not both.any():
            return hit
        place = np.arange(hit.size)
        first = np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0)
        run = np.maximum.accumulate(first)
        return hit & ((place - run) % 2 == 0)

    # ------------------------------------------------------ texts and ids
    def _has_special(self, text: str) -> bool:
        for special in self.specials:
            if special in text:
                return True
        return False

    def _words(self, text: str) -> list[str | int]:
        """Words, and ids of special strings, in order."""
        if not self._has_special(text):
            return self.cut.findall(text)
        out: list[str | int] = []
        start = 0
        for m in self.special_cut.finditer(text):
            out.extend(self.cut.findall(text[start:m.start()]))
            out.append(self.specials[m[0]])
            start = m.end()
        out.extend(self.cut.findall(text[start:]))
        return out

    def _chunks(self, text: str) -> list[str]:
        """The text cut before spaces, where a cut never changes its words:
        not in a run of white space, and not around a special string."""
        if "\0" in text or _RUN.search(text) or self._has_special(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def forget(self) -> None:
        """Give up the remembered chunks."""
        self.memory, self.store = {}, Store()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.memory) > MEMORY:
            self.forget()
        parts = [self._chunks(t) for t in texts]
        memory = self.memory
        extra = [c for c in dict.fromkeys(chain.from_iterable(parts)) if c not in memory]
        if extra:
            self._learn(extra)
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(memory.__getitem__, chain.from_iterable(parts)), np.int64,
                         int(counts.sum()))
        flat, sizes = self.store.gather(at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        for c in extra:
            if len(c) > LONGEST_KEPT:
                del memory[c]
        return [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]

    def _learn(self, chunks: list[str]) -> None:
        """Cut and merge new chunks and store their ids."""
        words = [self._words(c) for c in chunks]
        index = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64,
                           int(counts.sum()))
        ids, sizes = self.merge_words([w.encode("utf-8") if isinstance(w, str) else b""
                                       for w in index])
        own = Store()
        own.add(ids, sizes)
        for w, k in index.items():
            if isinstance(w, int):  # a special string: its id, not its bytes
                flat[flat == k] = own.add(np.array([w]), np.array([1]))
        ids, sizes = own.gather(flat)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        start = self.store.add(ids, np.diff(ends))
        self.memory.update(zip(chunks, range(start, start + len(chunks))))

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = [len(r) for r in rows]
        ids = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= self.known.size or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ids.size else 0
        source = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(total)
        raw = self.blob[source].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and ids (array of int). No shuffle."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "t", 4 << 20):
            rows = bpe.encode([t or "" for t in batch.column("t").to_pylist()])
            yield pa.RecordBatch.from_pydict({"i": batch.column("i"), "ids": _lists(rows)})
        bpe.forget()  # the worker lives on, for other work

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
            .mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", doc_id))


def decode(rows: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with a column ``out`` of their ids' text (null ids: empty)."""
    from pyspark.sql.types import StringType, StructField, StructType

    ship_code(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, ids, 4 << 20):
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()],
                             np.int64)
            cuts = np.cumsum(sizes)[:-1] if sizes.size else []
            texts = bpe.decode(np.split(flat, cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*names, out])

    import pyarrow.compute  # noqa: F401  (pa.compute is used in the tasks)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def op9_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = decode(encode(load(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
