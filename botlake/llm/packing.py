"""Packing token sequences by minimum bin slack.

Every task packs the documents it reads, so nothing is shuffled. A document's ids are
cut into full windows and a remainder; the remainders are packed window by window:
the longest one left opens the window and a bitset subset-sum over the multiset of
remaining lengths (bit s: the sum s can be made) finds the fill closest to capacity;
backtracking through the bitsets tells how many pieces of each length it takes. When
no exact fill is left, a piece is cut to close the window. What a task has left at the end
is cut into windows of falling powers of two (at most eleven), which need no padding either.

A window number is the task's partition number and a counter. Reading the same files
again gives the same partitions, so a task that is run again makes the same windows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

WINDOW, END_ID = 2048, 1
#: Words whose ids a worker remembers before it starts anew.
MEMO_WORDS = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """ids of whole texts by a `tokenizers` vocabulary, remembering words.

    Its pre-tokenizer never joins characters across a blank or line feed, so a text's
    ids are those of its blank-separated parts. A part of Latin letters (and commas or
    full stops after them) is one pre-token for the library's model; any other part
    goes through the whole tokenizer. To meet fewer distinct parts, a text is lower-cased
    first where Python does that as the vocabulary's normaliser does (no capital sigma or dotted I,
    no special token), and a comma or full stop after a letter or digit is split off
    where no other sign stands before one (signs in a row are one pre-token).
    """

    ODD_CASE = re.compile(r"<\||[\u0130\u03a3]")
    SIGN_BEFORE = re.compile(r"[^a-z0-9ß-öø-ÿ \n][,.](?=[ \n])")

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,]*)", re.ASCII)
    UPPER = str.maketrans({c: c.lower() for c in map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])})

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = array("I"), array("q", [0])

    def word(self, part: str) -> list[int]:
        tokenize = self.tokenizer.model.tokenize
        if part.isascii() and part.isalpha() and part.islower():
            return [t.id for t in tokenize(part)]
        m = self.PLAIN.fullmatch(part.translate(self.UPPER)) if "<|" not in part else None
        if not m:
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        out = []
        for x in m.groups():
            if x:
                x = x if x.isascii() else "".join(self.letters[b] for b in x.encode())
                out += [t.id for t in tokenize(x)]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MEMO_WORDS:
            self.forget()
        known, parts = self.known, []
        for text in texts:
            text = text if self.ODD_CASE.search(text) else text.lower()
            text = text.replace("\n", " ")
            if not self.SIGN_BEFORE.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
            words = text.split(" ")
            try:
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            except KeyError:
                for w in words:
                    if w not in known:
                        if w:
                            self.ids.extend(self.word(w))
                        self.first.append(len(self.ids))
                        known[w] = len(known)
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            parts.append(at)
        flat, first = np.array(self.ids, np.uint32), np.array(self.first, np.int64)  # copies: an array can't grow while a view of it lives
        out = []
        for at in parts:
            size = first[at + 1] - first[at]
            ends = np.cumsum(size)
            n = int(ends[-1])
            out.append(flat[np.arange(n, dtype=np.int32) - np.repeat((ends - size - first[at]).astype(np.int32), size)])
        return out


def fullest(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length sum to the most that fits into capacity."""
    reach, trail, goal = 1, [], 1 << capacity
    whole = (goal << 1) - 1
    for size in sorted(lengths, reverse=True):
        if size > capacity:
            continue
        trail.append((size, reach))
        left, step = min(lengths[size], capacity // size), 1
        while left:  # counts by powers of two
            take = min(step, left)
            reach |= reach << (size * take) & whole
            left, step = left - take, step * 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, {}
    for size, before in reversed(trail):
        n = 0
        while not before >> total & 1:
            total, n = total - size, n + 1
        if n:
            out[size] = n
    return out


def pack(remainders: list[tuple[int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item's remainder, length) from (item, length)."""
    bags: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, size in sorted(remainders, key=lambda x: (x[1], -x[0])):
        bags[size].append((item, 0))
    counts = {k: len(v) for k, v in bags.items()}

    def take(size: int) -> tuple[int, int]:
        counts[size] -= 1
        if not counts[size]:
            del counts[size]
        return bags[size].pop()

    while counts:
        size = max(counts)
        chosen = [(*take(size), size)]
        free = window - size
        for s, n in fullest(counts, free).items():
            chosen += [(*take(s), s) for _ in range(n)]
            free -= s * n
        if free and counts:  # cut the longest piece left
            size = max(counts)
            item, start = take(size)
            chosen.append((item, start, free))
            bags[size - free].append((item, start + free))
            counts[size - free] = counts.get(size - free, 0) + 1
            free = 0
        if free:
            yield from powers_of_two(chosen, window - free)
        else:
            yield chosen


def powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into windows of falling powers of two, which need no padding."""
    rest = list(reversed(pieces))
    while total:
        free = 1 << total.bit_length() - 1
        total -= free
        out = []
        while free:
            item, start, size = rest.pop()
            n = min(size, free)
            out.append((item, start, n))
            if n < size:
                rest.append((item, start + n, size - n))
            free -= n
        yield out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it is cut from its document and where it lies in its window.

    A null text is empty: its document is the end id alone. Rows with the same key are
    packed one by one; a null key stays null. Texts of any length are packed whole; ties among
    equal lengths go by the order of reading. Only key and text are read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        keys, totals, rest, tails = [], [], [], []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part, out = b.slice(lo, 500), []
                for k, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    for at in range(0, n - window + 1, window):
                        out.append((k, at, window, zlib.crc32(ids[at : at + window].tobytes()), n, number, 0))
                        number += 1
                    if n % window:
                        rest.append((len(keys), n % window))
                        keys.append(k)
                        totals.append(n)
                        tails.append(ids[n - n % window :].astype(np.uint16 if ids.max(initial=0) < 65536 else np.uint32))
                if out:
                    yield rows(out)
        out = []
        for chosen in pack(rest, window):
            offset = 0
            for i, at, n in chosen:
                before = totals[i] - len(tails[i])
                out.append((keys[i], before + at, n, zlib.crc32(tails[i][at : at + n].astype("<u4").tobytes()), totals[i], number, offset))
                offset += n
            number += 1
            if len(out) > 20_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return docs.select(key, text).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents in windows of 2048 ids of `word_bpe_49k.json`, each document ended by id 1.

    Null and empty texts are one id, texts of any length are cut into as many windows as they need. An empty table gives no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
