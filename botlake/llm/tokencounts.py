"""Token counts by a byte-level BPE vocabulary, with overlap resynchronisation of huge documents.

Ordinary texts are counted where they are read. A text of more than `chunk` bytes is cut into
chunks that overlap, and these are dealt over all tasks: each is encoded with the byte offsets of its
tokens, and two neighbours are spliced at a common token boundary that is proven to be one of the
whole text. What each splice adds is a difference of two token numbers, so a document's count is a sum.
Documents with two neighbours that have no such boundary are cut again, with chunks and overlaps
WIDER times as long, until all are spliced; a chunk that holds the whole text needs none.

Proof of a boundary p at least MARGIN bytes before the left chunk's end. The pre-tokenizer is a scan from the
left without memory that looks at most two characters beyond a match, and an added token is
shorter than MARGIN. (1) p ends a pre-token in both chunks: the left chunk saw all that decides on it,
and the scan of the whole text goes on from p as the right chunk's does. (2) p lies inside a pre-token of
both, at least INSIDE bytes after its start, so that it is a run of one kind of characters that ends at the same place for
both: merges by rank make a token sequence the encoding of its text exactly if every two neighbouring
tokens are the encoding of theirs, so the two sides fit if the token before p of the left chunk
and the token after p of the right one do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import batches_of, stored

CHUNK, OVERLAP, WIDER = 1 << 16, 1 << 9, 8
MARGIN, INSIDE = 32, 4
#: Parts of texts whose counts a worker remembers before it starts anew.
MEMO_PARTS = 500_000
#: Bytes of texts in an Arrow batch (a longer text stands alone).
BATCH_BYTES = 16 << 20
LIMIT = 1024


class ByteLevel:
    """Counts and offsets by a `tokenizers` vocabulary of the byte-level kind without normaliser or prefix space."""

    #: A blank between two characters of white space, or after one at the end: not surely the start of a pre-token.
    UNSURE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        if any(len(a["content"].encode()) >= MARGIN or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must be short and stand for themselves")
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {i: t for t, i in spec["model"]["vocab"].items()}  # one letter a byte
        self.added = [a["content"] for a in spec["added_tokens"]]
        sizes = {i: len(t) for i, t in self.letters.items()} | {a["id"]: len(a["content"].encode()) for a in spec["added_tokens"]}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self.known: dict[str, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. A part between blanks is counted with the blank before it, once for all texts, where each blank surely starts a pre-token."""
        if len(self.known) > MEMO_PARTS:
            self.known.clear()
        whole, split, fresh = [], {}, set()
        for i, text in enumerate(texts):
            if self.UNSURE.search(text) or any(a in text for a in self.added):
                whole.append(i)
                continue
            first, *rest = text.split(" ")
            split[i] = (first, rest)
            fresh.update(rest)
        known = self.known
        fresh = [w for w in fresh if w not in known]
        encode = self.tokenizer.encode_batch_fast
        known.update(zip(fresh, (len(e.ids) for e in encode([" " + w for w in fresh], add_special_tokens=False)), strict=True))
        out = [0] * len(texts)
        for i, e in zip(whole, encode([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        firsts = encode([first for first, _ in split.values()], add_special_tokens=False)
        for (i, (_, rest)), e in zip(split.items(), firsts, strict=True):
            out[i] = len(e.ids) + sum(map(known.__getitem__, rest))
        return out

    def offsets(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, the byte offsets of all token boundaries, and how many bytes after the start of its pre-token each lies (0: at one)."""
        e = self.tokenizer.encode(piece.decode(), add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        if at[-1] != len(piece):
            raise ValueError("the vocabulary doesn't cover all bytes")
        words = np.array(e.word_ids, np.int64)
        fresh = np.ones(len(ids) + 1, bool)
        fresh[1:-1] = words[1:] != words[:-1]
        starts = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        return ids, at, at - starts

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their joined text."""
        if (a, b) not in self.fits:
            self.fits[a, b] = [t.id for t in self.tokenizer.model.tokenize(self.letters[a] + self.letters[b])] == [a, b]
        return self.fits[a, b]

    def splice(self, left: dict, right: dict) -> int | None:
        """Tokens of the left chunk before the first stable common boundary less those of the right chunk before it; None if there is none."""
        _, i, j = np.intersect1d(left["at"], right["at"], assume_unique=True, return_indices=True)
        for x, y in zip(i, j, strict=True):
            d, e = left["depth"][x], right["depth"][y]
            if (d == 0 and e == 0) or (d >= INSIDE and e >= INSIDE and self.fit(left["before"][x], right["after"][y])):
                return int(left["n"][x] - right["n"][y])
        return None


_ENCODERS: dict[str, ByteLevel] = {}


def encoder(path: str) -> ByteLevel:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevel(path)
    return _ENCODERS[path]


def aligned(data: bytes, at: int) -> int:
    """The first start of a character at or after a place."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def chunks(data: bytes, size: int, overlap: int) -> Iterator[tuple[int, int, int, bool]]:
    """(number, start, end, whether it is the last) of the overlapping chunks of a text."""
    k = 0
    while True:
        last = (k + 1) * size + overlap >= len(data)
        yield k, aligned(data, k * size), len(data) if last else aligned(data, (k + 1) * size + overlap), last
        if last:
            return
        k += 1


COUNTED = "doc_id long, n_bytes long, n_tokens long, row long, body binary"
PIECES = "row long, k long, start long, next long, last boolean, overlap long, body binary"
BORDERS = "row long, k long, side int, total long, at array<long>, n array<long>, depth array<long>, before array<long>, after array<long>"
SPLICED = "row long, n_tokens long, ok boolean"


def _first_pass(vocabulary: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, task = encoder(vocabulary), TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [x or "" for x in part.column(1).to_pylist()]
                bodies = [t.encode() for t in texts]
                huge = [len(x) > chunk for x in bodies]
                ready = iter(count.counts([t for t, h in zip(texts, huge, strict=True) if not h]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(0).to_pylist(), pa.int64()),
                        pa.array(map(len, bodies), pa.int64()),
                        pa.array([None if h else next(ready) for h in huge], pa.int64()),
                        pa.array(range(row, row + len(texts)), pa.int64()),
                        pa.array([x if h else None for x, h in zip(bodies, huge, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "row", "body"],
                )
                row += len(texts)

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, lo, hi, last in chunks(data, chunk, overlap):
                    one = [row, k, lo, None if last else aligned(data, (k + 1) * chunk), last, overlap, data[lo:hi]]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()], strict=True)], names=["row", "k", "start", "next", "last", "overlap", "body"])

    return run


def _encode(vocabulary: str):
    """Each chunk as one or two border rows: border k lies between the chunks k and k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            out = []
            for c in b.to_pylist():
                ids, at, depth = encode.offsets(c["body"])
                at = at + c["start"]
                end = c["start"] + len(c["body"])

                def border(k: int, side: int, keep: np.ndarray) -> dict:
                    i = np.flatnonzero(keep)
                    return {"row": c["row"], "k": k, "side": side, "total": None, "at": at[i], "n": i, "depth": depth[i], "before": ids[i - 1], "after": ids[np.minimum(i, len(ids) - 1)]}  # noqa: B023

                inner = (at > c["start"]) & (at < end)
                if c["k"]:
                    out.append(border(c["k"] - 1, 1, inner & (at <= c["start"] + c["overlap"] + MARGIN)))
                if c["last"]:
                    out.append({"row": c["row"], "k": c["k"], "side": 0, "total": len(ids)})
                else:
                    out.append(border(c["k"], 0, inner & (at >= c["next"]) & (at <= end - MARGIN)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 5]
                names = ["row", "k", "side", "total", "at", "n", "depth", "before", "after"]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return run


def _splice(vocabulary: str):
    """The two sides of each border follow each other; what a border, or the last chunk, adds to its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(vocabulary), None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["total"] is not None:
                    out.append((r["row"], r["total"], True))
                elif r["side"] == 0:
                    held = r
                else:
                    found = encode.splice({k: np.array(v) if k == "at" else v for k, v in held.items()}, {k: np.array(v) if k == "at" else v for k, v in r.items()})
                    out.append((r["row"], found, found is not None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.bool_()], strict=True)], names=["row", "n_tokens", "ok"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, counted as the vocabulary's library does for the whole text.

    A null text is empty and has no tokens; a null key stays null; rows that share a key are counted one by one. Texts
    of more than `chunk` bytes are stored (in the shared folder) and cut; no text is shuffled but those. Ties don't arise. Other columns are not read;
    an empty table gives no rows. `chunk` must be longer than the overlap.
    """
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("an overlap longer than twice the margin and shorter than a chunk is needed")
    spark = docs.sparkSession
    with batches_of(spark, BATCH_BYTES):
        first = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_first_pass(vocabulary, chunk), COUNTED), "tokens")
        todo = first.where(F.col("body").isNotNull()).select("row", "body")
        found, made = None, []
        while not todo.isEmpty():
            dealt = todo.mapInArrow(_cut(chunk, overlap), PIECES).repartition("row", "k")
            borders = dealt.mapInArrow(_encode(vocabulary), BORDERS).repartition("row", "k").sortWithinPartitions("row", "k", "side")
            part = stored(borders.mapInArrow(_splice(vocabulary), SPLICED).groupBy("row").agg(F.sum("n_tokens").alias("long_tokens"), F.min("ok").alias("ok")), "spliced")
            made.append(part)
            ready = part.where("ok").select("row", "long_tokens")
            found = ready if found is None else found.unionByName(ready)
            todo = todo.join(part.where(~F.col("ok")).select("row"), "row", "left_semi")
            chunk, overlap = chunk * WIDER, overlap * WIDER
    if found is None:
        counted = first
    else:
        counted = first.drop("body").join(found, "row", "left").withColumn("n_tokens", F.coalesce("n_tokens", "long_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every whole document by `byte_bpe_50k.json`; strings of special tokens inside a text are that token, as is the library's default.

    Null and empty texts have 0 bytes and 0 tokens, texts of any length are counted whole, repeated rows one by one, further columns
    are not read, and an empty table gives no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
