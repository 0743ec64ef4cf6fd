"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut before each blank into marked words: the blank becomes the mark U+2581, and
the text's start is marked as well. The distinct words of an Arrow batch are sorted, which
lays them out as the depth-first order of a trie: two neighbours share a path as long as
their common prefix. The forward scores of the path (best score and last piece at every
depth) stay on a stack; only what lies below the shared prefix is computed. Words longer than LONGEST_WORD
go one by one, by the same rule with scores only as deep as the longest piece.

The vocabulary is a public model's pieces. That model ranks its pieces by merges and has no
probabilities, so a piece's score is the log of a Zipf law over its rank. The segmentation
maximises the sum of scores; it is not the merge order of the model's own encoder.
Characters outside the vocabulary, and marks that stand in the text itself, become byte pieces,
so every text comes back exactly.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import row_slices

MARK, MEMO_WORDS, LONGEST_WORD = "▁", 400_000, 4096
#: What one byte piece costs more than the rarest piece.
BYTE_PENALTY = 10.0


class Pieces:
    """A vocabulary with Zipf scores, a trie of its pieces, and a memo of words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = [0] * 256
        self.text: dict[int, str] = {}
        plain = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
                self.text[i] = piece
        self.longest = max(map(len, self.text.values()), default=1)
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        total = float(np.sum(1 / np.arange(1, len(plain) + 1)))
        self.root: dict = {}
        for rank, i in enumerate(plain):
            node = self.root
            for c in self.text[i]:
                node = node.setdefault(c, {})
            node[""] = (i, -float(np.log((rank + 1) * total)))
        self.byte_score = -float(np.log(max(1, len(plain)) * total)) - BYTE_PENALTY
        pieces = {**{i: t.replace(MARK, " ").encode() for i, t in self.text.items()}, **{i: bytes([b]) for i, b in self.bytes.items()}}
        each = [pieces.get(i, b"") for i in range(model.get_piece_size())]
        self.raw, self.raw_ends = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        self.forget()

    def forget(self) -> None:
        """Starts the memo of words anew: the place of each, and all their ids one after the other."""
        self.known: dict[str, int] = {}
        self.ids, self.first = array("i"), array("q", [0])

    def encode_sorted(self, words: list[str]) -> list[tuple[int, ...]]:
        """ids of sorted distinct words, reusing forward scores along shared prefixes.

        Forward, from every depth the pieces that start there relax the depths at which they end.
        A depth is final once all starts before it were expanded, which depends on the
        word's characters up to it alone, so a neighbour may keep it.
        """
        out, before = [], ""
        best, back = [0.0], [(0, 0)]  # at each depth: score, (start of the last piece, its id; -1: bytes)
        # live[d]: trie nodes of the pieces under way at depth d, with their starts
        live: list[list[tuple[int, dict]]] = [[]]
        for word in words:
            same = 0
            most = min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :], live[same + 1 :]
            for d in range(same, len(word)):
                c = word[d]
                # a byte run always ends a piece: the character alone, by its bytes
                top, link = best[d] + self.byte_score * len(c.encode()), (d, -1)
                going = []
                for start, node in (*live[d], (d, self.root)):
                    to = node.get(c)
                    if to is not None:
                        going.append((start, to))
                        end = to.get("")
                        if end is not None and best[start] + end[1] > top:
                            top, link = best[start] + end[1], (start, end[0])
                best.append(top)
                back.append(link)
                live.append(going)
            ids: list[int] = []
            d = len(word)
            while d:
                start, i = back[d]
                if i < 0:
                    ids.extend(self.byte_ids[b] for b in reversed(word[start:d].encode()))
                else:
                    ids.append(i)
                d = start
            out.append(tuple(reversed(ids)))
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of every text: of its words, each with a mark in front for the text's start or the blank before it."""
        if len(self.known) > MEMO_WORDS:
            self.forget()
        known, split = self.known, [t.split(" ") for t in texts]
        new = sorted({w for ws in split for w in ws if w not in known})
        short = [w for w in new if len(w) < LONGEST_WORD and MARK not in w]
        found = dict(zip(short, self.encode_sorted([MARK + w for w in short]), strict=True))
        for w in new:
            self.ids.extend(found[w] if w in found else self.encode_hard(MARK + w))
            self.first.append(len(self.ids))
            known[w] = len(known)
        flat, first = np.array(self.ids, np.int32), np.array(self.first, np.int64)  # copies: an array can't grow while a view of it lives
        out = []
        for ws in split:
            at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
            out.append(flat[stretches(first[at], first[at + 1])])
        return out

    def encode_hard(self, word: str) -> tuple[int, ...]:
        """A word that holds a literal mark, or is very long: its parts between marks, the first one with the mark in front."""
        ids: list[int] = []
        for n, part in enumerate(word[1:].split(MARK)):
            if n:
                ids += [self.byte_ids[b] for b in MARK.encode()]
            ids += self.encode_long(part if n else MARK + part)
        return tuple(ids)

    def encode_long(self, word: str) -> list[int]:
        """The best path of a word of any length: scores and trie nodes only as deep as a piece, back pointers in arrays.

        The same relaxation, in the same order, as encode_sorted.
        """
        start, piece = array("i", [0]), array("i", [0])  # of the last piece at each depth; id -1: bytes
        best = [0.0] * (self.longest + 1)  # by depth modulo its length
        live: list[tuple[int, dict]] = []
        room = len(best)
        for d, c in enumerate(word):
            top, link = best[d % room] + self.byte_score * len(c.encode()), (d, -1)
            going = []
            for at, node in (*live, (d, self.root)):
                to = node.get(c)
                if to is not None:
                    going.append((at, to))
                    end = to.get("")
                    if end is not None and best[at % room] + end[1] > top:
                        top, link = best[at % room] + end[1], (at, end[0])
            best[(d + 1) % room] = top
            start.append(link[0])
            piece.append(link[1])
            live = going
        ids: list[int] = []
        d = len(word)
        while d:
            at, i = start[d], piece[d]
            if i < 0:
                ids.extend(self.byte_ids[b] for b in reversed(word[at:d].encode()))
            else:
                ids.append(i)
            d = at
        ids.reverse()
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces with marks as blanks, byte pieces as UTF-8, less the first mark. Control pieces have no text."""
        at = np.asarray(ids, np.int64)
        return self.raw[stretches(self.raw_ends[at], self.raw_ends[at + 1])].tobytes().decode("utf-8", "replace")[1:]


def stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places start to end - 1 of all stretches, one after the other."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - sizes - starts, sizes)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "ids") -> DataFrame:
    """All columns of docs and `to`, the array of ids. Rows stay where they are.

    A null text has null ids, an empty one the mark alone; repeated rows are encoded one by one; texts and words of any length get
    their best path, and of paths that score alike the one whose last piece starts first. Columns of any name go through (`to` is replaced). An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != to]
    schema = docs.select(*names).withColumn(to, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 500):
            texts = part.column("text").to_pylist()
            ids = iter(pieces(model).encode([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_struct_array(part.column("row")).columns, pa.array([None if t is None else next(ids) for t in texts], pa.list_(pa.int32()))], names=[*names, to])

    return docs.select(F.struct(*names).alias("row"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """All columns of tokens and `to`, the text of the ids (null ids: null). Columns of any name go through (`to` is replaced)."""
    names = [c for c in tokens.columns if c != to]
    schema = tokens.select(*names).withColumn(to, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 500):
            texts = [None if x is None else pieces(model).decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_struct_array(part.column("row")).columns, pa.array(texts, pa.string())], names=[*names, to])

    return tokens.select(F.struct(*names).alias("row"), F.col(ids).alias("ids")).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document encoded with the pieces of `piece_bpe_32k.model` and decoded again: number of ids, their CRC-32
    (little-endian unsigned 32-bit ids), and whether the text came back.

    Null and empty texts: an empty text is one mark; a null has no ids (0, null, null). Repeated rows are kept.
    """
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for part in row_slices(batches, 500):
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            found = iter(p.encode([t for t in texts if t is not None]))
            rows = []
            for k, t in zip(keys, texts, strict=True):
                ids = None if t is None else next(found)
                rows.append((k, 0, None, None) if ids is None else (k, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p.decode(ids) == t))
            if rows:
                a, n, c, r = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.mapInArrow(run, schema)
