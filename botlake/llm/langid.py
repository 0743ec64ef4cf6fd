"""Language identification by cross-parsing entropy.

For every language a bounded sample of labelled text is turned into a suffix
automaton. A document is parsed greedily against each of them: every phrase is the
longest match that starts where the last one ended. A text of the same language is
covered by few, long phrases; the language with the fewest phrases, normalised by
log2 of the reference length and by the text length, wins.

The automaton is unrolled into a dense table `state x byte class -> state`, in which
a missing transition restarts at the root and raises a flag. All documents of an
Arrow batch, and all languages, walk through the table side by side in numpy, a byte
a step. So that one very long document doesn't hold up the others, a text is walked in blocks
from the root, and then again from the state in which the block before it ended, until both walks are in one state
(a few phrases on) and stay together: the phrases are those of one walk through the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import row_slices, slices, utf8

UNKNOWN = "und"
BLOCK = 2048
#: The bounded sample that teaches: bytes of one language's whole texts (the last one ends with them), rows that are
#: drawn for them, and the size up to which a text is drawn first; languages at most.
REFERENCE_BYTES, REFERENCE_ROWS, ROW_CHARS, MOST_LANGUAGES = 16_000, 160, 2000, 512


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Lower-cased UTF-8 to symbols: letters a-z and bytes from 0x80 stay, all else is 0."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    return table[data]


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every text, runs of non-letters as one 0, and the offsets."""
    data, ends = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    symbols = byte_classes(data)
    keep = np.ones(len(symbols), bool)
    if len(symbols) > 1:
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    starts = ends[:-1][ends[:-1] < ends[1:]]
    keep[starts] = symbols[starts] != 0  # no gap before the first word
    kept = np.zeros(len(symbols) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return symbols[keep], kept[ends]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """The automata of all languages in one table."""

    def __init__(self, references: dict[str, bytes]):
        self.langs = sorted(references)
        known = sorted(set(b"".join(references.values())) | {0})
        self.width = len(known) + 1  # the last class: bytes that no reference has
        self.code = np.full(256, len(known), np.int32)
        self.code[known] = np.arange(len(known))
        self.bits = np.array([np.log2(max(2, len(references[x]))) for x in self.langs])
        tables, self.roots, at = [], [], 0
        for lang in self.langs:
            moves = suffix_automaton([int(self.code[b]) for b in references[lang]])
            table = np.full((len(moves), self.width), -1, np.int64)
            for s, go in enumerate(moves):
                table[s, list(go)] = list(go.values())
            # a missing transition ends the phrase and starts anew with the symbol; a symbol that the reference lacks is a phrase of its own
            restart = np.where(table[0] < 0, 0, table[0])
            ends = np.where(table < 0, np.where(table[0] < 0, 2, 1)[None, :], 0)
            ends[0] = table[0] < 0
            table = np.where(table < 0, restart, table) + at
            tables.append(table * self.width * 4 + ends)
            self.roots.append(at * self.width)
            at += len(moves)
        self.table = np.concatenate(tables).ravel().astype(np.int32 if at * self.width * 4 < 2**31 else np.int64) if tables else np.zeros(0, np.int32)

    def phrases(self, symbols: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Phrases of every text against every language: an array (texts, languages)."""
        n, langs = len(ends) - 1, len(self.langs)
        total = np.zeros((n, langs), np.int64)
        blocks = -(-np.diff(ends) // block)
        owner = np.repeat(np.arange(n), blocks)
        if not len(owner):
            return total
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])[owner]
        start = ends[:-1][owner] + (np.arange(len(owner)) - first) * block
        size = np.minimum(ends[1:][owner] - start, block)
        codes, roots = self.code[symbols], np.array(self.roots, self.table.dtype)[:, None]
        order = np.argsort(-size, kind="stable")
        begun = start[order]
        alive = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")  # blocks longer than t
        state = np.empty((langs, len(owner)), self.table.dtype)
        state[:] = roots
        cuts = np.zeros((langs, len(owner)), np.int32)
        for t, m in enumerate(alive):
            to = self.table[state[:, :m] + codes[begun[:m] + t]]
            cuts[:, :m] += to & 3
            state[:, :m] = to >> 2
        back = np.argsort(order, kind="stable")
        cuts, state = cuts[:, back], state[:, back]
        self._join(cuts, state, codes, start, size, np.arange(len(owner)) > first)
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        cuts += (state != roots) & last  # the phrase that the end cuts off
        for k in range(langs):
            total[:, k] = np.bincount(owner, weights=cuts[k], minlength=n).astype(np.int64)
        return total

    def _join(self, cuts: np.ndarray, state: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, follows: np.ndarray) -> None:
        """Corrects cuts and last states of blocks that follow others of their text, from walks that began at the root.

        A block whose last state changes is entered anew by the next one; most blocks' walks meet after a few bytes.
        """
        apart, own_cuts = state.copy(), cuts.copy()
        lang, block = np.nonzero(np.broadcast_to(follows, cuts.shape))
        while len(block):
            true, own = state[lang, block - 1], np.array(self.roots, self.table.dtype)[lang]
            more, end = np.zeros(len(block), np.int32), apart[lang, block]
            act, t = np.flatnonzero(true != own), 0
            while len(act):
                over = size[block[act]] <= t
                end[act[over]] = true[act[over]]
                act = act[~over]
                code = codes[start[block[act]] + t]
                x, y = self.table[true[act] + code], self.table[own[act] + code]
                more[act] += (x & 3) - (y & 3)
                true[act], own[act] = x >> 2, y >> 2
                act, t = act[true[act] != own[act]], t + 1
            cuts[lang, block] = own_cuts[lang, block] + more
            changed = (end != state[lang, block]) & (block + 1 < len(follows))
            state[lang, block] = end
            lang, block = lang[changed], block[changed] + 1
            keep = follows[block]
            lang, block = lang[keep], block[keep]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text; null or letterless texts: `und`, 0."""
        texts = texts.cast(pa.large_string())
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        _, raw = utf8(texts)
        cost = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts))
        for lo, hi in slices(raw, 1_500_000):
            symbols, ends = normalise(texts.slice(lo, hi - lo))
            cost[lo:hi] = self.phrases(symbols, ends)
            size[lo:hi] = np.diff(ends)
        cost = cost * self.bits / np.maximum(size, 1)[:, None]
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(best)), best]
        others = cost.copy()
        others[np.arange(len(best)), best] = np.inf
        second = others.min(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(np.isfinite(second) & (second > 0), 1 - least / second, np.where(second > 0, 1.0, 0.0))
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, np.clip(score, 0, 1), 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """References by language from a bounded, hash-drawn sample of labelled rows.

    A first pass counts rows by language (the MOST_LANGUAGES most frequent ones are learned); the second keeps about four times
    REFERENCE_ROWS of each language by a hash threshold, so that what is ranked and
    sent to the driver doesn't grow with the corpus. Whole texts teach, in the order of the draw, those of up to ROW_CHARS
    characters first, the longer ones once these are used up, until there are REFERENCE_BYTES (of which the last text may be cut). Rows with a null label or no text are left out.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.col(key).cast("string").alias("k"))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).collect()
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 4.0 * REFERENCE_ROWS / r["count"]))])
    draw = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30))
    order = Window.partitionBy("l").orderBy("long", "d", "k", "t")
    kept = (
        rows.where(draw / F.lit(float(1 << 30)) < F.element_at(shares, F.col("l")))
        .withColumns({"d": draw, "long": F.length("t") > ROW_CHARS})
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= REFERENCE_ROWS)
        .withColumn("before", F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("before").isNull() | (F.col("before") < 2 * REFERENCE_BYTES))
    )
    out: dict[str, bytes] = {}
    for r in kept.select("l", "r", F.substring("t", 1, REFERENCE_BYTES).alias("t")).orderBy("l", "r").collect():
        symbols, _ = normalise(pa.array([r["t"] + " "], pa.large_string()))
        out[r["l"]] = (out.get(r["l"], b"") + symbols.tobytes())[:REFERENCE_BYTES]
    return {k: v for k, v in out.items() if v.strip(b"\0")}


_PARSERS: dict[int, CrossParser] = {}


def parser(references: dict[str, bytes]) -> CrossParser:
    """Built once in each Python worker."""
    key = hash(tuple(sorted(references.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(references)
    return _PARSERS[key]


def predict(docs: DataFrame, references: dict[str, bytes], text: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(references)
        for b in row_slices(batches):
            names, score = p.predict(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out.

    Nulls: a null text is `und` with score 0, a null doc_id is not held out, a null
    label teaches nothing. Empty texts are `und`. Ties go to the language that sorts
    first. Repeated rows are predicted one by one, texts of any length whole. Other
    columns are not read. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    references = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), references)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
