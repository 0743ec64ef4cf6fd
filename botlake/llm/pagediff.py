"""Main text of web pages by nearest-URL page differencing.

A page becomes text lines (its blocks) in page order. Pages are ordered by host, URL path, URL and id, and
each is paired with the neighbour in that order, of the same host and another URL, that shares the longer path
prefix. The lines of the two are aligned by a longest common subsequence; lines that both
have at aligned places are the site's frame (menus, notices, footers) and are deleted.

What a page declares decides where differencing can't: lines inside its `article` or `main` element
are never deleted (two pages may carry the same passage), and what stands in menus, forms, adverts, comments and the like
goes even if this page alone has it. Copies of a page (the
same lines) count as one page here: the neighbour is the nearest page whose lines differ.

Pages are dealt in key ranges, so a host with a third of all pages spreads over many tasks; a task holds one page,
the names of its copies and its two neighbours at a time. A first pass over slim rows (keys and a digest of the
lines) finds the nearest differing pages beyond both ends of every range; the second pass sends those to the
range as well. The result doesn't depend on the ranges, and the text is shuffled once.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import row_slices
from .urls import url_host, url_path

#: Most key ranges, sampled keys of each, and the id that stands for a null one in the order.
RANGES, PER_RANGE, LEAST_ID = 4096, 64, -(1 << 63)
SENT = ["b", "s", "host", "path", "url", "id", "digest", "zones", "lines"]

# Elements by what they do to the text.
RAW = "script style noscript template textarea select button iframe svg object title".split()
SKIPPED = "nav footer aside form menu dialog".split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption"
).split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
#: Words of a class, id or role that name what isn't main text.
FRAME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer form masthead menu nav navbar navigation newsletter "
    "notice notices pagination popup promo promoted related replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][\w:-]*)[^>]*>",
    re.S | re.I,
)
#: Class words that name a wrapper's state (`has-sidebar`, `menu-open`), not what it holds.
STATE = re.compile(r"(?:has|no|with|without|is|show|hide)[-_].*|.*[-_](?:open|opened|closed|visible|hidden|enabled|disabled|active)")
#: What holds other people's words, adverts or teasers: an article in there is one of them.
CLOSED_WORDS = frozenset("ad ads advert advertisement adverts comment comments commentlist disqus popup promo promoted related replies sponsor sponsored".split())
CLOSED = frozenset("nav footer aside menu dialog".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS, _VOID, _SKIPPED = frozenset(BLOCKS), frozenset(VOID), frozenset(SKIPPED)


def frame_of(name: str, rest: str, in_main: bool) -> str:
    """`f` for an element that holds menus, notices, forms and the like, `x` for one that holds comments, adverts or teasers, so that no article in it is the page's; else empty."""
    found = "x" if name in CLOSED else "f" if name in _SKIPPED or (name == "header" and not in_main) else ""
    if found == "x" or name in ("html", "body", "main", "article") or "=" not in rest:
        return found
    tokens = {t for m in NAMES.finditer(rest) for t in next(filter(None, m.groups()), "").lower().split() if not STATE.fullmatch(t)}
    words = {w for t in tokens for w in re.split(r"[^a-z]+", t)}
    if words & CLOSED_WORDS or tokens & (FRAME_WORDS - {"form"}):
        return "x"
    return "f" if words & FRAME_WORDS else found


def lines_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of every block: zone `m` in the main element, `o` outside, `f` in a frame element.

    A `main` or `article` inside of a frame element (a form around the page, a wrapper named after its parts) is the main element, unless an
    element for comments, adverts, teasers, menus, footers or dialogs holds it. An end tag closes the nearest open element of its name and what is open inside it; without one it is ignored.
    """
    out: list[tuple[str, str]] = []
    opened: list[tuple[str, str]] = []  # name, zone around it
    zone, text, at = "o", [], 0
    page = page or ""

    def flush() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((zone if zone != "x" else "f", line))
        text.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        if m["close"] or m["close2"]:
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == name:
                    if name in _BLOCKS or not any(x in _BLOCKS for x, _ in opened[i + 1 :]):
                        if opened[i][1] != zone:
                            flush()
                        zone = opened[i][1]
                        del opened[i:]
                    break
        elif name not in _VOID and not (m["rest"] or "").endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and opened and opened[-1][0] == name:
                zone = opened.pop()[1]  # a new one ends the one before
            opened.append((name, zone))
            frame = frame_of(name, m["rest"] or "", zone == "m") if zone != "x" else ""
            if frame and (zone != "f" or frame == "x"):
                flush()
                zone = frame
            elif zone in "of" and name in ("article", "main") or zone == "x" and name == "main" and not any(n in CLOSED for n, _ in opened):
                flush()
                zone = "m"
    tail = page[at:]
    text.append(re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", tail))  # a tag that is cut off is no text
    flush()
    return out


def prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of a and every prefix of b, by bit vectors over b."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    full = v = (1 << len(b)) - 1
    masks: dict[str, int] = {}  # of frequent lines alone, so that they stay small together
    for x in a:
        mask = masks.get(x)
        if mask is None:
            js = places.get(x, ())
            mask = sum(1 << j for j in js) if len(js) < 64 else int("".join("1" if y == x else "0" for y in reversed(b)), 2)
            if len(js) >= 64:
                masks[x] = mask
        if mask:
            u = v & mask
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(a: list[str], b: list[str]) -> set[int]:
    """Positions of a that a longest common subsequence of the lists matches.

    Hirschberg's division at every size: a is halved, b is cut where the lengths of both halves add up to the most.
    """
    out: set[int] = set()
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in at], [x for x in b if x in both]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.add(at[lo])
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.add(at[hi])
        if lo == hi or low == high:
            continue
        if hi - lo == 1:
            if a[lo] in b[low:high]:
                out.add(at[lo])
            continue
        mid, part = (lo + hi) // 2, b[low:high]
        cut = low + int(np.argmax(prefix_lengths(a[lo:mid], part) + prefix_lengths(a[mid:hi][::-1], part[::-1])[::-1]))
        todo += [(lo, mid, low, cut), (mid, hi, cut, high)]
    return out


def kinship(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def main_text(page: list[tuple[str, str]], neighbour: list[tuple[str, str]] | None) -> tuple[str, int, int]:
    """The page's lines without those it shares with its neighbour outside the main element, joined by blank lines;
    how many lines went because the neighbour has them, and how many more because of the element they stand in."""
    shared = aligned([t for _, t in page], [t for _, t in neighbour]) if neighbour else set()
    kept = [t for i, (z, t) in enumerate(page) if z == "m" or (z == "o" and i not in shared)]
    n_shared = sum(page[i][0] != "m" for i in shared)
    return "\n\n".join(kept), n_shared, len(page) - len(kept) - n_shared


Key = tuple[str, str, str, int, int]  # host, path, url, id, digest of the lines that may be kept


@dataclass
class Ranges:
    """Key ranges, and for each what lies beyond its ends: pages to send there as neighbours, and whether copies go on there."""

    cuts: list[Key]
    before: dict[Key, list[int]] = field(default_factory=dict)
    after: dict[Key, list[int]] = field(default_factory=dict)
    copied: set[tuple[int, int]] = field(default_factory=set)  # (range, 0: its first lines stand before it too, 2: its last ones after it)

    def of(self, key: Key) -> int:
        return bisect.bisect_right(self.cuts, key)


def digest_of(lines: list[tuple[str, str]]) -> int:
    """Of the lines that may be kept; 0 without any."""
    kept = "\n".join(t for z, t in lines if z != "f")
    return int.from_bytes(hashlib.blake2b(kept.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1 if kept else 0


def keyed(part: pa.RecordBatch) -> tuple[list[list[tuple[str, str]]], list[Key]]:
    """Lines and keys of rows (host, path, url, id, ..., html)."""
    lines = [lines_of(h) for h in part.column(part.num_columns - 1).to_pylist()]
    host, path, url, key = (part.column(i).to_pylist() for i in range(4))
    return lines, [(h, p, u or "", LEAST_ID if i is None else i, digest_of(x)) for h, p, u, i, x in zip(host, path, url, key, lines, strict=True)]


def find_ranges(slim: DataFrame, partitions: int) -> Ranges:
    """Cuts from a bounded sample of the keys, then the ends of all ranges from a pass over the lines' digests.

    At most RANGES cuts and four keys of each range reach the driver.
    """
    ranges = min(RANGES, partitions)
    n = slim.count()
    keys = ["host", "path", "u", "i"]
    draw = F.pmod(F.xxhash64("u", "i", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    key_rows = slim.select("host", "path", F.coalesce("url", F.lit("")).alias("u"), F.coalesce("id", F.lit(LEAST_ID)).alias("i"))
    sample = sorted(tuple(r) for r in key_rows.where(draw < PER_RANGE * ranges / max(n, 1)).limit(2 * PER_RANGE * ranges).collect())
    out = Ranges(sorted({(*sample[len(sample) * k // ranges], -(1 << 63)) for k in range(1, ranges)}) if sample else [])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 200):
            rows = [(out.of(k), *k) for k in keyed(part)[1] if k[4]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["b", *keys, "digest"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, first, second, last, other = None, None, None, None, None

        def row() -> pa.RecordBatch:
            found = [(b, n, *k) for n, k in enumerate((first, second, last, other)) if k]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["b", "n", *keys, "digest"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                k = r[1:]
                if r[0] != b:
                    if first:
                        yield row()
                    b, first, second, last, other = r[0], k, None, k, None
                elif (k[0], k[4]) != (last[0], last[4]):
                    second, other = second or k, last
                last = k
        if first:
            yield row()

    digests = slim.mapInArrow(parse, "b long, host string, path string, u string, i long, digest long")
    found = digests.repartitionById(ranges, F.col("b").cast("int")).sortWithinPartitions("b", *keys, "digest").mapInArrow(ends, "b long, n long, host string, path string, u string, i long, digest long").collect()
    by_range: dict[int, dict[int, Key]] = defaultdict(dict)
    for r in found:
        by_range[r["b"]][r["n"]] = tuple(r)[2:]
    order = sorted(by_range)
    same = lambda x, y: (x[0], x[4]) == (y[0], y[4])

    def sentinels(order: list[int], own: int, near: int, far: int, to: dict[Key, list[int]]) -> None:
        """The nearest page of other lines before each range (in the given order): the neighbouring range's end, or
        the one beyond that end's copies, or, if all of that range is copies of it, its own neighbour."""
        beyond: Key | None = None
        for at, b in enumerate(order[1:], 1):
            ends, mine = by_range[order[at - 1]], by_range[b][own]
            if same(ends[near], mine):
                out.copied.add((b, own))
                beyond = ends.get(far) or beyond
            else:
                beyond = ends[near]
            if beyond and beyond[0] == mine[0]:
                to.setdefault(beyond, []).append(b)

    sentinels(order, 0, 2, 3, out.before)
    sentinels(order[::-1], 2, 0, 1, out.after)
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", partitions: int | None = None) -> DataFrame:
    """(key, url, text, n_chars, n_shared, n_frame) of every row of pages.

    n_shared lines went because the neighbour has them, n_frame more because of the element they stand in. A null html
    is empty and gives an empty text. Pages with a null URL (or one without a host) count as one
    host with an empty path. Repeated rows and copies beside each other are compared with the nearest page of other lines;
    where their host has none, they keep their main element, or, without one, everything. A page whose neighbours have its own URL keeps
    what no frame element holds. Very long pages are aligned exactly too. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    slim = pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(url).alias("url"), F.col(key).cast("long").alias("id"), F.col(html).alias("html"))
    partitions = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = find_ranges(slim, partitions)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 200):
            lines, keys = keyed(part)
            # 0: a page before the range, 1: of the range, 2: after it
            sent = [(ranges.of(k), 1, n) for n, k in enumerate(keys)]
            sent += [(b, 0, n) for n, k in enumerate(keys) for b in ranges.before.get(k, ())] + [(b, 2, n) for n, k in enumerate(keys) for b in ranges.after.get(k, ())]
            b, s, n = zip(*sent)
            rows = part.take(pa.array(n))
            zones = ["".join(z for z, _ in lines[i]) for i in n]
            texts = [[t for _, t in lines[i]] for i in n]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.int32()), *rows.columns[:4], pa.array([keys[i][4] for i in n]), pa.array(zones), pa.array(texts, pa.list_(pa.string()))], names=SENT)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, run, rows = None, [], []  # the last page of other lines, pages with the same lines, finished rows
        at = None  # the range

        def finish(after: dict | None) -> Iterator[pa.RecordBatch]:
            """Rows of the run, a thousand at a time: a text of many copies is written out piece by piece."""
            is_first, is_last = before is None or before["s"] == 0, after is None or after["s"] == 2
            copied = len(run) > 1 or (is_first and (at, 0) in ranges.copied) or (is_last and (at, 2) in ranges.copied)
            texts: dict[tuple, tuple] = {}
            for page in run:
                near = [x for x in (before, after) if x and x["host"] == page["host"] and (x["url"] is None or x["url"] != page["url"])]
                other = max(near, key=lambda x: kinship(x["path"], page["path"])) if near else None  # the first of equals
                if not near and copied and "m" in page["zones"]:
                    other = run[0]  # copies alone: what is outside the main element is in every one
                lines, theirs = page["lines"] or run[0]["lines"], other and (other["lines"] or run[0]["lines"])
                which = (id(other), id(lines), page["zones"])
                if which not in texts:
                    texts[which] = main_text(list(zip(page["zones"], lines)), list(zip(other["zones"], theirs)) if other else None)
                text, n_shared, n_frame = texts[which]
                rows.append((page["id"], page["url"], text, len(text), n_shared, n_frame))
                if len(rows) >= 1000:
                    yield out()
            run.clear()

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars", "n_shared", "n_frame"])

        for part in row_slices(batches, 500):
            for page in part.to_pylist():
                if page["b"] != at:
                    if run:
                        yield from finish(None)
                    at, before = page["b"], None
                if page["s"] == 0:
                    before = page
                elif page["s"] == 2:
                    if run:
                        yield from finish(page)
                elif not page["digest"]:  # nothing to keep, and nothing to compare with
                    rows.append((page["id"], page["url"], "", 0, 0, len(page["zones"])))
                elif run and (page["host"], page["digest"]) == (run[0]["host"], run[0]["digest"]):
                    same = {c: run[0][c] for c in ("host", "zones") if page[c] == run[0][c]}  # a copy holds little of its own
                    run.append({c: page[c] for c in ("host", "path", "url", "id", "s", "zones")} | same | {"lines": None if page["lines"] == run[0]["lines"] else page["lines"]})
                else:
                    if run:
                        last = run[-1] | {"lines": run[-1]["lines"] or run[0]["lines"]}
                        yield from finish(page)
                        before = last
                    run.append(page)
            if rows:
                yield out()
        if run:
            yield from finish(None)
        if rows:
            yield out()

    parsed = slim.mapInArrow(parse, "b int, s int, host string, path string, url string, id long, digest long, zones string, lines array<string>")
    order = ["b", "s", "host", "path", F.coalesce("url", F.lit("")), F.coalesce("id", F.lit(LEAST_ID)), "digest"]
    dealt = parsed.repartitionById(len(ranges.cuts) + 1, F.col("b")).sortWithinPartitions(*order)
    found = dealt.mapInArrow(pair, "id long, url string, text string, n_chars long, n_shared long, n_frame long")
    return found.select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars", "n_shared", "n_frame")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (see extract)."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
