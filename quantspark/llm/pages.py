"""Main text of web pages: markup parsed into lines, pages differenced against the nearest URLs of their host."""

import html as html_entities
import pickle
import re
import tempfile
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import cut, drop, small_batches

# Elements whose content is never main text, raw-text and void elements, and inline ones (all others
# begin and end a line).
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "head"}
RAW = {"script", "style", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
#: Words of class and id values (and roles) that name page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side-bar|footer|header|masthead|"
    r"notice|cookie\w*|consent|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|disqus|widget|"
    r"navigation|contentinfo|complementary|search)(?:$|[\s_-])",
    re.I,
)
# Start tags that end an open paragraph, and for other elements whose end tags may be missing: the open
# elements that their start tag ends, and the ones that it doesn't look beyond.
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "li", "dt", "dd",
}
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: A quote has a meaning after an equals sign only.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"[\s\x00]+")


@dataclass(frozen=True)
class PagesConfig:
    #: Share of the characters of the longer page's body that make two pages near copies, which aren't differenced:
    #: where both mark their main text, and where not (a short body shares most of its characters with any neighbour).
    copy_marked: float = 0.5
    copy_unmarked: float = 0.9
    #: Main text elements decide if they hold this share of the text outside furniture (a teaser card doesn't).
    least_main: float = 0.5
    #: Pages of a block's halo on either side, which spare most blocks a look at others (neighbours are found at any
    #: distance); pages of a block, and the greatest number of blocks, whose bounds every task holds (blocks grow beyond).
    reach: int = 16
    block: int = 512
    most_blocks: int = 4096


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """Lines of a page in order: (text, in furniture, in main text element).

    Comments, declarations, scripts and styles vanish; character references are decoded; white space in a line is one
    space. Missing end tags are tolerated: an end tag closes up to its last open element, one without is ignored, and the
    elements that need none end where HTML says so.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()  # names on the stack, so that a stray end tag doesn't search all of it
    parts: list[str] = []
    state = [False, False]

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html_entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, state[0], state[1]))

    def close(depth: int) -> None:
        if stack[depth][1] != state[0] or stack[depth][2] != state[1]:
            flush()
        state[:] = stack[depth][1:]
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    def implied(name: str) -> None:
        if name in ENDS_PARAGRAPH and opened["p"]:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        ended, bounds = IMPLIED_ENDS.get(name, ((), ()))
        if any(opened[x] for x in ended):
            found = None
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in bounds:
                    break
                found = depth if stack[depth][0] in ended else found
            if found is not None:
                close(found)

    at = 0
    while True:
        tag = TAG.search(html, at)
        if not tag:
            parts.append(html[at:])
            break
        parts.append(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if tag[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened[name] else None
            # An end tag inside furniture or main text does not close what stands around it.
            if depth is not None and not (name in INLINE and any(s[0] not in INLINE for s in stack[depth:])):
                close(depth)
            continue
        implied(name)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or tag[3].rstrip().endswith("/") and name not in MAIN | DROPPED:
            continue
        named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(tag[3])} if tag[3] else {}
        marks = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        furniture = name in DROPPED or bool(marks and FURNITURE.search(marks)) or "hidden" in named
        if furniture or name in MAIN:
            flush()
        stack.append((name, state[0], state[1]))
        opened[name] += 1
        state[:] = [state[0] or furniture, state[1] or name in MAIN]
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` a longest common subsequence aligns with lines of ``b``."""
    marks = np.zeros(len(a), dtype=bool)
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        marks[lead] = True
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        marks[len(a) - 1 - tail] = True
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    common = set(x) & set(y)
    rows, cols = [i for i, t in enumerate(x) if t in common], [t for t in y if t in common]
    if not rows:
        return marks
    ids = {t: i for i, t in enumerate(common)}
    for i in _aligned(np.array([ids[x[i]] for i in rows]), np.array([ids[t] for t in cols])):
        marks[lead + rows[i]] = True
    return marks


def _lengths(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """After each of ``a``: the length of the longest common subsequence with every beginning of ``b``."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for t in a:
        hit = np.where(b == t, best[:-1] + 1, 0)
        best = np.maximum.accumulate(np.concatenate(([0], np.maximum(hit, best[1:]))))
        yield best


def _aligned(a: np.ndarray, b: np.ndarray, most: int = 1 << 27) -> list[int]:
    """Places of ``a`` in a longest common subsequence. The choices are kept as bits; a table of more than ``most`` is
    halved first (Hirschberg), so memory stays bounded."""
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) > most and len(a) > 1:
        half = len(a) // 2
        for front in _lengths(a[:half], b):  # noqa: B007
            pass
        for back in _lengths(a[half:][::-1], b[::-1]):  # noqa: B007
            pass
        at = int((front + back[::-1]).argmax())
        return _aligned(a[:half], b[:at], most) + [half + i for i in _aligned(a[half:], b[at:], most)]
    took, before = [], np.zeros(len(b) + 1, dtype=np.int32)
    for best in _lengths(a, b):
        took.append(np.packbits(best > before))
        before = best
    out, j = [], len(b)
    for r in range(len(a) - 1, -1, -1):
        if np.unpackbits(took[r], count=len(b) + 1)[j]:  # this row lengthened the sequence that ends by column j
            out.append(r)
            j = int(np.flatnonzero(b[:j] == a[r])[-1])  # take its last such line
    return out[::-1]


def body_of(lines: list[tuple[str, bool, bool]], cfg: PagesConfig = PagesConfig()) -> tuple[list[bool], bool]:
    """Which lines may be main text, and whether main text elements decide: they hold enough of what isn't furniture."""
    inside = sum(len(t) for t, f, m in lines if m and not f)
    marked = inside > 0 and inside >= cfg.least_main * sum(len(t) for t, f, _ in lines if not f)
    return [not f and (m or not marked) for _, f, m in lines], marked


def near_copies(a: list, b: list, shared_a: np.ndarray, shared_b: np.ndarray, cfg: PagesConfig = PagesConfig()) -> bool:
    """Whether two pages have mostly the same body, by the lines that they share in order."""
    (own, marked), (other, also) = body_of(a, cfg), body_of(b, cfg)
    same, size = 0, 0
    for lines, body, shared in ((a, own, shared_a), (b, other, shared_b)):
        long = sum(len(t) for (t, _, _), k in zip(lines, body, strict=True) if k)
        if long >= size:
            same, size = sum(len(t) for (t, _, _), k, s in zip(lines, body, shared, strict=True) if k and s), long
    return size == 0 or same >= (cfg.copy_marked if marked and also else cfg.copy_unmarked) * size


def main_text(lines: list[tuple[str, bool, bool]], shared: list[np.ndarray], further: list[set[str]] | None = None, cfg: PagesConfig = PagesConfig()) -> str:
    """Body lines without what the given neighbours share: outside main text elements what any shares, inside them what
    all of them share and the pages ``further`` away hold too, at least two pages in all (a sentence that two articles
    happen to share is no furniture)."""
    body, _ = body_of(lines, cfg)
    further = further or []
    some = np.any(shared, axis=0) if shared else np.zeros(len(lines), dtype=bool)
    each = np.all(shared, axis=0) if len(shared) + len(further) > 1 and shared else np.zeros(len(lines), dtype=bool)
    gone = [e and all(t in x for x in further) if main else o for (t, _, main), o, e in zip(lines, some, each, strict=True)]
    return "\n".join(t for (t, _, _), keep, x in zip(lines, body, gone, strict=True) if keep and not x)


def _key(host: str, path: str, page) -> tuple:
    return host, path, page is not None, page if page is not None else 0


@dataclass(frozen=True)
class Blocks:
    """The order of pages cut into blocks: the keys at which blocks begin but for the first, and for each of these where
    the halo of the block that begins there starts (before it), and where that of the block before ends (None: the last page)."""

    starts: list[tuple]
    lows: list[tuple]
    highs: list[tuple | None]

    def of(self, key: tuple) -> list[tuple[int, int]]:
        """The blocks that a page belongs to: 0 where it is in the halo, in its own block 1, 2 more if it is in the halo of
        the next block as well, 4 more for the block before."""
        at = bisect_right(self.starts, key)
        after = at < len(self.starts) and key >= self.lows[at]
        before = at > 0 and (self.highs[at - 1] is None or key <= self.highs[at - 1])
        return [(at, 1 + 2 * after + 4 * before)] + [(at + 1, 0)] * after + [(at - 1, 0)] * before


def block_bounds(keys: DataFrame, cfg: PagesConfig) -> Blocks:
    """Blocks of about cfg.block pages of the order of keys(host, path, page_id).

    Only keys are sorted. They are written once, so that the ranges are the same for all readers; their ids number the
    rows of a range in their order. At most 3 * cfg.most_blocks keys come to the driver.
    """
    order = ["host", "path", "page_id"]
    ranged = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg((F.max("at") - F.shiftleft(F.min(part), 33) + 1).alias("size"))
    # One row a range: never more than the shuffle has partitions.
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", (F.coalesce(before, F.lit(0)) - F.shiftleft("part", 33)).alias("start"))
    block, reach = max(cfg.block, 2 * cfg.reach, -(-ranged.count() // cfg.most_blocks)), cfg.reach
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("at") + F.col("start"))
    wanted = placed.where((F.col("place") >= block - reach) & (F.col("place") % block).isin(0, block - reach, reach - 1))
    found = {r["place"]: _key(r["host"], r["path"], r["page_id"]) for r in wanted.select(*order, "place").collect()}
    drop(ranged)
    # A block begins where the page before it has a smaller key; repeated pages stay together.
    at = sorted(p for p in found if p % block == 0 and found[p - reach] < found[p])
    return Blocks([found[p] for p in at], [found[p - reach] for p in at], [found.get(p + reach - 1) for p in at])


def _parsed(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [lines_of(x) for x in batch.column(4).to_pylist()]
            keys = zip(*(batch.column(i).to_pylist() for i in (2, 3, 0)), strict=True)
            where = [(i, *x) for i, k in enumerate(keys) for x in shared.value.of(_key(*k))]
            rows = pa.array([i for i, _, _ in where], pa.int64())
            made = [
                *(batch.column(i) for i in range(4)), pa.array([[x[0] for x in page] for page in lines], pa.list_(pa.string())),
                pa.array([bytes(x[1] + 2 * x[2] for x in page) for page in lines], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(x.take(rows) for x in made), pa.array([b for _, b, _ in where], pa.int32()), pa.array([own for _, _, own in where], pa.int32())],
                names=["page_id", "url", "host", "path", "lines", "marks", "block", "own"],
            )

    return run


@dataclass
class _Page:
    page: object
    url: str | None
    lines: list[tuple[str, bool, bool]]
    texts: list[str]
    own: int
    #: Lines aligned with the page before and with the one after.
    before: np.ndarray | None = None
    after: np.ndarray | None = None


class _Row:
    """A row of near copies in a block: its own pages, the last ones of the two rows before (nearest first), and the first
    ones of the two rows after. Beyond some pages, those that wait are kept in a file."""

    def __init__(self, before: list[list[str]], keep: int):
        self.before, self.after, self.keep = before, [], keep
        self.pages: list[_Page] = []
        self.file = None

    def add(self, page: _Page) -> None:
        if len(self.pages) < self.keep:
            self.pages.append(page)
            return
        if self.file is None:
            self.file = tempfile.SpooledTemporaryFile(max_size=1 << 24)
        pickle.dump(page, self.file)

    def texts(self, cfg: PagesConfig) -> Iterator[tuple]:
        """(page_id, url, text) of the pages."""
        further = [set(side[1]) for side in (self.before, self.after) if len(side) > 1]
        for page in self._all():
            shared = [
                shared_lines(page.texts, side[0]) if known is None else known
                for side, known in ((self.before, page.before), (self.after, page.after)) if side
            ]
            yield page.page, page.url, main_text(page.lines, shared, further, cfg)

    def _all(self) -> Iterator[_Page]:
        yield from self.pages
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)
            self.file.close()


def _in_order(batches: Iterable[pa.RecordBatch], cfg: PagesConfig) -> Iterator[tuple]:
    """(block, host, page, page before it on its host, whether a row of near copies begins with it, far) of the rows in
    order; without host and page for the first row of a block, which brings what lies far."""
    last, key = None, None
    for batch in batches:
        for page, url, host, texts, flags, block, own, far in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if host is None:
                yield block, None, None, None, False, sorted(far or [], key=lambda x: x["rank"])
                continue
            if (block, host) != key:
                last, key = None, (block, host)
            new, begins = _Page(page, url, [(t, bool(f & 1), f > 1) for t, f in zip(texts, flags, strict=True)], texts, own), True
            if last is not None:
                before, after = shared_lines(texts, last.texts), shared_lines(last.texts, texts)
                begins = not near_copies(new.lines, last.lines, before, after, cfg)
                if begins:
                    new.before, last.after = before, after
            yield block, host, new, last, begins, None
            last = new


def _differenced(cfg: PagesConfig):
    """Of pages in order, block by block with the halo of each: the text of those that are the block's own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        def results() -> Iterator[tuple]:
            rows: list[_Row] = []  # of one block and host: those that wait for rows after them
            key, far = None, []

            def ended(final: bool) -> Iterator[tuple]:
                """What is left at the end of a host; at the end of a block, rows after it may lie far."""
                ahead = [x["texts"] for x in far if final and key and x["side"] == 1 and x["host"] == key[1]]
                for row in rows:
                    row.after = (row.after + ahead)[:2]
                    yield from row.texts(cfg)
                rows.clear()

            for block, host, page, last, begins, brought in _in_order(typed(), cfg):
                if page is None:
                    yield from ended(True)
                    key, far = None, brought
                    continue
                if (block, host) != key:
                    yield from ended(False)
                    # Only the first host of a block can have rows before it that lie far.
                    behind = [x["texts"] for x in far if key is None and x["side"] == 0 and x["host"] == host]
                    key = (block, host)
                    rows.append(_Row(behind, cfg.reach))
                elif begins:
                    for row in rows:
                        row.after.append(page.texts)
                    rows.append(_Row([last.texts, *rows[-1].before[:1]], cfg.reach))
                    while len(rows[0].after) == 2:
                        yield from rows.pop(0).texts(cfg)
                if page.own:
                    rows[-1].add(page)
            yield from ended(True)

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        ready: list[tuple] = []
        for row in results():
            ready.append(row)
            if len(ready) == 64:
                yield emit(ready)
                ready = []
        yield emit(ready)

    return run


def _edges(cfg: PagesConfig):
    """Of pages in order, block by block: whether the block needs rows before its halo or after it (side 0 and 1; some page
    of its own has fewer than two there), and what others may need of it, the last pages of its last two rows (side 0) and
    the first ones of its first two (side 1), once of all rows and once of those that no halo beside it holds. Block and
    place are negative on side 1, so that on both sides what comes first in order lies ahead."""

    def of_block(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        first = left = own = None  # hosts: of the first page, of the first own one if it goes on from before, of the last own one
        breaks = ahead = place = 0
        goes_on, now, lasts, firsts = False, None, [], []
        for _, now, page, last, begins, _ in rows:
            place += 1
            broke = begins and last is not None
            first = now if place == 1 else first
            breaks += broke and now == first
            if page.own:
                if own is None:
                    left = now if last is not None else None
                    if block and now == first and breaks < 2:
                        yield now, 0, True, block, 0, False, None
                if last is None:
                    lasts = []
                own = now
                if broke and now == left:
                    firsts.append((place, page.texts, bool(page.own & 4)))
            elif own is not None and now == own:
                goes_on = True
                ahead += broke
            if broke and last.own:
                lasts.append((place - 1, last.texts, bool(last.own & 2)))
                lasts = _nearest(lasts[::-1])[::-1]
            firsts = _nearest(firsts)
        if goes_on:
            if now == own and ahead < 2:
                yield own, 1, True, -block, 0, False, None
            for at, texts, inside in lasts:
                yield own, 0, False, block, at, inside, texts
        for at, texts, inside in firsts:
            yield left, 1, False, -block, -at, inside, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_in_order(batches, cfg), key=lambda x: x[0]):
            found = list(of_block(block, (x for x in rows if x[2] is not None)))
            if found:
                types = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=["host", "side", "need", "block", "place", "inside", "texts"])

    return run


def _nearest(found: list[tuple]) -> list[tuple]:
    """The first two, and the first two that aren't inside a halo."""
    outside = [x for x in found if not x[2]][:2]
    return [x for i, x in enumerate(found) if i < 2 or any(x is y for y in outside)]


def _far(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges by host, side, block (needs first) and place: (block, side, rank, host, texts), the nearest two that lie
    before the reach of each block in need."""
    key, kept = None, []
    for batch in batches:
        out = []
        for host, side, need, block, _, inside, texts in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (host, side) != key:
                key, kept = (host, side), []
            if need:
                near = [x[2] for x in kept if not (x[1] and x[0] == block - 1)][-2:]
                out += [(abs(block), side, rank, host, x) for rank, x in enumerate(reversed(near))]
                continue
            if kept and kept[-1][0] != block:
                del kept[:-2]
            kept.append((block, inside, texts))
        if out:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["at", "side", "rank", "host", "texts"])


def extract_pages(pages: DataFrame, cfg: PagesConfig = PagesConfig()) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each page.

    Pages are parsed to lines and ordered by (host, path, page_id). A page is compared with the nearest page before and
    the nearest after it on its host, however far, that aren't near copies of it: copies of an article would else lose it.
    (A row of near copies is one in which each is a near copy of the page before it.) Lines aligned
    with either neighbour by the longest common subsequence are deleted; in the elements that mark main text (<article>,
    <main>) those aligned with each, if the next nearest on either side hold them too. What markup names as furniture
    goes as well, as adverts and the like are mostly different on every page and differencing alone leaves them.

    The order is cut into blocks of cfg.block pages, each with a halo of cfg.reach pages on either side, so a host with a
    third of all pages spans many tasks, and the result doesn't depend on how rows are dealt to partitions. Where a row of
    near copies fills a halo, the block gets the pages beyond it from the edges of other blocks. The blocks' bounds are
    found on the keys alone; the pages are parsed and shuffled once, and compared with those beside them twice (for the
    edges and for the texts).

    Null html is empty and gives empty text; a null url is the host and path of an empty one; repeated pages are
    neighbours of each other; pages with nothing but shared lines and furniture are empty; an empty table gives no rows;
    other columns are not read.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    place = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    keyed = pages.select(
        "page_id", "url", F.lower(F.substring_index(place, "/", 1)).alias("host"), F.regexp_replace(place, "/+$", "").alias("path"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    bounds = block_bounds(keyed.select("host", "path", "page_id"), cfg)
    shared = pages.sparkSession.sparkContext.broadcast(bounds)
    columns = f"page_id {kind}, url string, host string, path string, lines array<string>, marks binary, block int, own int"
    parsed = keyed.mapInArrow(_parsed(shared), columns)
    # A row without host begins each block (nulls come first).
    begin = pages.sparkSession.range(0, len(bounds.starts) + 1, 1, 1).selectExpr(
        f"cast(null as {kind}) page_id", "cast(null as string) url", "cast(null as string) host", "cast(null as string) path",
        "cast(null as array<string>) lines", "cast(null as binary) marks", "cast(id as int) block", "0 own",
    )
    dealt, order = parsed.unionByName(begin).repartition("block"), ["block", "host", "path", "page_id", F.xxhash64("lines", "marks")]
    read = ["page_id", "url", "host", "lines", "marks", "block", "own"]
    edges = dealt.sortWithinPartitions(*order).select(*read, F.lit(None).cast("array<string>")).mapInArrow(
        _edges(cfg), "host string, side int, need boolean, block int, place int, inside boolean, texts array<string>"
    )
    far = (
        edges.repartition("host", "side").sortWithinPartitions("host", "side", "block", F.desc("need"), "place")
        .mapInArrow(_far, "at int, side int, rank int, host string, texts array<string>")
        .groupBy("at").agg(F.collect_list(F.struct("side", "rank", "host", "texts")).alias("far"))
    )
    # Sorted after the join, which promises no order. Its hint keeps the many pages where they are.
    met = dealt.join(far.hint("shuffle_hash"), (F.col("block") == F.col("at")) & F.col("host").isNull(), "left")
    return met.sortWithinPartitions(*order).select(*read, "far").mapInArrow(
        _differenced(cfg), f"page_id {kind}, url string, text string, n_chars long"
    )
