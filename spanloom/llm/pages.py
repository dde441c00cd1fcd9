"""Main text of web pages by nearest-URL differencing, checked by markup.

Pages of one host that are near each other by URL path share a template. Pages are sorted by host, path, id and digest;
each is paired with its nearest neighbour in that order (of the pages before and behind it the one with which it shares
the longer path prefix). Every page is parsed into text lines (one for each block element), the two lists of lines are
aligned by their longest common subsequence, and the shared lines are deleted.

Markup checks the alignment. Lines in furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments; told by element names, ARIA roles and words in class and id) go even where they vary from page to page. Where
a page has an article or main element, lines outside it go, and lines inside it that the alignment deleted come back:
articles quote each other, and even lines that both neighbours share are mostly an article's own (README has figures).
In pages without such an element, differencing decides alone on what is no furniture.

Plan: the sort keys of all pages (host, path, id, digest of the markup) are a narrow table in the shared folder, which is
range-partitioned, so that a host with a third of all pages is spread over many ranges. The driver gets the first and
the last two runs of copies of each range (at most RANGES ranges), which give the bounds of the ranges and, for the
pages at their edges, the neighbours in other ranges. Then every page is parsed once and its lines go to its range,
those of the few neighbours of an edge also to the range beside it. So the pairing is that of the whole sorted table,
however it is partitioned, and one shuffle carries parsed lines instead of markup.

Defined cases: null or empty html has the empty text; a null URL sorts first, as a host and path of its own; repeated
rows are extracted each, and copies of a page are not paired with each other (a copy shares every line); a very long page
is one row of a task; fallback content of svg, object, noscript, canvas, audio and video is no text; br ends a block;
other columns stay out of the result; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, save

#: Estimated bytes of markup in a range, and the most ranges, of which the driver holds the edges; beyond, they grow.
PART_BYTES = 16 << 20
RANGES = 20_000

#: Elements by their role in HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul caption option legend br".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg iframe object canvas audio video head title textarea select button".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar"
    r"|side|aside|widget\w*|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe"
    r"|signup|login|form|search|pagination|pager|toolbar|skip)(?:$|[-_\s\d])",
    re.I,
)
ADVERT_WORDS = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*)(?:$|[-_\s\d])", re.I)
#: Elements of running text: inside an article their classes only tell adverts.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote a abbr b cite code em i mark q s small span strong sub sup u".split())
COMMENT_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|respond|disqus|replies|reply)(?:$|[-_\s\d])", re.I)
CLOSES_P = BLOCK_TAGS - {"br"}
SPACE = re.compile(r"\s+")


class Blocks(HTMLParser):
    """Text blocks of a page as (text, kind): kind 0 furniture, 1 outside the article, 2 inside it.

    Furniture by element or role is sure; furniture by class or id is doubtful: an article inside it is an article
    all the same (a wrapper may be called `with-sidebar`).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, furniture (2 sure, 1 doubtful), article
        self.found: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.raw = self.sure = self.doubtful = self.article = 0
        self.outer = 0  # doubtful furniture around the outermost article

    def flush(self) -> None:
        if self.words:
            text = SPACE.sub(" ", "".join(self.words)).strip()
            if text:
                furniture = self.sure or self.doubtful > (self.outer if self.article else 0)
                self.found.append((text, 0 if furniture else 2 if self.article else 1))
            self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in CLOSES_P:
            self._close_open("p")
        if tag == "body":
            self.handle_endtag("head")
        if tag in VOID_TAGS:
            return
        if tag == "li":
            self._close_open("li", ("ul", "ol", "menu"))
        furniture, article = self._kind(tag, dict(attrs))
        if article and not self.article:
            self.outer = self.doubtful
        self.stack.append((tag, furniture, article))
        self.sure += furniture == 2
        self.doubtful += furniture == 1
        self.article += article
        self.raw += tag in RAW_TAGS

    def _kind(self, tag: str, given: dict) -> tuple[int, bool]:
        if tag in ("html", "body"):
            return 0, False
        names = f"{given.get('class') or ''} {given.get('id') or ''}"
        role = (given.get("role") or "").lower()
        if self.article and tag in TEXT_TAGS:
            return (2, False) if "hidden" in given or role in FURNITURE_ROLES else (int(bool(ADVERT_WORDS.search(names))), False)
        if COMMENT_WORDS.search(names):
            return 2, False
        if role in FURNITURE_ROLES or "hidden" in given or tag in FURNITURE_TAGS and not (tag == "header" and self.article):
            return 2, False
        if tag in ("article", "main") or role in ("main", "article") or given.get("itemprop") == "articleBody":
            return 0, True
        return int(bool(names != " " and FURNITURE_WORDS.search(names.replace("header", "") if tag == "header" else names))), False

    def _pop(self) -> None:
        tag, furniture, article = self.stack[-1]
        if tag in BLOCK_TAGS:
            self.flush()
        self.stack.pop()
        self.sure -= furniture == 2
        self.doubtful -= furniture == 1
        self.article -= article
        self.raw -= tag in RAW_TAGS

    def _close_open(self, tag: str, until: tuple[str, ...] = ()) -> None:
        """End an open element that the next one ends implicitly; formatting inside it ends with it."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if name in until or name in BLOCK_TAGS or name in RAW_TAGS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.words.append(data)


def page_blocks(html: str) -> list[tuple[str, int]]:
    """Blocks of a page in page order, with their kinds."""
    parser = Blocks()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # markup that the parser gives up on: the rest counts as text
        parser.words.append(unescape(re.sub(r"<[^>]*>", " ", parser.rawdata)))
    parser.flush()
    return parser.found


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a that a longest common subsequence with b takes.

    Common heads and tails are taken first; the rest is the classic table over the lines that both lists hold.
    """
    out: set[int] = set()
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        out.add(low)
        low += 1
    ea, eb = len(a), len(b)
    while ea > low and eb > low and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        out.add(ea)
    both = set(a[low:ea]) & set(b[low:eb])
    x = [i for i in range(low, ea) if a[i] in both]
    y = [b[j] for j in range(low, eb) if b[j] in both]
    if not x or not y:
        return out
    # Hunt and Szymanski: the longest increasing chain of matches, with links back.
    places: dict[str, list[int]] = {}
    for j, line in enumerate(y):
        places.setdefault(line, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i in x:
        for j in reversed(places[a[i]]):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k] = j
                ends[k] = link
    node = ends[-1]
    while node:
        out.add(node[0])
        node = node[1]
    return out


def host_of(url: Column) -> Column:
    """Host of a URL, without scheme, credentials and port; of a null URL the empty one."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.regexp_extract(_rest(url), r"^[^/]*", 0), r"(?s)^.*@", ""), r"^[^:]*", 0))


def path_of(url: Column) -> Column:
    """Path of a URL without query, fragment and slashes at its ends."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(_rest(url), r"^[^/]*", ""), r"^/+|/+$", ""))


def _rest(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", ""), r"^//", ""), r"^[^?#]*", 0)


def main_text(blocks: list[tuple[str, int]], shared: set[int]) -> str:
    """What differencing leaves of a page, after the check by markup."""
    if any(kind == 2 for _, kind in blocks):
        return "\n".join(text for text, kind in blocks if kind == 2)
    return "\n".join(text for i, (text, kind) in enumerate(blocks) if kind and i not in shared)


def _common(a: str, b: str) -> int:
    """Path segments that two paths share at their beginnings."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def settled(path: str, lines: list[str], kinds: list[int], sides: list[tuple[str, list[str]]]) -> tuple[str, int, int]:
    """(text, its code points, deleted lines) of a page, given path and lines of the pages beside it that are no copies."""
    sides = sorted((x for x in sides if x[1] != lines), key=lambda x: -_common(x[0], path))  # the first of equals is the one before
    shared = shared_lines(lines, sides[0][1]) if sides else set()
    text = main_text(list(zip(lines, kinds)), shared)
    return text, len(text), len(shared)


def _key(host: str, path: str, id_: int | None, digest: bytes) -> tuple:
    """As Spark sorts them: a null id goes first."""
    return host, path, id_ is not None, id_ or 0, digest


def ranges_of(edges: list) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each range, and for the keys of pages beside an edge the other ranges that need their lines.

    edges: (part, first two and last two runs) of each range; a run is (host, digest, first key, last key).
    """
    found = sorted(edges, key=lambda e: e[1][0][2])
    bounds, send = [e[1][0][2] for e in found], {}
    for at, (_, runs) in enumerate(found):
        for run, step, end in ((runs[0], -1, 3), (runs[-1], 1, 2)):
            k = at + step
            near = None
            while 0 <= k < len(found) and near is None:  # beyond copies of the run at the edge
                near = next((r for r in found[k][1][::step] if r[:2] != run[:2]), None)
                k += step
            if near and near[0] == run[0]:
                send.setdefault(near[end], []).append(at)
    return bounds, send


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", count: int | None = None) -> DataFrame:
    """(key, url, text, n_chars, n_shared) for each row; n_shared counts the lines that the alignment deleted."""
    import pyarrow as pa

    count = count or min(RANGES, parts(df, PART_BYTES))
    link, markup = F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string")
    digest = F.unhex(F.md5(F.coalesce(markup, F.lit("")).cast("binary")))
    base = df.select(F.col(f"`{key}`").cast("long").alias("id"), link.alias("url"), host_of(link).alias("host"), path_of(link).alias("path"), digest.alias("digest"), markup.alias("html"))
    order = ["host", "path", "id", "digest"]
    keys = save(base.select(*order), "keys")

    def edges(batches):
        """The runs at both ends of a range, as a row each."""
        runs: list[list] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = _key(*row)
                if runs and runs[-1][:2] == [row[0], row[3]]:
                    runs[-1][3] = at
                else:
                    runs.append([row[0], row[3], at, at])
                    if len(runs) > 4:
                        del runs[2]
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(runs)], pa.binary())], names=["runs"])

    sorted_keys = keys.repartitionByRange(count, *order).sortWithinPartitions(*order)
    found = [pickle.loads(r["runs"]) for r in sorted_keys.mapInArrow(edges, "runs binary").collect()]  # a row for each range
    told = df.sparkSession.sparkContext.broadcast(ranges_of([(k, [tuple(r) for r in runs]) for k, runs in enumerate(found)]))
    parsed = pa.schema([("range", pa.int32()), ("guest", pa.bool_()), ("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("digest", pa.binary()), ("lines", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])

    def parse(batches):
        bounds, send = told.value
        sent = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = []
                for id_, link, host, path, digest, markup in zip(*(c.to_pylist() for c in batch.slice(k, 1000).columns)):
                    at = _key(host, path, id_, digest)
                    blocks = page_blocks(markup or "")
                    row = (id_, link, host, path, digest, [t for t, _ in blocks], [kind for _, kind in blocks])
                    rows.append((max(0, bisect_right(bounds, at) - 1), False, *row))
                    if at in send and at not in sent:
                        sent.add(at)
                        rows += [(r, True, *row) for r in send[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), parsed)], schema=parsed)

    def differ(batches):
        """Copies that follow one another are one run, which is settled when the run behind it begins."""

        def done(before, run, behind):
            host, _, lines, kinds, members, _ = run
            made: dict = {}
            for id_, link, path in members:
                sides = [(side[k], side[2]) for side, k in ((before, 5), (behind, 1)) if side and side[0] == host]
                near = tuple(_common(p, path) for p, _ in sides)  # all that the text depends on besides the lines
                near = len(near) > 1 and near[1] > near[0]
                if near not in made:
                    made[near] = settled(path, lines, kinds, sides)
                yield id_, link, *made[near]

        before = run = now = mark = None
        for batch in batches:
            rows = []
            for range_, guest, id_, link, host, path, digest, lines, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or mark != (range_, host, digest):
                    after = [host, path, lines, kinds, [], path]
                    if run is not None:
                        rows += done(before, run, after if now == range_ else None)
                    before, run = (run if now == range_ else None), after
                    now, mark = range_, (range_, host, digest)
                run[5] = path
                if not guest:
                    run[4].append((id_, link, path))
            yield batch_of(rows)
        if run is not None:
            yield batch_of(list(done(before, run, None)))

    out = pa.schema([(key, pa.int64()), (url, pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int32())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, out)], schema=out)

    lines = base.select("id", "url", *[c for c in order if c != "id"], "html").mapInArrow(parse, "range int, guest boolean, id long, url string, host string, path string, digest binary, lines array<string>, kinds array<tinyint>")
    near = lines.repartition(count, "range").sortWithinPartitions("range", *order)
    return near.mapInArrow(differ, f"`{key}` long, `{url}` string, text string, n_chars long, n_shared int")


def op10_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 10: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
