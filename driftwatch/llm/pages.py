"""HTML extraction by nearest-URL page differencing.

Pages of one host, sorted by the path of their URL and their id, are paired with the neighbour of the longest common path.
Copies and near copies that follow each other are a run, and a page's neighbours are the pages before and behind its
run. The text lines (blocks) of a pair are aligned by a longest common subsequence, and the lines that both have are
deleted: they are the host's furniture. A page without a neighbour loses nothing. If its neighbour has
all of its lines, it loses those that are common on the host.

Two pages are copies if what they share is over four times as long as what either has besides; lines
that are common on the host don't count there, so long furniture makes no copies: those on pages of three stories or more, and of over half of the host's. A page's story
is its longest line, so that a text's copies and near copies are one story, however many they are.

Marks correct what differencing can't tell: adverts and remarks differ from page to page, and so do
copies' neighbours that hold the same passage. Lines in menus, headers, footers, asides, forms, scripts and elements whose
class, id or role says so are never text; what says so is a whole name or its last
word. Lines inside of ``article`` or ``main`` are the page's own, shared or not; if they are over half of what is left,
lines outside of them go. An article or ``main`` that lies in a marked wrapper or in a form is the page's own if
it has no other. An element that holds nearly the whole page isn't beside its text, whatever its marks say.

Only hashes of lines are sorted by range and aligned, so a host of any size spreads over tasks. Runs that reach
a task's edge are decided after it, when the pages at all edges (four of a task at most, hashes only) are known: results don't
depend on the number of tasks.

A null ``html`` has the empty text; a null ``url`` belongs to the host of empty
name. Pages without lines are nobody's neighbour. Repeated pages are copies. Extra columns are ignored; an empty table gives no
rows. White space is what ``str.isspace`` says.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.session import materialize

RAW = "script|style|noscript|template|textarea|iframe|select|button"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|</?[a-z!?][^>]*(?:>|\Z)"
    rf"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
INLINE = {*"a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub mfrac msqrt semantics svg text tspan object canvas".split()}
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
#: Elements that end when another of their kind begins.
AUTO = {*"p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split()}
OWN = {"article", "main"}
CHROME = {*"head title nav footer aside form menu dialog".split()}
#: Words in a class, id or role that mark what is never text, and those that do so outside of an article only.
NEVER = {*(
    "ad ads advert adverts advertisement advertisements sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices"
    " popup modal newsletter subscribe sidebar menu nav navigation navbar breadcrumb breadcrumbs footer comment comments disqus reply replies share"
    " sharing social related login signup search pagination pager skip toolbar alert toast overlay adslot adbox adsense adsbygoogle promoted"
).split()}
#: Of these the ones that hold other people's articles: an ``article`` inside is never the page's own.
FOREIGN = {*(
    "ad ads advert adverts advertisement advertisements sponsor sponsored sponsors promo promotion promoted adslot adbox adsense adsbygoogle"
    " comment comments disqus reply replies related"
).split()}
#: Last words of a name that say nothing by themselves, and first words of names that describe a layout.
TAIL = {*"slot box bar list link links block unit icons button buttons form item".split()}
LAYOUT = {*"has no with without is not hide".split()}
#: Whole class names of an ``article`` that is a remark or an advert, not the page's own.
REMARK = {"comment", "comments", "reply", "ad", "advert"}
OUTSIDE = {"header", "masthead", "contentinfo", "complementary"}


def _words(rest: str) -> set[str]:
    """The last telling word of each class, id and role."""
    out = set()
    for found in MARK.findall(rest):
        for name in "".join(found).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            while len(words) > 1 and words[-1] in TAIL:
                words.pop()
            if words and not (len(words) > 1 and words[0] in LAYOUT):
                out.add(words[-1])
    return out


def _kind(name: str, rest: str, inside: bool) -> str:
    """``own``, ``chrome``, ``soft`` (chrome that may hold the page's article) or nothing, as an element's name and marks say."""
    if name in OWN:
        names = {w for found in MARK.findall(rest) for w in "".join(found).lower().split()} if rest else set()
        return "chrome" if names & REMARK else "own"
    if name == "form":
        return "soft"
    if name in CHROME or name == "header" and not inside:
        return "chrome"
    words = _words(rest) if rest else ()
    if words and (words & NEVER or not inside and words & OUTSIDE) and name not in ("body", "html"):
        return "chrome" if words & FOREIGN else "soft"
    return ""


def _held(name: str, kind: str, around: str) -> str:
    """The kind of what an element holds, from its own and that of what encloses it."""
    if name == "main" and kind == "own":
        return "own"
    if around == "chrome" or kind == "chrome":
        return "chrome"
    if around == "soft":
        return "inner" if kind == "own" else "soft"
    if around == "inner":
        return "soft" if kind == "soft" else "inner"
    return kind or around


#: How much more text than all of the page besides an element holds that can't be beside the page's text.
WRAPPER = 10


def blocks(html: str) -> list[tuple[str, str]]:
    """The lines of a page in order with what encloses them: ``own``, ``chrome`` or nothing.

    A form or an element whose marks say that it is beside the text is taken for a plain wrapper if the page has no article and over ``WRAPPER`` times
    as much text in it as outside: then only what is marked inside it goes.
    """
    wrappers: set[int] = set()
    while True:
        lines = _lines(html, wrappers)
        inside: Counter[int] = Counter()
        for line, kind, element in lines:
            inside[element if kind == "soft" else -1] += len(line) if kind in ("", "soft") else 0
        outside = inside.pop(-1, 0)
        element, most = max(inside.items(), key=lambda x: x[1], default=(-1, 0))
        if most <= WRAPPER * (outside + sum(inside.values()) - most) or any(kind in ("own", "inner") for _, kind, _ in lines):
            break
        wrappers.add(element)
    inner = "chrome" if any(kind == "own" for _, kind, _ in lines) else "own"  # of two articles, the one in a sidebar isn't the page's
    return [(line, {"soft": "chrome", "inner": inner}.get(kind, kind)) for line, kind, _ in lines]


def _lines(html: str, wrappers: set[int]) -> list[tuple[str, str, int]]:
    """Lines with their kind and the outermost soft element around them, by its number among all such tags; those in ``wrappers`` aren't soft."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = []  # open elements that aren't inline, each with the kind of what it holds, and the soft element around
    open_: Counter[str] = Counter()  # how many of each name and kind are open
    parts: list[str] = []
    seen = 0

    def pop() -> str:
        for x in stack[-1][:2]:
            open_[x] -= 1
        return stack.pop()[0]

    def end() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append((line, *((stack[-1][1][1:], stack[-1][2]) if stack else ("", -1))))

    for token in TOKEN.finditer(html):
        name = (token["name"] or "").lower()
        if not name:
            if not token[0].startswith("<") or token[0] == "<":
                parts.append(entities.unescape(token[0]))
            continue
        kind = "" if token["close"] else _kind(name, token["rest"], open_["=own"] + open_["=inner"] > 0)
        if kind == "soft":
            seen += 1
            kind = "" if seen in wrappers else kind
        if name in INLINE and not kind and not open_[name]:
            continue
        if token["close"]:
            end()
            if open_[name]:
                while pop() != name:
                    pass
            continue
        end()
        if name in AUTO and stack and stack[-1][0] == name:
            pop()
        if name not in VOID and not token["rest"].endswith("/"):
            around, element = (stack[-1][1][1:], stack[-1][2]) if stack else ("", -1)
            element = seen if kind == "soft" and element < 0 else element
            stack.append((name, "=" + _held(name, kind, around), element))
            open_.update(stack[-1][:2])
    end()
    return out


def _last_row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, by whole-row bit operations."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        both = row & masks.get(x, 0)
        row = (row + both | row - both) & full
    out = [0]
    for bit in reversed(bin(row | 1 << len(b))[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence of both, in memory linear in their lengths."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in lines] for lines in (a, b))
    found: set[int] = set()
    open_ = [(0, len(x), 0, len(y))]
    while open_:
        i, k, j, m = open_.pop()
        while i < k and j < m and x[i] == y[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < k and j < m and x[k - 1] == y[m - 1]:
            k, m = k - 1, m - 1
            found.add(k)
        if i == k or j == m:
            continue
        if k - i == 1:
            found |= {i} if x[i] in y[j:m] else set()
            continue
        half = (i + k) // 2
        fore, back = _last_row(x[i:half], y[j:m]), _last_row(x[half:k][::-1], y[j:m][::-1])[::-1]
        cut = max(range(m - j + 1), key=lambda t: fore[t] + back[t])
        open_ += [(i, half, j, j + cut), (half, k, j + cut, m)]
    return found


def main_text(page: list[tuple[str, str]], shared: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of a page's blocks, of which the neighbour has those at the places ``shared``."""
    left = [(line, kind) for i, (line, kind) in enumerate(page) if kind == "own" or not kind and i not in shared]
    own = sum(len(line) for line, kind in left if kind)
    if 2 * own > sum(len(line) for line, _ in left):
        left = [(line, kind) for line, kind in left if kind]
    return " ".join(line for line, _ in left)


#: A line's code: its length up to the largest that fits, in the bits from here on, before a hash.
SIZE_AT, LONGEST = 53, (1 << 10) - 1


def line_codes(page: list[tuple[str, str]]) -> list[int]:
    """A number for each line of a page, equal for equal lines and larger for longer ones."""
    return [min(len(line), LONGEST) << SIZE_AT | xxhash.xxh64_intdigest(line) >> 64 - SIZE_AT for line, _ in page]


class Page(NamedTuple):
    """What the pairing knows of a page; ``rare`` are the lines that aren't common on its host."""

    key: int | None
    page_id: int | None
    host: str
    path: str
    lines: list[int]
    rare: list[bool]

    def body(self) -> set[int]:
        return {x for x, own in zip(self.lines, self.rare, strict=True) if own}


def copies(a: Page, b: Page) -> bool:
    """Whether two pages have one body."""
    if a.lines is b.lines or a.lines == b.lines:
        return True
    x, y = a.body(), b.body()
    one, two, both = (sum(code >> SIZE_AT for code in codes) for codes in (x, y, x & y))
    return x == y or 4 * (max(one, two) - both) < both


def _alike(a: str, b: str) -> int:
    """The length of the common beginning of two paths."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def decided(page: Page, before: Page | None, after: Page | None) -> tuple[int | None, list[int]]:
    """The id of the neighbour on the nearer path, and the places of the lines that it shares."""
    near = [x for x in (before, after) if x]
    if not near:
        return None, []
    best = max(near, key=lambda x: _alike(x.path, page.path))
    shared = common_lines(page.lines, best.lines)
    if len(shared) == len(page.lines):
        shared = {i for i in shared if not page.rare[i]}
    return best.page_id, sorted(shared)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null."""
    url = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(
        url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1
    )


PAGE = pa.struct([("key", pa.int64()), ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("rare", pa.list_(pa.bool_()))])
PAGE_DDL = "struct<key:long,page_id:long,host:string,path:string,lines:array<long>,rare:array<boolean>>"
#: ``page`` is there only for pages of a task's first and last run; ``edge`` says which of the four pages that others need it is.
PAIRED = f"part int, key long, id long, partner long, shared array<int>, edge string, at_first boolean, at_last boolean, page {PAGE_DDL}, before {PAGE_DDL}, after {PAGE_DDL}"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the pages of a task's sorted rows, but for those of its first and last run."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split(" ")[0] for x in ("part", "key", "id", "partner", "shared", "edge", "at_first", "at_last", "page", "before", "after")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.bool_(), PAGE, PAGE, PAGE]
    told = lambda x: x and x._asdict()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def edge(name: str, page: Page | None) -> tuple:
        return part, None, None, None, None, name, None, None, told(page), None, None

    def done(run: list[Page], before: Page | None, after: Page | None) -> list[tuple]:
        return [(part, x.key, x.page_id, *decided(x, before, after), None, None, None, None, None, None) for x in run]

    def waiting(run: list[Page], before: Page | None, after: Page | None, first: bool, last: bool) -> list[tuple]:
        return [(part, x.key, x.page_id, None, None, None, first, last, told(x), told(before), told(after)) for x in run]

    before, run, first_run = None, [], True  # the page of the same host before the run
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            new = Page(**row)
            if not new.lines:
                out += done([new], None, None)
                continue
            if not run:
                out.append(edge("first", new))
            elif run[-1].host == new.host and copies(run[-1], new):
                if new.lines == run[-1].lines:
                    new = new._replace(lines=run[-1].lines)  # copies are held once
            else:
                after = new if run[-1].host == new.host else None
                if first_run:
                    out += [edge("behind_first", after), *waiting(run, None, after, True, False)]
                else:
                    out += done(run, before, after)
                before, run, first_run = (run[-1] if after else None), [], False
            run.append(new)
        yield batch_of(out)
    if run:
        yield batch_of([edge("last", run[-1]), *([] if first_run else [edge("before_last", before)]), *waiting(run, before, None, first_run, True)])


def _guests(edges: list[dict]) -> dict[int, tuple[Page | None, Page | None]]:
    """By task, the page before its first run and the one behind its last, from the edges of all tasks."""
    by: dict[int, dict[str, Page | None]] = {}
    for row in edges:
        by.setdefault(row["part"], {})[row["edge"]] = row["page"] and Page(**row["page"])
    order = sorted(by)
    ahead: dict[int, Page | None] = {}
    behind: dict[int, Page | None] = {}
    for found, walk, far, near, beyond in ((ahead, order, "last", "first", "before_last"), (behind, order[::-1], "first", "last", "behind_first")):
        other = None
        for part in walk:
            now, page = by[part], None
            if other is not None and by[other][far].host == now[near].host:
                page = by[other][far]
                if copies(page, now[near]):  # one run reaches over the edge: the page is the one that the other task's run has there
                    page = by[other][beyond] if beyond in by[other] else found[other]
            found[part], other = page, part
    return {part: (ahead[part], behind[part]) for part in order}


def pair(rows: DataFrame) -> DataFrame:
    """``key``, ``id``, the neighbour's id ``partner`` and the places ``shared`` of every page ``(key, page_id, host, path, lines)``."""
    # a page counts by its longest line, so that all near copies of a text are one and its lines aren't common
    story = F.array_max("lines").alias("story")
    sizes = rows.where(F.size("lines") > 0).groupBy("host", story).count().groupBy("host").agg(F.count("*").alias("n"))
    lines = rows.select("host", story, F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line", "story").count().groupBy("host", "line").agg(F.count("*").alias("k"))
    # a host has twice as many such lines as a mean story of it has lines, at most
    common = lines.where("k >= 3").join(sizes, "host").where("2 * k > n").groupBy("host").agg(F.collect_list("line").alias("common"))
    common = materialize(common, "page-common")  # of its own, so that the join can split a hot host
    rare = F.transform("lines", lambda x: F.coalesce(~F.array_contains("common", x), F.lit(True)))
    order = ["host", "path", "page_id", "key"]
    marked = rows.join(common, "host", "left").select("key", "page_id", "host", "path", "lines", rare.alias("rare"))
    found = materialize(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_paired, PAIRED), "page-pairs")
    guests = _guests(found.where("edge IS NOT NULL").select("part", "edge", "page").toArrow().to_pylist())

    @F.arrow_udf("partner long, shared array<int>")
    def resolved(parts: pa.Array, firsts: pa.Array, lasts: pa.Array, pages: pa.Array, befores: pa.Array, afters: pa.Array) -> pa.Array:
        out = []
        for part, first, last, page, before, after in zip(*(x.to_pylist() for x in (parts, firsts, lasts, pages, befores, afters)), strict=True):
            ahead, behind = guests[part]
            before, after = (ahead if first else before and Page(**before)), (behind if last else after and Page(**after))
            out.append(decided(Page(**page), before, after))
        columns = zip(*out, strict=True) if out else [(), ()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.list_(pa.int32())), strict=True)], ["partner", "shared"])

    late = found.where("edge IS NULL AND page IS NOT NULL").withColumn("_r", resolved("part", "at_first", "at_last", "page", "before", "after"))
    names = ["key", "id", "partner", "shared"]
    return found.where("edge IS NULL AND page IS NULL").select(*names).unionByName(late.select("key", "id", "_r.partner", "_r.shared"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``partner`` (the neighbour's id), and ``n_lines``, ``n_shared``, ``n_restored`` and ``n_marked`` of every page.

    Of its lines, ``n_shared`` were deleted by the differencing, of which marks restored ``n_restored``; marks deleted ``n_marked`` that it had left.
    """
    host, path = url_parts(F.col(url))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    key = F.xxhash64("page_id", "url", "html").alias("key")

    @F.arrow_udf("array<long>")
    def coded(sources: pa.Array) -> pa.Array:
        return pa.array([line_codes(blocks(x or "")) for x in sources.to_pylist()], pa.list_(pa.int64()))

    rows = materialize(own.select(key, "page_id", host.alias("host"), path.alias("path"), coded("html").alias("lines")), "page-lines")
    pairs = pair(rows).groupBy("key", F.coalesce("id", F.lit(0)).alias("id")).agg(F.first("partner").alias("partner"), F.first("shared").alias("shared"))

    @F.arrow_udf("text string, n_lines long, n_shared long, n_restored long, n_marked long")
    def texts(sources: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for source, shared in zip(sources.to_pylist(), places.to_pylist(), strict=True):
            page, lost = blocks(source or ""), {*(shared or ())}
            restored = sum(page[i][1] == "own" for i in lost)
            marked = sum(kind == "chrome" and i not in lost for i, (_, kind) in enumerate(page))
            out.append((main_text(page, lost), len(page), len(lost), restored, marked))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text", "n_lines", "n_shared", "n_restored", "n_marked"])

    whole = own.withColumn("key", key).withColumn("id", F.coalesce("page_id", F.lit(0))).join(pairs.hint("merge"), ["key", "id"], "left")  # a row for each page: never sent to all tasks
    whole = whole.withColumn("_t", texts("html", "shared"))
    return whole.select("page_id", "url", "_t.text", F.length("_t.text").cast("long").alias("n_chars"), "partner", *[f"_t.{n}" for n in ("n_lines", "n_shared", "n_restored", "n_marked")])
