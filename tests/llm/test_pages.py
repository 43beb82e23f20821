"""Pages in layout wrappers, and near copies on pages without marks."""

import os
from collections import defaultdict

import pytest
import xxhash

from driftwatch.llm import pages


@pytest.mark.parametrize(
    "start,end",
    [
        ("<div class='content-sidebar-wrap'><main>", "</main></div>"),
        ("<div id='page' class='has-sidebar'><article>", "</article></div>"),
        ("<div class='no-sidebar'><article>", "</article></div>"),
        ("<div class='menu-open'><article>", "</article></div>"),
        ("<div class='modal-page'><article>", "</article></div>"),
        ("<form action=/x><div><article>", "</article></div></form>"),
        ("<div class='main-menu'><article>", "</article></div>"),
        ("<div class='menu-open'>", "</div>"),
    ],
)
def test_wrappers_keep_the_article(start, end):
    inside = "<p>One</p><p class='related-work'>Two</p><p class='notice-period'>Three</p><div class='ad-slot'>Buy</div><div class='cookie-notice'>We</div>"
    html = f"<body><nav>Menu</nav>{start}{inside}{end}<div id=comments><article>First!</article></div></body>"
    assert pages.main_text(pages.blocks(html)) == "One Two Three"


def test_an_article_in_a_sidebar_gives_way():
    html = "<div class='sidebar'><article>Teaser</article></div><article>Body</article>"
    assert pages.main_text(pages.blocks(html)) == "Body"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='elementor-widget elementor-widget-text'><p>Real text.</div>", "Real text."),
        ("<div class='layout has-sidebar'><article><p>Body</p></article></div>", "Body"),
        ("<article><p id='notice-period'>One</p><p class='social-history'>Two</p></article>", "One Two"),
        ("<article>Let <math><mi>x</mi></math> be small, <svg><text>as drawn</text></svg></article>", "Let x be small, as drawn"),
        ("<article>Teaser</article><div><p>The long body of the story follows here.</p></div>", "Teaser The long body of the story follows here."),
        ("<article>The long body of the story follows here.</article><div>3 March</div>", "The long body of the story follows here."),
    ],
)
def test_marks_keep_what_they_should(html, want):
    assert pages.main_text(pages.blocks(html)) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<form id=f><div>Title of it</div><p>The body of a page that a server made.</p><input><div class=share>Share</div></form>", "Title of it The body of a page that a server made."),
        ("<div class='with sidebar'><p>The whole body is in here, all of it.</p><div class='sidebar'>Links</div></div>", "The whole body is in here, all of it."),
        ("<form><div class='sidebar'><p>The whole body is in here, all of it.</p><nav>Menu</nav></div></form>", "The whole body is in here, all of it."),
        ("<p>The text is outside.</p><form>Name and address, please, and a lot more about yourself</form>", "The text is outside."),
        ("<article>Short.</article><form>A long form with many, many questions that nobody wants to answer at all, ever</form>", "Short."),
    ],
)
def test_wrappers_of_whole_pages_are_no_furniture(html, want):
    assert pages.main_text(pages.blocks(html)) == want


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    for make in (lambda n: "<div>" * n + "x", lambda n: "<b" + "a" * n, lambda n: "<a " * n, lambda n: "<p>x" * n):
        began = time.perf_counter()
        pages.blocks(make(40_000))
        assert time.perf_counter() - began < 2


def story(i, n=12):
    return "".join(f"<p>Sentence {j} of story number {i} of the day.</p>" for j in range(n))


def site(body, date=""):
    return f"<div>Site name and a very long motto that is furniture on each page of it</div><p>{date}</p>{body}<div>All about us</div>"


def kept(lines, shared=()):
    """The text of split lines without those at the places ``shared``, but for the page's own."""
    left = [(line, kind) for i, (line, kind) in enumerate(lines) if kind == "own" or not kind and i not in shared]
    own = [line for line, kind in left if kind]
    return " ".join(own if 2 * sum(map(len, own)) > sum(len(line) for line, _ in left) else [line for line, _ in left])


def aligned(a, b):
    """Places in ``a`` of a longest common subsequence, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def brute(rows):
    """The texts by a plain walk over all pages of a host; of the operator it takes the splitter alone."""
    out, hosts = {}, defaultdict(list)
    for i, url, html in rows:
        host, _, path = (url or "").removeprefix("http://").partition("/")
        lines = pages.blocks(html or "")
        out[i] = kept(lines)
        hosts[host].append(("/" + path if url else "", i, lines))
    for own in hosts.values():
        own = sorted((x for x in own if x[2]), key=lambda x: x[:2])
        texts = {i: [line for line, _ in lines] for _, i, lines in own}
        story = {i: max(texts[i], key=lambda x: (len(x), xxhash.xxh64_intdigest(x) >> 11)) for i in texts}
        of = defaultdict(set)
        for i, lines in texts.items():
            for line in lines:
                of[line].add(story[i])
        common = {line for line, stories in of.items() if len(stories) >= 3 and 2 * len(stories) > len({*story.values()})}

        def one_body(a, b):
            x, y = ({*texts[p[1]]} - common for p in (a, b))
            size = lambda s: sum(map(len, s))
            return texts[a[1]] == texts[b[1]] or x == y or 4 * (max(size(x), size(y)) - size(x & y)) < size(x & y)

        runs = []
        for page in own:
            if runs and one_body(runs[-1][-1], page):
                runs[-1].append(page)
            else:
                runs.append([page])
        for k, run in enumerate(runs):
            near = [runs[k - 1][-1]] * (k > 0) + [x[0] for x in runs[k + 1 : k + 2]]
            for path, i, lines in run:
                if near:
                    best = max(near, key=lambda x: len(os.path.commonprefix([x[0], path])))
                    shared = aligned(texts[i], texts[best[1]])
                    out[i] = kept(lines, {x for x in shared if texts[i][x] in common} if len(shared) == len(lines) else shared)
    return out


def extracted(frame, rows):
    return {r["page_id"]: r["text"] for r in pages.extract(frame(rows, "page_id long, url string, html string")).collect()}


def words(html):
    return " ".join(html.replace("<p>", " ").replace("</p>", " ").split())


@pytest.mark.parametrize("copies,others", [(2, 0), (3, 0), (6, 0), (4, 3), (3, 1), (30, 2)])
def test_near_copies_keep_their_article_however_many(frame, copies, others):
    for date in (lambda i: f"Day {i} of the year", lambda i: "One day"):  # near and exact copies
        rows = [(i, f"http://h.org/{i:02}", site(story(99), date(i))) for i in range(copies)]
        rows += [(100 + i, f"http://h.org/{i:02}x", site(story(f"x{i}"), date(i))) for i in range(others)]
        got = extracted(frame, rows)
        assert got == brute(rows)
        for i in range(copies):
            assert words(story(99)) in got[i]
        for i in range(others):
            assert words(story(f"x{i}")) in got[100 + i]


def test_differencing_decides_whatever_the_partitions(spark, frame):
    rows = [(i, f"http://h.org/a/{i // 4:02}", site(story(i // 4))) for i in range(40)]  # copies in fours
    rows += [(100 + i, f"http://h.org/near/{i:02}", site(story(99), f"Day {i}")) for i in range(30)]  # near copies
    rows += [(200 + i, f"http://g.org/{i}", site(story(f"g{i}", 1))) for i in range(20)]  # furniture is most of a page
    rows += [(300 + i, f"http://m.org/{i}", f"<nav>Menu</nav><article>{story(i % 3)}</article><div class='ad'>Ad {i}</div><footer>us</footer>") for i in range(9)]
    rows += [(400, None, None), (401, "http://h.org/a/05", ""), (402, "http://one.org/", site("Alone")), (403, None, site("Odd"))]
    want = brute(rows)
    assert [want[i] for i in (0, 3, 39)] == [words(story(0)), words(story(0)), words(story(9))]
    assert want[107] == words("<p>Day 7</p>" + story(99)) and want[205] == words(story("g5", 1)) and want[302] == words(story(2))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 6, 30):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert extracted(frame, rows) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
