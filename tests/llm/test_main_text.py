import math
import time

import pytest

from foliary.llm import main_text

LONG = "One two three four five six seven eight nine ten, eleven twelve and so on until the end."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; somebody &middot; 2026</footer>"


@pytest.mark.parametrize(
    "body, expected",
    [
        (f"{MENU}<article><h1>Title</h1><p>{LONG}</p><p>A &amp;amp; B&nbsp;&eacute;</p></article>{FOOT}",
         ["Title", LONG, "A &amp; B é"]),
        (f'{MENU}<div class="ad">Buy {LONG}</div><div id="main"><p>{LONG}</p><p>Short.</p></div>', [LONG, "Short."]),
        (f"<article><p><b>Bold start<br><p>{LONG}\n\n  next</p></article>{FOOT}", ["Bold start", LONG + " next"]),
        (f'<div><p>{LONG}</p><script>if (a < b) "</p>"</script><p>x <i>y</i>z</p></div><aside>{LONG}</aside>',
         [LONG, "x yz"]),
        (f'<article><section><p>{LONG}</p></section><section><p>{LONG}</p></section></article>'
         f'<section class="comments"><p>{LONG}</p></section><form><p>{LONG}</p></form>', [LONG, LONG]),
        (f'<div class="cookie-notice"><p>{LONG}</p></div><main><article><h2>H</h2><ul><li>one<li>two</ul><p>{LONG}'
         f'<table><tr><td>a<td>b</table></article></main>', ["H", "one", "two", LONG, "a", "b"]),
        (f"<div><a href=/1>{LONG}</a><a href=/2>{LONG}</a></div><div><p>{LONG}</p><p>{LONG} End.</p></div>",
         [LONG, LONG + " End."]),
        ("<article><h1>Only</h1></article>", ["Only"]),
        ("just text", ["just text"]),
        ("", []),
    ],
)
def test_pages(body, expected):
    assert main_text.main_text(page(body)).split("\n") == (expected or [""])


def paragraphs(count, size):
    return "".join(f"<p>{'w' * size}</p>" for _ in range(count))


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div>", "</div>"), ("", "")])
def test_sections_of_unequal_density_stay_together(open_, close):
    body = f"{open_}<h1>Title</h1><section>{paragraphs(20, 200)}</section><section>{paragraphs(5, 700)}</section>{close}"
    got = main_text.main_text(page(MENU + body + FOOT)).split("\n")
    assert [len(x) for x in got] == [5] + [200] * 20 + [700] * 5


def test_a_long_list_stays_in_its_article():
    items = "".join(f"<li>item {i} of the list</li>" for i in range(100))
    got = main_text.main_text(page(f"{MENU}<article><div>{paragraphs(3, 900)}</div><ul>{items}</ul></article>{FOOT}"))
    assert got.count("\n") == 102
    nested = f"<article><h2>T</h2><p>{LONG}</p><article>{paragraphs(2, 900)}</article></article>"
    assert main_text.main_text(page(nested)).startswith("T\n" + LONG)


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<!-- open", "<script>never closed", "&#xffffffff;", "<a <b>", "\x00"])
def test_broken_pages_do_not_fail(html):
    assert isinstance(main_text.main_text(html), str)


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text.main_text(page(deep)) == LONG
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(3000))
    assert main_text.main_text(page(f"<article>{many}</article>")).count("\n") == 2999


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "t"), (2, None, None, "t"), (3, "", "", "t")]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, main_text.report(pages).collect()))
    assert got == sorted([(1, "u", LONG, len(LONG)), (2, None, "", 0), (3, "", "", 0)] * 2, key=lambda r: r[0])
    assert main_text.report(pages.limit(0)).count() == 0
    assert main_text.extract(pages, "html", "text").columns == ["page_id", "url", "html", "text"]


@pytest.mark.parametrize(
    "name", ["content has-sidebar", "post side-by-side", "ad-hoc", "no-comments", "article with_nav", "entry is-widget show-share"]
)
def test_names_that_only_tell_of_noise(name):
    body = f'<div class="{name}"><p>{LONG}</p><p class="{name}">{LONG}</p></div>'
    assert main_text.main_text(page(MENU + body + FOOT)).split("\n") == [LONG, LONG]
    assert main_text.names_noise("post sidebar") and main_text.names_noise("main-nav") and main_text.names_noise("cookie_notice")


def test_an_element_with_nearly_all_text_is_kept():
    body = f'<div class="notice">{paragraphs(20, 200)}<div class="ads">buy</div></div><p>Short.</p>'
    got = main_text.main_text(page(MENU + body + FOOT)).split("\n")
    assert got.count("w" * 200) == 20 and "buy" not in got
    beside = f'<article>{paragraphs(4, 200)}</article><div class="related">{paragraphs(6, 200)}</div>'
    assert main_text.main_text(page(beside)).count("w" * 200) == 4


def density(node):
    """Characters, tags, and those of links, counted anew for every node."""
    def count(n, linked):
        linked = linked or n.name == "a"
        chars = links = tags = link_tags = 0
        for part in n.parts:
            if isinstance(part, str):
                size = len(" ".join(part.split())) if part.split() else 0
                chars, links = chars + size, links + size * linked
            else:
                c, lc, t, lt = count(part, linked)
                chars, links, tags, link_tags = chars + c, links + lc, tags + t + 1, link_tags + lt + (part.name == "a")
        return chars, links, tags, link_tags

    return count(node, False)


def test_densities_by_a_plain_count():
    body = f'<div><p>{LONG}<a href=x>four</a></p><p>{LONG}</p><ul><li><a>one</a><li><a>two <b>x</b></a></ul></div>'
    root = main_text.parse(page(MENU + body))
    nodes = main_text.measure(root)
    all_chars, all_links, _, _ = density(root)
    for node in nodes:
        chars, links, tags, link_tags = density(node)
        assert (node.chars, node.tags, node.link_chars) == (chars, tags, links)
        if chars:
            base = math.log(chars / max(chars - links, 1) * links + all_links / all_chars * chars + math.e)
            ratio = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
            expected = chars / max(tags, 1) * min(1.0, math.log(max(ratio, 1.0) + 1e-9) / math.log(base + 1))
            assert math.isclose(node.density, expected)
    plain, linked = (main_text.measure(main_text.parse(f"<div>{'x' * 395}{end}</div>"))[1].density for end in ("xxxxx", "<a>xxxx</a>"))
    assert linked <= plain


@pytest.mark.parametrize(
    "html",
    ["<b>" * 100_000 + LONG, "<div>" * 50_000 + LONG, "<a" + "x" * 100_000, "<a " + "b " * 50_000, "<a \"" * 20_000, "<" * 100_000,
     "<b><p>" * 30_000 + LONG, "<li>" * 50_000, "<p" * 50_000 + ">"],
)
def test_broken_markup_takes_time_in_proportion(html):
    began = time.perf_counter()
    main_text.main_text(html)
    assert time.perf_counter() - began < 6
