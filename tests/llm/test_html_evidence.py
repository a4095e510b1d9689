"""Names as evidence, templates by share, and references that lack what most pages have."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from spanlake.llm import html_text  # noqa: E402


def page(body):
    return f'<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav>{body}<footer>all rights</footer></body></html>'


def read(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    return {r.page_id: r.text for r in html_text.main_text(rows).collect()}


def test_names_do_not_delete_whole_texts():
    assert html_text.extract(page('<div class="post-content side"><p>Body text here.</p></div>'), {}) == "Body text here."
    assert html_text.extract(page('<main><p>one two three four</p><div class="social-history"><p>five six</p></div></main>'), {}) == "one two three four\nfive six"
    assert html_text.extract(page('<div id="search-results-article"><p>a b c d</p></div><p>x</p>'), {}) == "a b c d\nx"
    # All there is has such a name: most words, or nothing else.
    assert html_text.extract(page('<div class="sidebar"><p>the only text of this page</p></div>'), {}) == "the only text of this page"
    assert html_text.extract(page('<div class="widget"><p>one half</p></div><div class="widget"><p>other half</p></div>'), {}) == "one half\nother half"


@pytest.mark.parametrize("name", ["share-box", "ad", "adSlot", "site-header", "cookie-notice", "sidebar left", "related_posts", "comment-list", "newsletter-signup", "search-form", "ad-unit-3"])
def test_names_of_boilerplate(name):
    assert html_text.extract(page(f'<article><p>a b c d e f g</p><div class="{name}">not this</div></article>'), {}) == "a b c d e f g"


def body(k, footer="Call us today", box=True):
    inner = f'<div class="inner"><div>Story {k} of many words.</div><div>End of {k}.</div></div>'
    shelf = '<div class="shelf"><span>Our shelf</span></div>' if box else ""
    return f'<div class="wrap">{inner}<div class="end">{shelf}<span>{footer}</span></div></div>'


def story(k):
    return f"Story {k} of many words.\nEnd of {k}."


def test_a_few_odd_pages_change_nothing_for_the_others(spark):
    """One page in a hundred has another footer, and one in fifty lacks a box."""
    pages = [(k, f"http://h.org/{k}", page(body(k, "Call me now" if k % 100 == 7 else "Call us today", k % 50 != 3))) for k in range(300)]
    got = read(spark, pages)
    assert all(got[k] == story(k) for k in range(300) if k % 100 != 7)
    assert all(story(k) in got[k] for k in range(300))


def test_any_page_may_be_the_reference(spark):
    """Each in turn is odd, so one of the runs has it as its reference whatever the hashes."""
    base = [page(body(k)) for k in range(6)]
    for odd in range(6):
        sources = [page(body(k, box=False)) if k == odd else h for k, h in enumerate(base)]
        got = read(spark, [(k, f"http://h.org/{k}", h) for k, h in enumerate(sources)])
        assert got == {k: story(k) for k in range(6)}


def test_wrappers_beyond_the_broadcast(spark, monkeypatch):
    pages = [(k, f"http://h{k % 3}.org/{k}", page(body(k))) for k in range(60)] + [(100, None, None), (101, "x", "")]
    want = read(spark, pages)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert read(spark, pages) == want == {k: story(k) for k in range(60)} | {100: "", 101: ""}


def test_counts_of_texts_stay_bounded():
    sums = html_text._Sums()
    import numpy as np
    for k in range(5_000):
        sums.add(np.array([0, 1]), np.array([7 if k % 50 else 100 + k, 10_000 + k], np.uint64))
    assert all(len(seen) <= html_text.TEXTS for seen in sums.texts.values())
    assert sums.has[0] == sums.has[1] == 5_000 and 4_900 - 5_000 // html_text.TEXTS <= sums.texts[0][7] <= 4_900


def test_a_shared_reference_gives_the_same_mappings():
    pages = [html_text.skeleton(html_text.parse(page(body(k, box=k % 2 == 0) * (1 + k % 3)))) for k in range(12)]
    shared = html_text.Reference(pages[0])
    for raw in pages:
        fresh = html_text.Reference(pages[0])
        a, b = shared.owns(raw), fresh.owns(raw)
        assert len(a[0]) == len(b[0]) == html_text.match(fresh.nodes[0], html_text.from_skeleton(raw)[0][0], {})


def test_a_page_is_gone_through_once(monkeypatch):
    """The text of an element is split once for all that is asked of a page, and few children are aligned without arrays."""
    source = page("<article>" + "".join(f'<p>Story {k} of <b class="name">many</b> words.</p>' for k in range(20)) + '</article><div class="ad">not this</div>')
    splits = []
    sys.setprofile(lambda frame, event, arg: splits.append(1) if event == "c_call" and getattr(arg, "__name__", "") == "split" and frame.f_code.co_name != "_described" else None)
    try:
        root = html_text.parse(source)
        html_text.layout(root)
        html_text.structure(root)
        tree = html_text.skeleton(root)
    finally:
        sys.setprofile(None)
    elements = 2 + 3 + 2 * 20 + 5       # html, body, article with its children, and some to spare
    assert 40 <= len(splits) <= elements
    other = html_text.skeleton(html_text.parse(source.replace("Story 3", "<i>Story</i> 3")))
    monkeypatch.setattr(html_text.Shapes, "table", lambda *_: pytest.fail("an array of few children"))
    assert len(html_text.Reference(tree).owns(other)[0]) == 44


@pytest.mark.parametrize("cells", [0, 12, 1_000])
def test_lists_and_arrays_give_the_same_mappings(monkeypatch, cells):
    pages = [html_text.skeleton(html_text.parse(page(body(k % 4, box=k % 2 == 0) * (1 + k % 3) + "<p>a<i>b</i></p><p>c</p>" * (k % 5)))) for k in range(15)]
    want = [html_text.Reference(a).owns(b) for a in pages[:4] for b in pages]
    monkeypatch.setattr(html_text, "SMALL_CELLS", cells)
    got = [html_text.Reference(a).owns(b) for a in pages[:4] for b in pages]
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(want, got, strict=True))
