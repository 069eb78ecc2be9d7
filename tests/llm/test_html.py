import math
import random
import time

import numpy as np

from tidemark.llm import html as H
from tidemark.llm.queries import QUERIES

LONG = "The council met on Monday, and it agreed on a plan; nobody objected. "
CASES = {
    "article": (f"<html><head><title>No</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home, sweet home</a></nav><div class='ad'>{LONG * 4}</div><article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>{LONG * 3}</p><p>Short.</p></article><footer>&copy; no</footer></body></html>", f"Head & line\n{LONG.strip()}\n{(LONG * 3).strip()}\nShort."),
    "soup": (f"<body><div id=main-menu><ul><li>One<li>Two</ul></div><div class=content><h2>Title</h2><p>{LONG * 2}<p>{LONG}</div><div class='user-comments'><p>{LONG * 5}</div><div id=sidebar>{LONG}</div><form><p>{LONG}</p></form>", f"Title\n{(LONG * 2).strip()}\n{LONG.strip()}"),
    "notice": (f"<body><div class='cookie-notice'><p>{LONG * 3}</p></div><main><p>{LONG}</p><aside>{LONG * 3}</aside><p>a&nbsp;b &lt;i&gt; &#233;\n\n c</p></main>", f"{LONG.strip()}\na b <i> é c"),
    "plain": ("just text &amp; more", "just text & more"),
    "one": ("<p>Only one.</p>", "Only one."),
    "empty": ("", ""),
    "menus": ("<nav>only</nav><footer>menus</footer>", ""),
    "broken": ("<p>a <!-- open", "a"),
    "tags": ("<div><p>x < y <b>bold</b>er</p></div>", "x < y bolder"),
}


def test_cases():
    for name, (page, want) in CASES.items():
        assert H.extract(page) == want, name


def test_query(spark, tmp_path):
    rows = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(CASES.values())] + [(100, None, None, "x"), (None, "u", "<p>q", "x"), (7, "u7", "<p>same", "x"), (7, "u7", "<p>same", "x"), (101, "long", "<div>" * 3000 + "<p>deep" + "<p>" + "w " * 100_000, "x")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op10_html_extract"](spark, str(tmp_path)).collect()
    want = [w for _, w in CASES.values()] + ["", "q", "same", "same", "deep\n" + ("w " * 100_000).strip()]
    assert sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in got) == sorted((str(r[0]), r[1] or "", w, len(w)) for r, w in zip(rows, want))
    assert QUERIES["op10_html_extract"](spark, str(tmp_path)).limit(0).count() == 0


def test_short_parts_of_an_article_stay():
    page = f"<body><nav>no</nav><article><h1>Title</h1><div class=lead><p>Short lead.</p></div><div class=body>{'<p>' + LONG * 4}{'<p>' + LONG * 5}</div><div class=end><p>Last, short part.</p></div></article></body>"
    assert H.extract(page).split("\n") == ["Title", "Short lead.", (LONG * 4).strip(), (LONG * 5).strip(), "Last, short part."]


def brute(page):
    """Fused ratios of each block by plain loops over the path of every block."""
    p = H.Page(page)
    path = [p.path[n] for n in p.node]
    own = {}
    for x in set(path):
        at = [i for i, y in enumerate(path) if y == x]
        plain = sum(len(p.text[i]) - p.linked[i] for i in at) / len(at)
        marks = sum(c in H._PUNCTUATION for i in at for c in p.text[i]) / len(at)
        own[x] = math.sqrt(plain * (1 + marks))
    w = [math.exp(-0.5), 1.0, math.exp(-0.5)]
    along = []
    for i in range(len(path)):
        near = [own[path[min(max(j, 0), len(path) - 1)]] for j in (i - 1, i, i + 1)]
        along.append(sum(a * b for a, b in zip(w, near)) / sum(w))
    out = []
    for x in path:
        at = [i for i, y in enumerate(path) if y == x]
        _, _, hint, inside = p.steps[x]
        out.append(math.sqrt(own[x] * sum(along[i] for i in at) / len(at)) * 16.0 ** (inside - hint))
    return out


def made(rng, named=False):
    """A page without any element or name that tells its article, and that article."""
    sentence = lambda n: (" ".join("w" * rng.randint(2, 9) for _ in range(n)) + rng.choice([".", ", and so on; more."])).capitalize()
    menu = "".join(f"<div class=x{i}><a href=/{i}>{sentence(2)}</a></div>" for i in range(rng.randint(3, 12)))
    side = "".join(f"<div class=q><span>{sentence(3)}</span></div>" for _ in range(rng.randint(1, 5)))
    parts = [sentence(5)] + [" ".join(sentence(rng.randint(8, 25)) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(2, 9))] + [sentence(4)]
    body = f"<h2>{parts[0]}</h2>" + "".join(f"<p>{x}" for x in parts[1:])
    side = "" if named else side
    return f"<body><div class=k1>{menu}</div><div class=k2>{side}</div><div class='{'related' if named else 'k3'}'>{body}</div><div class=k4>{menu}</div><div class=k5>{side}</div>", "\n".join(parts)


def test_ratios_are_brute_force():
    rng = random.Random(3)
    for page in [c[0] for c in CASES.values()] + [made(rng)[0] for _ in range(20)]:
        if H.Page(page).text:
            assert np.allclose(H.ratios(H.Page(page))[0], brute(page))


def test_ratios_decide():
    """Pages that no name or landmark tells apart: with ratios the article, without them not.
    A telling name on the article itself is only a hint, which ratios of lists of links don't outweigh."""
    rng = random.Random(5)
    flat = lambda p: (np.ones(len(p.text)), np.zeros(len(p.text), bool))
    pages = [made(rng) for i in range(60)]
    assert all(H.extract(page) == want for page, want in pages)
    assert all(H.extract(page, flat) != want for page, want in pages)
    assert all(H.extract(page) == want for page, want in (made(rng, named=True) for _ in range(20)))


def test_broken_and_deep_pages_take_linear_time():
    n = 40_000
    pages = ["<div>" * 5 * n + "<p>deep", "<div>" * n + "</span></i></x>" * n + "end", '<a b="' * 4 * n + "x", "<a b='x\">" * 2 * n, "<ul>" + "<li><b>" * 3 * n, "<div>" * n + "<td>x" * 2 * n, "<p " + "a" * 25 * n + ">x", "<p><button>" + "<b>" * 2 * n + "<div></div>" * n, "<span hidden>" * 2 * n, "<" * 25 * n, "<p a" + " " * 25 * n, "<script>" * 3 * n]
    for page in pages:
        began = time.process_time()
        H.extract(page)
        assert time.process_time() - began < 2, page[:20]
    assert H.extract(pages[0]) == "deep" and H.extract(pages[1]) == "end"


def test_attributes_hide_only_what_they_say():
    assert H.extract(f"<main><p title='the hidden truth'>{LONG}<p hidden>no<p style='display: none'>no<p><span aria-hidden=true>no</span>{LONG}</main>") == f"{LONG.strip()}\n{LONG.strip()}"
