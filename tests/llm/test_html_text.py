import time

import numpy as np
import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import extract, main_text

ARTICLE = "<article><h1>Head &amp; line</h1><p>First\n para<b>graph</b>.<div class='ad-box'>Buy this</div><p>Second&nbsp;one <a href='x'>here</a>.</article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a b"),
        (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><header>Site</header>{ARTICLE}<footer>F</footer></body>", "Head & line First paragraph. Second one here."),
        ("<article><p>keep</p><section class=comments><p>a reader says</p></section><form>name <input></form><script>var t='</p>'</script><aside>x</aside></article>", "keep"),
        ("<main><header><h1>T</h1></header><p>x &lt;b&gt; &#233;&euro;</p></main><div id=cookie-notice>We use cookies</div>", "T x <b> é€"),
        ("<article><!-- no > yes --><p title='a>b'>ok</p><style>p{}</style></article>", "ok"),
        ("<head><title>T</title><body class=has-sidebar><div class='page with-sidebar'><article><p>a</article><div class=sidebar>b</div></div>", "a"),
        ("<title>open <p>text", "open text"),
        ("<div><p>unclosed <b>bold<br>next</div><script>never closed", "unclosed bold next"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_without_article_the_long_stretch_wins():
    menu = "".join(f"<li><a href=/{i}>Menu entry number {i}</a></li>" for i in range(12))
    body = "".join(f"<p>Sentence {i} of a long story that goes on for a while.</p>" for i in range(8))
    page = f"<body><ul>{menu}</ul><div>{body}</div><ul>{menu}</ul></body>"
    assert main_text(page) == " ".join(f"Sentence {i} of a long story that goes on for a while." for i in range(8))


def test_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (2, None, "<p>" + "é " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r["page_id"], r["text"][:3], r["n_chars"]) for r in extract(pages, *(pages[c] for c in ("page_id", "url"))).collect())
    assert out == [(1, "", 0), (1, "a", 1), (2, "é é", 99_999)]
    assert extract(pages.limit(0)).count() == 0


def brute(found, window=5):
    """The lines that stay, by sums over each line's neighbours, one by one."""
    size = [len(f[0]) for f in found]
    own = {}
    for n, f in zip(size, found, strict=True):
        own.setdefault(f[4], []).append((n, f[1]))
    listed = {k for k, v in own.items() if k and (sum(x for _, x in v) > 0.5 * sum(n for n, _ in v) or sum(n for n, _ in v) < 40 * len(v))}
    low = [f[3] or f[4] in listed for f in found]
    article = any(n and f[2] and not b for n, f, b in zip(size, found, low, strict=True))
    low = [b or (article and not f[2]) for b, f in zip(low, found, strict=True)]
    weight = [max(0, n - f[1]) * (0.05 if b else 1) for n, f, b in zip(size, found, low, strict=True)]
    sums = [sum(weight[max(0, i - window // 2) : i + window // 2 + 1]) for i in range(len(found))]
    over = [s > 0 and s >= min(20, 0.1 * max(sums)) for s in sums]
    kept = []
    for i in range(len(found)):
        if not over[i] or low[i]:
            continue
        a = b = i
        while a > 0 and over[a - 1]:
            a -= 1
        while b + 1 < len(found) and over[b + 1]:
            b += 1
        heavy = [k for k in range(a, b + 1) if weight[k] > 0]
        if heavy and heavy[0] <= i <= heavy[-1]:
            kept.append(found[i][0])
    return " ".join(kept)


def test_against_brute_force():
    rng = np.random.default_rng(1)
    bits = ["<p>A sentence of some length stands here.</p>", "<p>No.</p>", "<ul>", "</ul>", "<li><a href=x>a link</a></li>", "<li><a href=x>another one</a></li>", "<div class=ad><p>Buy</p></div>", "<div class=related>", "</div>", "<article>", "</article>", "<section>", "</section>", "tail <a>linked</a>", "<nav>n</nav>"]
    differs = 0
    for _ in range(600):
        page = "".join(rng.choice(bits, int(rng.integers(1, 40))))
        found = html_text.lines(page)
        assert main_text(page) == (brute(found) if found else "")
        differs += main_text(page) != main_text(page, window=1)
    assert differs > 50


def test_windows_decide_about_links():
    links = "<ul>" + "<li><a href=x>Some other page</a></li>" * 8 + "</ul>"
    first, second = "The first part of a text is long enough to be one.", "Its second part is shorter."
    page = "<article><p>{}</p>{}<p>{}</p></article>"
    assert main_text(page.format(first, links, second)) == f"{first} {second}"
    assert main_text(page.format(first, "<p><a href=x>A lone link</a></p>", second)) == f"{first} A lone link {second}"
    prose = '<div class="related-work"><p>Related work in the text is described in prose of some length.</p></div>'
    assert "Related work" in main_text(page.format(first, prose, second))


@pytest.mark.parametrize("bad", ["<select>", "<div>", "</p></b>", "<svg>", "<textarea>", "<a '", '<i "', "<!--", "<div><p></i>", "<table><tr>"])
def test_bad_markup_takes_linear_time(bad):
    began = time.perf_counter()
    main_text(bad * (200_000 // len(bad)) + "<p>x")
    assert time.perf_counter() - began < 2


def test_ties_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a", "u", 5), (1, "<p>a", "u", 5)], "page_id long, html string, text string, n_chars int")
    out = extract(pages, pages["page_id"]).collect()
    assert [tuple(r) for r in out] == [(1, "a", 1)] * 2
