from placeforge.llm import html_extract as H

LONG = "This is a sentence of the article that goes on for quite a while, with words. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;one <i>in</i>line.<br><p>{LONG}</p><form><input><p>Sign up</p></form><aside>More</aside><p>End.</p>
<div id="comments"><p>{LONG} says a reader</p></div></article><footer>&copy; x</footer></body></html>"""


def test_article():
    body = " ".join(LONG.split())
    assert H.extract(PAGE) == f"Head & line First one inline. {body} End."


def test_without_an_article_element():
    items = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(9))
    page = f"<body><div class='menu'><ul>{items}</ul></div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='footer'><p>All rights</p><p>reserved</p></div></body>"
    body = " ".join(LONG.split())
    assert H.extract(page) == f"Title {body} Short. {body}"


def test_broken_pages():
    assert H.extract(None) == H.extract("") == H.extract("<nav>only a menu</nav>") == ""
    assert H.extract("plain text") == "plain text"
    assert H.extract("<article><p>cut off &am") == "cut off &am"
    assert H.extract("<article><p>a < b and c &lt; d</p><p unclosed") == "a < b and c < d"
    assert H.extract("<article></div></p><p>x</span>y</article>") == "xy"
    assert len(H.extract("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 5 - 1


def test_surge_and_dive():
    assert H.stretches([0, 0, 50, 60, 0, 10, 0, 0, 0, 0, 5, 0], 3, 80) == [(2, 6)]
    assert H.stretches([0, 3, 0], 3, 80) == [(1, 2)]
    assert H.stretches([], 3, 80) == []


def test_spark(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = H.main_text(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and got[1].text == ""
    assert H.main_text(df.filter("false")).collect() == []


def test_the_measure_decides_over_article_marks():
    story = "".join(f"<p>{LONG}</p>" for _ in range(8))
    cards = "".join(f"<article><p>Teaser {k}</p></article>" for k in range(3))
    body = " ".join([" ".join(LONG.split())] * 8)
    assert H.extract(f"<body><div>{cards}</div><div>{story}</div></body>") == body
    assert H.extract(f"<body><article>{story}</article><div>{story}</div></body>") == f"{body} {body}"


def test_text_after_a_set_aside_block_stays():
    closing = "The closing paragraph. " * 9
    story = "".join(f"<p>{LONG}</p>" for _ in range(9))
    for end in (closing, "End."):
        assert H.extract(f"<body><div>{story}<div class='ad'>Buy</div><p>{end}</p></div></body>").endswith(end.strip())


def test_wrappers_with_modifier_names_stay():
    body = " ".join(LONG.split())
    for name in ("content has-sidebar", "layout with-sidebar", "post-content no-comments", "legal-text", "sidebar", "modal"):
        assert H.extract(f"<body><div class='{name}'><article><p>{LONG}</p></article><div class='sidebar'>Side</div></div></body>") == body
        assert H.extract(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == body
    for name in ("site-footer", "sidebar", "cookie-banner", "main-nav"):
        assert H.extract(f"<body><article><p>{LONG}</p></article><div class='{name}'><p>{LONG}</p></div></body>") == body


def test_elements_that_close_themselves_or_not_at_all():
    assert H.extract("<article><p>first</p><svg/><p>second</p></article>") == "first second"
    assert H.extract("<article><p>first</p><svg><text>drawn</text></svg><p>second</p></article>") == "first second"
    assert H.extract("<article><div>one<select><option>x</div><p>two</p><object>three</object></article>") == "one two three"
    assert H.extract("<head><title>never closed</head><article><p>text</p></article>") == "text"
    assert H.extract("<article><p>text</p><script>var a = '<p>no text</p>';") == "text"
    assert H.extract("<article><p>text</p><script>var a = '</p>';</script ><p>more</p></article>") == "text more"
    assert H.extract("<article><p>a</p><textarea>b</textarea><template><p>c</p></template><noscript>d</noscript><p>e</p></article>") == "a e"
    assert H.extract("<article><p>a <span class='ad'>Buy <b>now</b></span>b</p><p><ins class='adsense'>x</ins>c</p><span class='ad'><p>d</p></span></article>") == "a b c"
    assert len(H.extract("<title>" * 20_000 + "<article><p>x</p></article>")) <= 1


def test_lines_of_an_article_keep_names_that_tell_what_they_say():
    body = " ".join(LONG.split())
    page = f"<article><p>{LONG}</p><p class='legal'>{LONG}</p><p class='alert'>{LONG}</p><section id='related-work'><p>{LONG}</p></section><p class='advert'>Buy</p><div class='cookie-notice'>We</div></article>"
    assert H.extract(page) == " ".join([body] * 4)


def test_a_heading_before_the_menu_stays():
    story = "".join(f"<p>{LONG}</p>" for _ in range(5))
    body = " ".join([" ".join(LONG.split())] * 5)
    assert H.extract(f"<body><h1>Headline</h1><nav><a href='/'>Home</a></nav><div>{story}</div></body>") == f"Headline {body}"
    assert H.extract(f"<body><div><h1>Site</h1></div><nav>x</nav><div><h1>Headline</h1>{story}</div></body>") == f"Headline {body}"


def brute_stretches(sizes, window, surge):
    """Line by line: a line is in a stretch if a window over it has text; a stretch with a window beyond ``surge`` is strong."""
    n = len(sizes)
    padded = [0] * window + list(sizes) + [0] * window
    total = {i: sum(padded[i + window + k] for k in range(window)) for i in range(-window, n)}  # the window that begins at line i
    runs, now = [], []
    for i in range(-window, n):
        if total[i]:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    runs += [now] if now else []
    out = []
    for run in runs:
        own = [k for k in range(max(0, run[0]), min(n, run[-1] + window)) if sizes[k]]
        out.append((own[0], own[-1] + 1, max(total[i] for i in run) >= surge))
    return [r[:2] for r in out if r[2]] or [r[:2] for r in out]


def brute_text(page):
    """The measure decides, without the operator's own extract()."""
    sizes, texts, heads = H.measured(page)
    found = brute_stretches(sizes, H.WINDOW, H.SURGE)
    weight = {f: sum(sizes[slice(*f)]) for f in found}
    strong = [f for f in found if weight[f] >= H.SHARE * max(weight.values())]
    if not strong:
        return ""
    kept = [t for t in texts[strong[0][0] : strong[-1][1]] if t]
    before = [k for k in range(strong[0][0]) if sizes[k]]
    if len(heads) == 1 and before[-1:] == heads and all(strong[0][0] - heads[0] > H.WINDOW and sizes[k] == 0 for k in range(max(0, heads[0] - H.WINDOW), heads[0])):
        kept.insert(0, texts[heads[0]])
    return " ".join(kept)


def test_stretches_against_brute_force():
    import random

    r = random.Random(3)
    for _ in range(500):
        sizes = [r.choice([0, 0, 0, 0, 5, 30, 90]) for _ in range(r.randint(0, 40))]
        window, surge = r.randint(1, 5), r.choice([0, 40, 80])
        assert H.stretches(sizes, window, surge) == brute_stretches(sizes, window, surge)


def test_pages_against_brute_force(spark):
    """Every page of a table, and pages without marks, where stretches fall away on all sides."""
    import random

    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    r = random.Random(4)
    for k in range(200):
        parts = [r.choice([f"<p>{LONG[: r.randint(5, 200)]}</p>", "<nav><a href='/x'>menu of links</a></nav>", "<div class='ad'>Buy</div>", f"<div><p>{LONG[: r.randint(3, 90)]}</p></div>", "<h1>Head</h1>", "<div><a href='/y'>teaser in a link</a></div>", f"<article><p>{LONG[:60]}</p></article>"]) for _ in range(r.randint(0, 14))]
        pages.append("<body>" + "".join(parts) + "</body>")
    differ = 0
    for page in pages:
        got = H.extract(page)
        assert got == brute_text(page or "")
        differ += got != " ".join(t for t in H.measured(page or "")[1] if t)
    assert differ > 40  # surge and dive points leave text out
