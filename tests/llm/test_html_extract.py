"""Main text of worked pages."""

from bidloom.llm import html_extract as H

LONG = "This is the first paragraph of the article and it has all of the words that a text in the language needs to be read as such by the rules, and it goes on."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><p>Site of the day</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A &amp; B</h1><p>{LONG}<br>Next&nbsp;line <b>bold</b><i>it</i>.</p><p>Short.<p>Also <a href="x">linked</a> text &lt;here&gt;
<ul class="related"><li><a href="1">One</a><li><a href="2">Two</a></ul><form><label>Mail</label><input></form>
<aside>Side note of the page</aside><p>Last words</p><section id="comments"><p>{LONG}</p></section></article>
<div class="ad">Buy this</div><footer>&copy; all</footer><script>x</script></body></html>"""


def test_article_without_its_surroundings():
    assert H.main_text(PAGE) == "\n\n".join(["A & B", LONG + " Next line boldit.", "Short.", "Also linked text <here>", "Last words"])


def test_page_without_article_takes_neighbours():
    body = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h2>Title</h2><p>{LONG}</p><p>And more.</p><p>{LONG}</p><div class=footer><p>{LONG}</p></div></body>"
    assert H.main_text(body) == "\n\n".join(["Title", LONG, "And more.", LONG])


def test_odd_pages():
    for odd in (None, "", "<", "<p", "plain", "<article>", "<script>never closed", "<!-- open", "&#xZZ; &bogus;", "<article></p></div></article>"):
        assert isinstance(H.main_text(odd), str)
    assert H.main_text("<article><p>one<p>two") == "one\n\ntwo"
    assert H.main_text("<article>&amp;amp; &eacute;&#233;</article>") == "&amp; éé"
    deep = "<div>" * 3000 + f"<article><p>{LONG}</p></article>" + "</div>" * 3000
    assert H.main_text(deep) == LONG


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a"), (None, None, None, "b"), (1, "u", PAGE, "a")], "page_id bigint, url string, html string, text string")
    rows = H.extracted(df, keep=("page_id", "text")).collect()
    assert sorted((r.page.text, len(r.text)) for r in rows) == [("a", len(H.main_text(PAGE)))] * 2 + [("b", 0)]
    assert H.extracted(df.limit(0)).count() == 0


def test_wrappers_around_the_article_are_containers():
    """A form or a layout name around everything, and comments, notices and side columns in it."""
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    around = f"<div class=sidebar><p>{LONG}</p></div><div id=comments><article><p>{LONG}</p></article></div><div class=cookie-notice><p>{LONG}</p></div>"
    wanted = "\n\n".join(["Title", LONG, LONG])
    for a, b in (("<form id=aspnetForm>", "</form>"), ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="widget"><div role=form>', "</div></div>")):
        for x, y in (("<article>", "</article>"), ("<main>", "</main>")):
            assert H.main_text(f"<body><nav>Menu</nav>{a}{x}{body}{y}{around}{b}</body>") == wanted
            assert H.main_text(f"<body>{a}{x}{body}{y}{b}{around}</body>") == wanted
        assert H.main_text(f"<body>{a}<div>{body}</div><div class=sidebar><p>{LONG}</p></div>{b}</body>") == wanted
    assert H.main_text(f"<div class=comments-on><main>{body}</main></div>") == wanted
    for odd in ("comments", "cookie-notice", "footer"):
        assert H.main_text(f"<div class={odd}><p>{LONG}</p><p>{LONG}</p></div>") == ""
    assert H.main_text(f"<nav><div class=widget><main>{body}</main></div></nav>") == ""


def test_languages_without_stop_words():
    """Long blocks of unknown languages, terse text and wide letters; nothing changes where the language is known."""
    polish = "Wczoraj wieczorem mieszkańcy miasta spotkali się przed ratuszem, żeby wspólnie porozmawiać o przyszłości parku, który od lat czeka na remont i nowe ławki. "
    russian = "Вчера вечером жители города собрались перед ратушей, чтобы вместе поговорить о будущем парка, который уже много лет ждёт ремонта и новых скамеек. "
    chinese = "昨天晚上,市民们聚集在市政厅前,共同讨论公园的未来。这座公园多年来一直等待修缮,也需要新的长椅。许多人希望工程能够尽快开始。"
    terse = "Flour 500 g, sugar 200 g, butter 150 g, eggs 3, milk 100 ml, salt 5 g, yeast 10 g, vanilla 2 g, raisins 80 g, almonds 50 g, lemon 1, cinnamon 3 g, cloves 2."
    links = "<ul><li><a href=a>Link</a></li><li><a href=b>Link</a></li></ul>"
    for text in (polish.strip(), russian.strip(), chinese, terse):
        page = f"<body><div>{links}</div><h1>T</h1><p>{text}</p><p>ab</p><p>{text}</p><div class=footer><p>{text}</p></div></body>"
        assert H.main_text(page) == "\n\n".join(["T", text, "ab", text])
    middling = "One of the" + " long terse words" * 8 + " in a list"
    assert H.SPARSE <= H.Block(middling, 0, False, False, 0).density < H.DENSE
    assert H.main_text(f"<p>{middling}</p><p>{middling}</p>") == f"{middling}\n\n{middling}"
    assert H.main_text(f"<p>{LONG}</p><p>{LONG}</p><p>{terse}</p>") == f"{LONG}\n\n{LONG}"


def test_long_link_lists_and_deep_pages_take_linear_time():
    import time

    started = time.time()
    article = "<article><p>" + "The words of the text are what it is that people read and then think about for a while. " * 4 + "</p></article>"
    links = "<ul>" + "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(100_000)) + "</ul>"
    text = H.main_text(links + article)
    assert text.startswith("The words") and "link number" not in text
    depth = 50_000
    assert "people read" in H.main_text("<div>" * depth + "</section>" * depth + article + "</div>" * depth)
    assert time.time() - started < 60
