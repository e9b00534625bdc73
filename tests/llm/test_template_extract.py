from collections import defaultdict

import pytest

from lithoframe.llm import template_extract as te

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T {k}</title><style>p{{a:b}}</style><script>var t="</p><article>no</article>";</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies {k}</div>
<div id="content"><article><h1>Head&nbsp;{k}</h1><p>First &amp; {k}  para
 line<p>Second <b>bold<br>text</b> {k}</p><div class="ad">Buy {k}</div><ul><li>one {k}<li>two</ul><!-- <p>hidden</p> -->
<form><p>Sign up</p><input></form><div class="x9">Follow us for more</div></article></div>
<section class="comments"><article class="comment"><p>nice {k}</p></article></section><aside><p>side</p></aside><footer>&copy; me</footer></body></html>"""


def want(k):
    return "\n\n".join([f"Head {k}", f"First & {k} para line", f"Second bold text {k}", f"one {k}", "two"])


def test_article_and_template(spark):
    rows = [(k, f"https://h{k % 2}.example/{k}", PAGE.format(k=k), "x", 1) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    for bound in (1 << 26, 0):
        got = {r.page_id: r for r in te.extract(df, broadcast_bytes=bound).collect()}
        # "two" and "Follow us for more" stand on every page, so they are template text
        assert all(got[k].text == want(k).removesuffix("\n\ntwo") and got[k].n_chars == len(got[k].text) for k in range(40))
        assert got[3].url == "https://h1.example/3"
    alone = te.extract(df.where("page_id < 2")).collect()
    assert all(r.text == want(r.page_id) + "\n\nFollow us for more" for r in alone)


def test_classes_against_brute_force(spark):
    rows = [(k, f"https://h{k % 3}.example/{k}", PAGE.format(k=k) + "<p>odd</p>" * (k % 4)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, tuple(r.tokens), r.class_pages) for r in te.deduce(df).collect()}
    vectors = defaultdict(lambda: defaultdict(int))
    n = defaultdict(int)
    for k, u, h in rows:
        n[te.host_of(u)] += 1
        for t, c in te.page_tokens(te.Walk(h)).items():
            vectors[te.host_of(u), t][k] = c
    classes = defaultdict(list)
    for (host, t), v in vectors.items():
        if t and len(v) >= 0.6 * n[host]:
            classes[host, tuple(sorted(v.items()))].append(t)
    assert got == {(host, tuple(sorted(t)), len(v)) for (host, v), t in classes.items() if len(t) >= 2}


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just words & more &eacute;", "just words & more é"),
        ("<p>a<p>b</p></p>c", "a\n\nb\n\nc"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<article><p>1 < 2 <i>and</i>\t3</p><table><tr><td>x<td>y</table></article>", "1 < 2 and 3\n\nx\n\ny"),
        ("<article><p title='a>b'>q</p><script>if (a<b) '</article>'</script><p>r</article>tail", "q\n\nr"),
        ("<div class='menu'><p>no</p></div><div class='story'><p>yes yes</p><p>more</p></div><div><p>z</p></div>", "yes yes\n\nmore"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>b</p></article>", "T\n\nb"),
        ("<article><p>" + "long " * 300_000 + "</p></article>", ("long " * 300_000).strip()),
        ("<" * 2000, "<" * 2000),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_single_pages(html, text):
    assert te.main_text(te.Walk(html or ""), frozenset(), False) == text


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "not a url", ""), (3, "http://[bad", "<p>x"), (3, "http://[bad", "<p>x")], "page_id long, url string, html string")
    got = te.extract(df).collect()
    assert len(got) == 4 and {(r.page_id, r.text, r.n_chars) for r in got} == {(1, "", 0), (2, "", 0), (3, "x", 1)}
    assert te.extract(df.limit(0)).count() == 0
