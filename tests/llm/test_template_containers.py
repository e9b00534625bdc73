from lithoframe.llm import template_extract as te


def test_sibling_sections_are_one_article():
    html = "<body><div id='content'><section id='a'><p>first part of it</p></section><section id='b'><p>the second, longer part of it</p></section></div></body>"
    assert te.main_text(te.Walk(html), frozenset()) == "first part of it\n\nthe second, longer part of it"


def test_container_with_an_id_per_page(spark):
    rows = [(k, f"https://p.example/{k}", f"<body><div id='post-{k}'><p>{f'long words of post {k} ' * 10}</p></div><div class='x'><p>v {k}</p></div></body>") for k in range(6)]
    got = te.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == (f"long words of post {r.page_id} " * 10).strip() for r in got)
