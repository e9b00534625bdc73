from lithoframe.llm import template_extract as te


def page(*blocks, tail=""):
    return "<html><body><article><h1>" + "</h1><p>".join(blocks) + f"</p></article>{tail}</body></html>"


def texts(spark, pages):
    rows = [(k, u, h) for k, (u, h) in enumerate(pages)]
    return [r.text for r in te.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_of_an_article_keep_their_text(spark):
    copies = [(f"https://a.example/?v={k}", page("Head", "one two", "three four")) for k in range(8)]
    others = [(f"https://a.example/o{k}", page(f"H{k}", f"only {k}")) for k in range(2)]
    assert texts(spark, copies + others) == ["Head\n\none two\n\nthree four"] * 8 + ["H0\n\nonly 0", "H1\n\nonly 1"]
    mirrors = [(None, page("Head", "one two", "three four", tail=f"<p>visit {k}</p>")) for k in range(9)]
    assert texts(spark, mirrors) == ["Head\n\none two\n\nthree four"] * 9


def test_one_rule_for_all_host_sizes(spark):
    def site(n):
        return [(f"https://s{n}.example/{k}", page(f"Head {k}", f"some words of page {k} stand here", "Follow us", "Write us")) for k in range(n)]

    for n in (4, 12):
        assert texts(spark, site(n))[3] == "Head 3\n\nsome words of page 3 stand here"
