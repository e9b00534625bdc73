import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lithoframe.llm import secret_scan as ss


def plain(text):
    """The base spans straight from their definition."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group()) >= n]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PASSWORD", "api_key", "apiKEY", "=", ":", " ", '"', "é", "abc", "0123456789abcdef", "AKIA", "QWERTYUIOP123456", "\n", "secret", "ſecret"]), max_size=14))
def test_base_spans_equal_definition(parts):
    text = "".join(parts)
    assert ss.base_spans(text, text.lower()) == plain(text)


def test_novelty_reports_keys_and_leaves_words():
    n = ss.Novelty()
    text = "the bearer is Zk93hQpL0sXv71TgRw2e for the service and credential=plain_words_only_here1 " * 1
    spans = ss.scan_text(text, n)[1]
    assert [text[s:e] for s, _, e in spans][:1] == ["Zk93hQpL0sXv71TgRw2e"]
    again = "value 4c0pyOf1KeyThat2Repeats3 " * 9 + "bearer 4c0pyOf1KeyThat2Repeats3"
    assert ss.scan_text(again, n)[1] == []
    assert ss.scan_text("a bearer of good tidings walked for sixteen kilometres", n)[1] == []


def test_rows_and_edges(spark):
    key = "AKIA" + "Q2" * 8
    long = "word " * 200_000 + "password=" + "a1" * 6
    rows = [(1, None, "x"), (2, "", "x"), (3, f"é {key} token = '0123456789abcdef01234567'", "x"), (3, f"é {key} token = '0123456789abcdef01234567'", "x"), (4, long, "y")]
    got = ss.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 5 and ss.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == "access:2:22,assign:23:56,hex:32:56" and (by[3].n_assign, by[3].n_access, by[3].n_hex) == (1, 1, 1)
    assert by[4].spans == f"assign:1000000:{len(long)}"
    red = spark.createDataFrame(rows, "doc_id long, text string, spans string").select("doc_id", ss.redact("text").alias("t")).collect()
    assert {r.doc_id: r.t for r in red}[3] == "é [SECRET] [SECRET]'" and {r.doc_id: r.t for r in red}[1] is None
