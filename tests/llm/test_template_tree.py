import random
import time
from collections import Counter, defaultdict

import pytest

from lithoframe.llm import template_extract as te

SCHEMA = "page_id long, url string, html string"


def sentence(rng, n=12):
    return " ".join(rng.choice(["river", "stone", "light", "seven", "paper", "north", "glass", "train"]) + str(rng.randrange(500)) for _ in range(n))


def site(rng, host):
    """Pages of one layout: fixed and optional boxes in any order, lists, an article or none, copies of pages."""
    marked, out = rng.random() < 0.4, []
    boxes = [f"<div class='k{j}'><p>{'' if rng.random() < 0.5 else sentence(rng, 4)}</p></div>" for j in range(4)]
    for k in range(rng.choice([1, 2, 3, 5, 9])):
        body = "".join(f"<p>{sentence(rng)}</p>" for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.3:
            body += f"<div class='f'>{sentence(random.Random(host), 3)}</div>"
        top = "".join(b for b in boxes if rng.random() < 0.8)
        low = "".join(f"<div class='z{j}'><i>{sentence(rng, 2) if rng.random() < 0.4 else 'same words'}</i></div>" for j in rng.sample(range(3), 3) if rng.random() < 0.9)
        links = "".join(f"<li><a href='#'>{sentence(rng, 1)}</a>" for _ in range(rng.randrange(4)))
        text = f"<article>{body}</article>" if marked and rng.random() < 0.9 else f"<div id='text'>{body}</div>"
        html = f"<html><body><div class='top'>{top}</div><ul>{links}</ul>{text}<div class='low'>{low}</div></body></html>"
        out += [(f"https://{host}/{k}", html)] * rng.choice([1, 1, 1, 3])
    return out


def runs_of(walk, of):
    """The page's events in order, and of each ordered class its order and the places of its runs."""
    events, block = [], -1
    for token in walk.sequence:
        block += token >= te.TEXTS
        events.append((of.get(abs(token), 0), token, block if token >= te.TEXTS else -1))
    orders, runs = {}, []
    for c in {c for c, _, _ in events if c}:
        at = [k for k, e in enumerate(events) if e[0] == c]
        m = len({events[k][1] for k in at})
        parts = [at[k : k + m] for k in range(0, len(at), m)]
        alike = {tuple(events[k][1] for k in p) for p in parts}
        orders[c] = alike.pop() if len(alike) == 1 else None
        if orders[c] and len(set(orders[c])) == m:
            runs += [(p, c) for p in parts]
        else:
            orders[c] = None
    runs.sort()
    ends = []
    for n, (p, _) in enumerate(runs):  # a run ends early where one that began before it goes on
        ends.append(min([p[-1]] + [x for (q, _), e in zip(runs[:n], ends) for x in q if p[0] < x < p[-1] and x <= e]))
    return events, orders, runs, ends


def around(runs, ends, at):
    """The open (class, slot) around a place, inner ones last."""
    return [(c, sum(x < at for x in p) - 1) for (p, c), e in zip(runs, ends) if p[0] < at < e or (p[0] < at == e < p[-1])]


def plain(pages):
    """The main text of each page, by the definitions and all at once."""
    hosts, out = defaultdict(list), {}
    for i, u, h in pages:
        hosts[te.host_of(u)].append((i, te.Walk(h)))
    for rows in hosts.values():
        distinct = list({tuple((b[0], b[5]) for b in w.blocks): w for _, w in rows[::-1]}.values())
        vectors = defaultdict(lambda: [0] * len(distinct))
        for k, w in enumerate(distinct):
            for token, n in te.page_tokens(w).items():
                if token:
                    vectors[token][k] = n
        classes = defaultdict(list)
        for token, v in vectors.items():
            if sum(map(bool, v)) >= max(3, 0.6 * len(distinct)):
                classes[tuple(v)].append(token)
        of = {t: n + 1 for n, (_, ts) in enumerate(sorted(classes.items())) if len(ts) > 1 for t in ts}
        seen = [runs_of(w, of) for w in distinct]
        valid, parent = set(), {}
        for c in set(of.values()):
            here = [s for s in seen if c in s[1]]
            opens = {(around(runs, ends, p[0]) or [te.ROOT])[-1] for _, _, runs, ends in here for p, d in runs if d == c}
            whole = all(e == p[-1] for _, _, runs, ends in here for (p, d), e in zip(runs, ends) if d == c)
            if len({s[1][c] for s in here}) == 1 and here[0][1][c] and whole and len(opens) == 1:
                parent[c] = opens.pop()
                if any(te.is_tag(t) for t, d in of.items() if d == c):
                    valid.add(c)

        def chain(slot):
            return (chain(parent[slot[0]]) if slot[0] in parent else []) + [slot] * (slot[0] in valid)

        below, depth, total = Counter(), {}, 0
        for w, (events, orders, runs, ends) in zip(distinct, seen):
            if any(kept and (art or main) for _, kept, art, main, _, _ in w.blocks):
                continue
            for at, (c, _, x) in enumerate(events):
                if x >= 0 and not (c and orders[c]) and w.blocks[x][1]:
                    total += len(w.blocks[x][5])
                    for n, slot in enumerate(chain((around(runs, ends, at) or [te.ROOT])[-1])):
                        below[slot] += len(w.blocks[x][5])
                        depth[slot] = n
        main = max((s for s, n in below.items() if n >= 0.9 * total), key=lambda s: (depth[s], s), default=te.ROOT)
        of = {t: c for t, c in of.items() if c in valid}
        for i, w in rows:
            events, orders, runs, ends = runs_of(w, of)
            fixed = {x for c, _, x in events if x >= 0 and c}
            region = [x for x, b in enumerate(w.blocks) if b[1] and (b[2] or b[3])]
            much = 2 * sum(len(w.blocks[x][5]) for x in region if x in fixed) < sum(len(w.blocks[x][5]) for x in region)
            left = [x for x, b in enumerate(w.blocks) if b[1] and not (x in fixed and (much or x not in region))]
            if [x for x in left if x in region]:
                left = [x for x in left if w.blocks[x][2]] or [x for x in left if w.blocks[x][3]]
            elif main != te.ROOT and (inside := [x for at, (_, _, x) in enumerate(events) if x in left and main in around(runs, ends, at)]):
                left = inside
            else:
                above = lambda c: above(w.around[c]) | {c} if c else set()
                n = {c: sum(len(w.blocks[x][5]) for x in left if c in above(w.blocks[x][4])) for c in w.around}
                best = max((c for c in n if n[c] >= 0.9 * n[1]), key=lambda c: len(above(c)))
                left = [x for x in left if best in above(w.blocks[x][4])]
            out[i] = "\n\n".join(w.blocks[x][5] for x in left)
    return out


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_texts_against_brute_force(spark, bound):
    rng, rows = random.Random(5), []
    for n in range(40):
        rows += [(len(rows) + k, u, h) for k, (u, h) in enumerate(site(rng, f"h{n}.example"))]
    got = {r.page_id: r.text for r in te.extract(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=bound).collect()}
    assert got == plain(rows)


def test_any_number_of_identical_pages_gives_the_article(spark):
    rows = []
    for n in (1, 2, 3, 7, 8, 20):
        rows += [(n, f"https://s{n}.example/{k}", "<body><nav>menu</nav><article><h1>Head</h1><p>one two three</p><p>four</p></article></body>") for k in range(n)]
    assert {(r.page_id, r.text) for r in te.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {(n, "Head\n\none two three\n\nfour") for n in (1, 2, 3, 7, 8, 20)}


def test_passage_on_most_pages_stays_and_fixed_box_goes(spark):
    rows = []
    for k in range(10):
        passage = "<p>a passage</p><p>that most pages quote</p>" if k < 8 else ""
        rows.append((k, f"https://q.example/{k}", f"<body><article><p>{f'own words of page {k} ' * 9}</p>{passage}<div class='x'>Write to us</div></article></body>"))
    got = {r.page_id: r.text for r in te.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == (f"own words of page {k} " * 9).strip() + ("\n\na passage\n\nthat most pages quote" if k < 8 else "") for k in range(10))


def test_main_slot_is_the_hosts_not_the_pages(spark):
    rows = []
    for k in range(12):
        own = f"short {k}" if k == 5 else f"the long text of page {k} " * 30
        rows.append((k, f"https://b.example/{k}", f"<body><div class='p'><h2>{k} is first</h2><p>{own}</p></div><div class='q'><p>{f'box {k} ' * 3}</p></div></body>"))
    got = {r.page_id: r.text for r in te.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5].endswith("short 5") and "box" not in got[5] and "box" not in got[1]


def test_unordered_and_crossing_classes_are_not_nodes(spark):
    rows = []
    for k in range(6):
        a, b = "<div class='a'><p class='pa'></p></div>", "<div class='b'><p class='pb'></p></div>"
        crossing = "<i class='x1'></i><i class='y1'></i><i class='x2'></i><i class='y2'></i>" if k < 5 else "<i class='x1'></i><i class='x2'></i>"
        rows.append((k, f"https://o.example/{k}", f"<body><ul>{a + b if k % 2 else b + a}</ul><ol>{crossing}</ol><p>{k}</p></body>"))
    df = spark.createDataFrame(rows, SCHEMA)
    seen = te.sequences(df, "url", "html")
    nodes = {r["class"]: r.valid for r in te.tree(seen, te.classes_of(seen)).collect() if r["class"]}
    assert len(nodes) == 2 and not any(nodes.values())


@pytest.mark.parametrize("name", ["share-price", "notice-of-award", "related-work", "comment-on-ruling", "discussion", "advanced", "menuet"])
def test_names_that_only_begin_like_marks_stay(name):
    for tag in ("div", "section"):
        assert te.main_text(te.Walk(f"<article><p>a b</p><{tag} class='{name}'><p>c d</p></{tag}></article>")) == "a b\n\nc d"


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "cookie-notice", "readerComments", "comment-list", "site-footer", "sidebar_left", "share-buttons", "newsletter signup", "main-menu", "related-posts", "ad-300x250", "side-bar", "legal-notice", "comment-text", "related-articles", "cookie-policy"])
def test_marked_boxes_go(name):
    assert te.main_text(te.Walk(f"<article><p>a b</p><div class='{name}'><p>c d</p></div></article>")) == "a b"


@pytest.mark.parametrize("piece", ["<a x", "<div>x", '<a "', "<i>", "<!", "</a", "<p>", "<tr><td>", "<li><div>", "<b a='", "<![CDATA[", "<script>", "<dd>x<dt>", "<i><div></div>"])
@pytest.mark.parametrize("tail", ["", ">", "<article><p>end</p></article>"])
def test_broken_markup_takes_linear_time(piece, tail):
    begun = time.process_time()
    te.main_text(te.Walk(piece * 100_000 + tail))
    assert time.process_time() - begun < 6


def test_depth_has_no_bound():
    deep = "<div>" * 500
    assert te.main_text(te.Walk(deep + "<div class='s'><p>" + "long " * 50 + "</p></div><div class='t'><p>x</p></div>")) == ("long " * 50).strip()
