"""Nearest neighbours against brute force, and page extraction against known articles and an exhaustive cut."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("nodetide.llm")


def test_recall_and_exact_scores(spark, monkeypatch):
    from nodetide.llm import graph_ann as g

    monkeypatch.setattr(g, "SHARD", 400)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 1000)] + 0.6 * rng.normal(size=(1000, 16))
    x[300:320] = x[0]  # one vector many times
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(1000)]
    rows += [(1000, None, ""), (1050, [0.0] * 16, ""), (1100, [float("nan")] * 16, ""), (1150, [None] * 16, ""), (1200, [float("inf")] + [1.0] * 15, ""), (None, [1.0] * 16, ""), (50, rows[50][1], "again"), (1250, [1.0, 2.0], "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in g.nearest_of_every_fiftieth(d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = g.exact(x, np.arange(1000), np.arange(0, 1000, 50), 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in {v for _, v, _ in found}
        assert [v for _, v, _ in found] == [v for v, _ in sorted(((v, s) for _, v, s in found), key=lambda p: (-p[1], p[0]))]
        for _, v, s in found:
            assert abs(s - x[q] @ x[v] / np.linalg.norm(x[q]) / np.linalg.norm(x[v])) < 1e-12
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)
    assert [v for _, v, _ in got[0]] == [300, 301, 302, 303, 304]
    assert g.nearest_of_every_fiftieth(d.limit(0)).count() == 0


def test_graph_is_connected_and_pruned():
    from nodetide.llm import graph_ann as g

    x = g._unit(np.random.default_rng(1).normal(size=(300, 8)))
    graph, start = g.build(x, degree=12, beam=24)
    seen, todo = {start}, [start]
    while todo:
        for j in graph[todo.pop()].tolist():
            if j >= 0 and j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 300
    assert g.build(x[:1])[0].shape == (1, g.DEGREE)


def test_pages(spark):
    from nodetide.llm import html_text

    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site, all of them.</div><article><h1>A &amp; B</h1><p>One  <b>tw</b>o\n three.<p>Four<br>five<!-- no -->.</p></article><aside><p>Related things to read in this long sidebar.</p></aside><section id="comments"><p>A reader says something rather long here.</p></section><form><label>Mail</label></form><footer>&copy; x'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain <i>text</i> only"), (1, "u", page), (5, "x", "<article>" + "<p>Long one.</p>" * 3000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in html_text.extract_pages(d).collect())
    want = "A & B\n\nOne two three.\n\nFour five."
    assert got[:2] == [(1, "u", want, len(want))] * 2 and got[2][2] == got[3][2] == "" and got[4][2] == "plain text only"
    assert got[5][2].count("\n\n") == 2999 and html_text.extract_pages(d.limit(0)).count() == 0


def test_cut_is_minimal():
    from nodetide.llm.html_text import label

    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        odds = [round(rng.uniform(-2, 2), 3) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[i][j] = edges[j][i] = round(rng.uniform(0, 1.5), 3)
        cost = lambda s: sum(max(0, -o) if x else max(0, o) for o, x in zip(odds, s)) + sum(w for i in range(n) for j, w in edges[i].items() if i < j and s[i] != s[j])
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(label(odds, edges)) <= best + 1e-9


def test_pages_lose_no_text_to_case_or_quotes(spark):
    from nodetide.llm import html_text as h

    page = "<article><h1>" + "İ" * 60 + '</h1><SCRIPT>var a = "<p>";</Script ><p>First one, in full.</p><p title="a > b">Second one, in full.</p><p data-x=\'it"s\'>Third one, 1 < 2 in full.</p></article>'
    assert h.extract(page).split("\n\n")[1:] == ["First one, in full.", "Second one, in full.", "Third one, 1 < 2 in full."]
    assert h.extract('<article><p>Kept, all of it.</p><p>Cut off here <a href="x') == "Kept, all of it.\n\nCut off here"
    assert h.extract('<div class="page no-sidebar has-nav"><p>An ordinary sentence of some length, about things.</p></div>').startswith("An ordinary")
    d = spark.createDataFrame([(None, None, page), (None, "u", None), (7, "u", "<p>")], "page_id long, url string, html string")
    assert sorted((r.n_chars for r in h.extract_pages(d).collect())) == [0, 0, len(h.extract(page))]


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a ="', "<a ='\"", "<div>", "</p>x", "<ul><li>", "<p><div>", "<script>", "<!-- ", "<![", '<p class="', "<table><tr><td>x", "&amp", "< ", "<p id= class=nav"])
def test_hostile_pages_take_linear_time(piece):
    import time

    from nodetide.llm import html_text as h

    def seconds(n):
        page = "<article><p>Text.</p>" + piece * (n // len(piece))
        began = time.process_time()
        h.extract(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(1 << 20) < 20 * max(seconds(1 << 17), 0.02)  # eight times the length


def test_whole_pages_against_the_best_labelling():
    from nodetide.llm import html_text as h

    rng = random.Random(4)
    wrap = ["<p>{}</p>", "<li>{}</li>", "<div>{}</div>", "<h2>{}</h2>", '<li><a href="/">{}</a></li>', "<article><p>{}</p></article>", '<div class="ad">{}</div>', "<td>{}</td>", "<section><p>{}</p><p>and so on</p></section>"]
    changed = 0
    for _ in range(120):
        page = "".join(rng.choice(wrap).format(" ".join("word" for _ in range(rng.choice([1, 2, 4, 9, 18, 35]))) + rng.choice(["", ".", "?"])) for _ in range(rng.randint(1, 8)))
        blocks = h.blocks_of(page)
        h.weigh(blocks)
        n = len(blocks)
        assert n <= 16

        def cost(side, blocks=blocks, n=n):
            own = sum(max(0, -b.odds) if s else max(0, b.odds) for b, s in zip(blocks, side))
            return own + sum(w for i in range(n) for j, w in blocks[i].edges.items() if i < j and side[i] != side[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        keep = h.label([b.odds for b in blocks], [b.edges for b in blocks])
        assert cost(keep) <= best + 1e-9 and h.extract(page) == "\n\n".join(b.text for b, k in zip(blocks, keep) if k)
        changed += sum((b.odds > 0) != k for b, k in zip(blocks, keep))
    assert changed > 20  # the cut decides, not the classifier alone


def test_cut_smooths_over_odd_blocks():
    from nodetide.llm import html_text as h

    long = "This is a sentence of a good length, as articles have them, and it goes on for a while until it ends here."
    page = f"<div><p>{long}</p><p>{long}</p><div>hm</div><p>{long}</p><p>{long}</p></div>"
    blocks = h.blocks_of(page)
    h.weigh(blocks)
    alone = [b.odds > 0 for b in blocks]
    assert h.extract(page).split("\n\n") == [b.text for b in blocks] and not all(alone)


def test_training_learns_shapes(spark):
    from nodetide.llm import html_text as h

    pages = [(i, "u", f"<article><p>{'word ' * 15}{i}.</p></article><footer><p>{'x ' * 30}{i}</p></footer>") for i in range(3000)]
    odds = h.train(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), 2)
    assert odds["ending"][1] > h.SHAPE_ODDS["ending"][1] and odds["words"][4] < h.SHAPE_ODDS["words"][4]
    assert all(abs(x) <= h.SHAPE_MOST for t in odds.values() for x in t)
    few = h.train(spark.createDataFrame(pages[:1], "page_id long, url string, html string"), 1)
    assert all(abs(a - b) < 1.2 for k in few for a, b in zip(few[k], h.shape_odds({})[k]))


def test_training_counts_every_page(spark):
    from nodetide.llm import html_text as h

    pages = [(i, "u", f"<article><p>{'word ' * (i % 60)}{i}.</p></article><footer><p>{'x ' * (i % 7)}{i}</p></footer>") for i in range(200)] + [(None, "u", None)]
    seen = {}
    for _, _, page in pages:
        for b in h.blocks_of(page or ""):
            said = b.element.good + b.element.bad
            if said < h.OUTSPOKEN[0] or said > h.OUTSPOKEN[1]:
                for k, x in enumerate(h.shape(b)):
                    seen[k, x, said > 0] = seen.get((k, x, said > 0), 0) + 1
    assert h.train(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)) == h.shape_odds(seen)
