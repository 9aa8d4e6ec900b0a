import numpy as np
import pytest

from feedloom.llm import ann, pivots, wrapper
from feedloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def best(x, ids, q, k):
    score = x @ x[q]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), score[j]) for j in order]


def vectors(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) * rng.uniform(0.5, 3, size=(n, 1))
    x[50:250] = x[40]  # a third are one vector
    return x.astype(np.float32).astype(float)


def test_exact_search(spark):
    x = vectors()
    y = np.floor(256 * x)
    rows = [*x, None, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, np.zeros(16)]
    got = {}
    for r in pivots.search(frame(spark, rows).repartition(5)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, ids = np.vstack([y, np.zeros(16)]), np.array([*range(600), 604])
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        assert [(v, s) for _, v, s in sorted(found)] == [(v, int(s)) for v, s in best(y, ids, q, 5)]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]


def test_approximate_search(spark, sf_dir):
    x = vectors(1200)
    rows = [*x, None, [None] * 16, [float("nan")] * 16, np.zeros(16)]
    got = {}
    for r in ann.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, hit = np.arange(1200), 0
    assert sorted(got) == list(range(0, 1200, 20))
    for q, found in got.items():
        want = best(x, ids, q, 20)
        hit += len({v for _, v, _ in found} & {v for v, _ in want})
        assert all(s == pytest.approx(float(x[v] @ x[q]), abs=1e-9) for _, v, s in found)
        assert sorted(found) == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((v, s) for _, v, s in found), key=lambda p: (-p[1], p[0])))]
    assert hit >= 0.9 * 20 * len(got)
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    x = np.stack([table[i] for i in ids])
    found = QUERIES["op1_multiprobe_lsh"](spark, sf_dir).collect()
    queries = [q for q in range(len(ids)) if ids[q] % 20 == 0]
    want = {(int(ids[q]), v) for q in queries for v, _ in best(x, ids, q, 20)}
    assert len(want & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(want)


def test_searches_of_few_vectors(spark):
    for search in (ann.search, pivots.search):
        assert search(frame(spark, [])).count() == 0
        assert search(frame(spark, [[1, 2]], [100])).count() == 0
        two = search(frame(spark, [[1, 2], [3, 4], [3, 4], [9]], [100, 7, 7, 8])).collect()
        assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(100, 1, 7)]


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(5)
    one_hot = np.eye(64)[np.arange(320) % 64] * (1 + np.arange(320) // 64)[:, None]
    coarse = rng.integers(-1, 2, (900, 6)).astype(float)
    signs = np.sign(rng.normal(size=(400, 64)))
    for x in (one_hot, coarse, signs):
        ids = rng.permutation(len(x))
        x[ids == 100] = 0  # a query for which all scores are equal
        got = {}
        for r in pivots.search(frame(spark, x, ids.tolist()).repartition(3)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert sorted(got) == list(range(0, len(x), 50))
        for q in np.flatnonzero(ids % 50 == 0):
            assert [v for _, v in sorted(got[ids[q]])] == [v for v, _ in best(np.floor(256 * x), ids, q, 5)]


def test_best_of_a_block_and_repeated_rows(spark):
    import pandas as pd

    from feedloom.llm import vectors as V

    n = 300
    x, q = np.ones((n, 3)), np.array([[1.0, 1, 1]])
    x[:, 2] += np.arange(n) * 1e-18
    items = pd.DataFrame({"members": [[i] for i in range(n)][::-1]})
    scores = q @ x.T + np.random.default_rng(1).normal(size=(1, n)) * 1e-16  # rounded differently
    found = V.best_members(items, pd.DataFrame({"qid": [7]}), scores, lambda r, cols: np.rint((x[cols] * q[r]).sum(1)), 21, 1e-14)
    assert found["ids"][0].tolist() == list(range(21))
    rows = [[1.0, 2.0]] * 60 + [[3.0, 1.0]] * 40
    ids = [0] * 30 + list(range(1, 31)) + [100] * 25 + list(range(101, 116))
    for search, k in ((pivots.search, 5), (ann.search, 20)):
        got = {}
        for r in search(frame(spark, rows, ids)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert [v for _, v in sorted(got[100])] == ([*range(101, 106)] if k == 5 else [*range(101, 116), *range(0, 5)])


def test_exact_search_takes_bounded_parts(spark, monkeypatch):
    """Visits leave a task in short batches, and a full block is scored in little memory."""
    import tracemalloc

    import pandas as pd

    classic, search, scores = type(spark.range(1)), pivots.V.block_search, []
    for name in ("mapInPandas", "mapInArrow"):
        def bounded(self, run, schema, inner=getattr(classic, name)):
            def checked(batches):
                for out in run(batches):
                    assert len(out) <= 4096, f"{len(out)} rows at once"
                    yield out

            return inner(self, checked, schema)

        monkeypatch.setattr(classic, name, bounded)
    monkeypatch.setattr(pivots, "ANNULUS_ROWS", 1)
    monkeypatch.setattr(pivots.V, "block_search", lambda items, queries, on, score, schema: scores.append(score) or search(items, queries, on, score, schema))
    x = np.random.default_rng(9).normal(size=(500, 24)).astype(np.float32).astype(float)
    got = {}
    for r in pivots.search(frame(spark, x).coalesce(1), every=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, ids = np.floor(256 * x), np.arange(500)
    assert all([(v, s) for _, v, s in sorted(got[q])] == [(v, int(s)) for v, s in best(y, ids, q, 5)] for q in range(500))
    n = 4096
    y = np.random.default_rng(1).integers(-256, 256, (n, 24)).astype(float)
    left = pd.DataFrame({"cid": range(n), "vec": [*y], "members": [[i] for i in range(n)], "d": np.linspace(0, 9, n)})
    right = pd.DataFrame({"qid": range(n), "vec": [*y], "bound": np.inf, "least": -np.inf, "own": 0.0})
    tracemalloc.start()
    found = scores[0](left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and peak < 100 << 20
    q = int(found["qid"][77])
    assert [*found["ids"][77]] == [v for v, _ in sorted(enumerate(y @ y[q]), key=lambda p: (-p[1], p[0]))[:6]]


# ---- Pages


def text(page):
    tree = wrapper.parse(page)
    return wrapper.main_text(tree, wrapper.numbered(tree), set(), {})


def test_blocks_and_references():
    assert text("<html><body><article><h1>A &amp; B</h1><p>one\n two<p>three<br>four &#233;&eacute; &am</article></body></html>") == "A & B\none two\nthree four éé &am"
    assert text("<article><p>x <b>bold <i>both</b> rest</i><ul><li>a<li>b</ul>tail</article>") == "x bold both rest\na\nb\ntail"
    assert text('<p title="a > b">kept</p><!-- <p>not</p> --><script>var t="</p><p>no";</script><style>p{}</style><textarea><p>no</textarea>') == "kept"
    assert text("") == "" and text("<<<") == "<<<" and text("<article></article>") == ""


def test_other_parts():
    page = """<body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
    <div id="sidebar">Side</div><article class="post"><header><h1>Title</h1></header><p>Body text.</p><form><p>Sign up</p></form>
    <div class="ad">Buy</div><div class="share"><a>Tweet</a></div><p><a href="/more">only links</a></p>
    <section class="comments"><article><p>I agree</p></article></section></article><aside><p>More</p></aside><footer>c</footer></body>"""
    assert text(page) == "Title\nBody text."


def test_alignment_is_best():
    a = wrapper.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul><p>y</p><div class=n><p>z</p></div></div>")
    b = wrapper.parse("<div><p>q</p><p>y</p><div class=n><h1>t</h1><p>z</p></div></div>")
    one, two = wrapper.numbered(a), wrapper.numbered(b)
    pairs = {(one[i].label, one[i].text, two[j].text) for i, j in wrapper.align(a, b).items()}
    assert ("p", "y", "y") in pairs and ("p", "z", "z") in pairs and ("p", "x", "q") in pairs

    def size(x, y):  # the definition, without a table
        if x.label != y.label:
            return 0
        def rest(i, j):
            if i == len(x.children) or j == len(y.children):
                return 0
            w = size(x.children[i], y.children[j])
            return max(rest(i + 1, j), rest(i, j + 1), w and w + rest(i + 1, j + 1))
        same = x.text is not None and x.text == y.text and not (x.children and y.children)
        return (2 if same else 1) + rest(0, 0)

    found = wrapper.align(a, b)
    assert sum(2 if one[i].text is not None and one[i].text == two[j].text else 1 for i, j in found.items()) == size(a, b)


def test_hosts_learn_their_template(spark):
    rows = []
    for k in range(24):
        rows.append((k, f"http://plain.example/{k}", f"<div><div class=x><p>Welcome to our site</p></div><div class=y><p>Story {k} begins in a {'far ' * (k % 5)}place</p>"
                     f"<p>and goes on {k * 7}</p></div><div class=z><p>All rights kept</p><p>{'Seen on stage' if k % 2 else 'Buy one now'}</p></div></div>"))
    rows += [(100, None, "<p>alone</p>"), (101, "no url", None), (102, "http://other.example", ""), (3, "http://plain.example/3", rows[3][2])]
    rows.append((103, "http://deep.example/", "<div>" * 3000 + "<p>down here</p>"))
    got = {}
    for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(24):
        assert got[k] == [f"Story {k} begins in a {'far ' * (k % 5)}place\nand goes on {k * 7}"] * (2 if k == 3 else 1)
    assert got[100] == ["alone"] and got[101] == [""] and got[102] == [""] and got[103] == ["down here"]
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_query(spark, sf_dir):
    rows = QUERIES["op5_wrapper_induction"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "\n" not in r.text.split("\n")[0]
        assert r.text and all(block in " ".join(__import__("html").unescape(pages[r.page_id]).split()) for block in r.text.split("\n"))
