"""Classifier, decontamination, vectors, pages and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from papyrine.llm import decontaminate, graph, html_text, quality, rp_forest
from papyrine.session import materialise


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i % 7] + [(100, 99), (99, 98), (5, 5), (200, 100), (200, 98), (200, 98)]
    got = dict(found(graph.components(spark.createDataFrame(edges, "u long, v long").repartition(4))))
    root = {x: x for e in edges for x in e if x != 5 or True}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {k: v for k, v in root.items()}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def labelled(n=160):
    rng = random.Random(2)
    good = ["the firm pays a tax on its trade", "growth of the market and its price", "we test the model on data of banks"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(good) for _ in range(rng.randint(1, 40)))
        bad = i % 4 == 0
        if bad:
            text = " ".join(w.upper() + "!!" if rng.random() < 0.7 else w + "$$$" for w in text.split())
        rows.append((i, text, "s"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled()
    odd = [(None, None, None), (1000, "", "s"), (1001, "é" * 5000, None), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, marks)
    got = quality.score(docs, net).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 15 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 200").collect()) == sorted(r.doc_id for r in got if r.predicted and r.doc_id is not None and r.doc_id < 200)
    empty = spark.createDataFrame([], docs.schema)
    assert quality.score(empty, quality.train(empty, marks)).collect() == []


def test_network_gradients_and_coverage():
    net = quality.ConvNet(3)
    for name in ("embed", "filters", "bias", "out", "shift"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [b"abc" * 300, b"", b"xyz!" * 40]
    symbols, counts = quality.chunks(texts)
    assert counts.tolist() == [2, 1, 1]
    labels = np.array([1.0, 0.0, 1.0])
    _, grads = net.gradients(symbols, counts, labels)
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads, strict=True):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p.shape)
            p[at] += 1e-6
            up = net.gradients(symbols, counts, labels)[0]
            p[at] -= 2e-6
            down = net.gradients(symbols, counts, labels)[0]
            p[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4
    # A text beyond one piece is scored in whole chunks: the same mean as all chunks at once.
    long = bytes(rng.integers(32, 120, 1_200_000, dtype=np.uint8))
    symbols, _ = quality.chunks([long])
    assert np.isclose(net.score([long])[0], 1 / (1 + np.exp(-net.chunk_odds(symbols).mean())), atol=1e-6)


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item):
        new = [j + 1]
        for i, d in enumerate(text):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
    return min(row)


def test_alignment_finds_every_part_within_the_budget():
    rng = random.Random(3)
    for trial in range(80):
        letters = "abcd " if trial % 2 else "abcdefghij klmnopqrst"
        item = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(30, 120))).split())
        if len(item) < 24:
            continue
        items = decontaminate.Items([7], [item])
        budget = int(0.08 * len(decontaminate.normalised(item.strip())[0]))
        part = list(item)
        for _ in range(rng.randint(0, budget + 2)):
            at, kind = rng.randrange(len(part)), rng.random()
            if kind < 0.34:
                part[at] = rng.choice(letters)
            elif kind < 0.67:
                part.insert(at, rng.choice(letters))
            else:
                del part[at]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) + "".join(part) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        least = brute_edits(item, "".join(map(chr, decontaminate.normalised(text)[0])))
        got = items.matches(["no", text, ""])
        assert bool(got) == (least <= budget)
        if got:
            assert min(g[4] for g in got) == least and got[0][0] == 1


ITEM = "Which of the following firms paid the largest tax in the year of the great market crash?"


def test_contaminated(spark):
    docs = spark.createDataFrame(
        [(1, f"Before.  {ITEM.upper()} After.", 1), (2, "Nothing of that kind is in here at all.", 2), (3, None, 3), (4, "", 4), (None, ITEM.replace(" ", "\n"), 5), (5, ITEM[:40], 6), (6, ITEM.replace("largest", "langest") + " " + ITEM, 7), (6, ITEM, 8)],
        "doc_id long, text string, item_id int",
    ).repartition(2)
    benchmark = spark.createDataFrame([(9, ITEM), (9, ITEM), (10, "short"), (11, None), (None, ITEM), (12, "A second item that nobody has copied anywhere, I hope.")], "item_id long, text string")
    for slices in (1 << 20, 60):
        got = found(decontaminate.contaminated(docs, benchmark, slices))
        assert sorted((r[0] or 0, r[1], r[4]) for r in got) == [(0, 9, 0), (1, 9, 0), (6, 9, 0), (6, 9, 0), (6, 9, 1)]
    one = next(r for r in got if r[0] == 1)
    assert f"Before.  {ITEM.upper()} After."[one[2] : one[3]] == ITEM.upper()
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    none = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.contaminated(docs, none).collect() == [] and decontaminate.keep_clean(docs, none).count() == 8


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    free = rng.normal(size=(400, 16))
    centre = rng.normal(size=16)
    cluster = centre / np.linalg.norm(centre) + rng.normal(size=(120, 16)) * 0.03
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([free, cluster]))]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, (np.array(rows[1][1]) * 1e200).tolist()), (1003, None), (1004, [0.0] * 16), (1005, [float("nan")] + [1.0] * 15), (1006, [None] + [1.0] * 15), (1007, [float("inf")] * 16), (1008, [1.0, 2.0]), (1009, [1.0, 2.0]), (1010, []), (1011, [-0.0] + [1.0] * 15), (1012, [0.0] + [1.0] * 15)]
    return rows


def brute_vectors(rows):
    links = {}
    for i, v in rows:
        links[i] = set()
        if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        for j, w in rows:
            if j != i and w and len(w) == len(v) and not any(c is None or not np.isfinite(c) for c in w) and any(w):
                a, b = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    links[i].add(j)
    root = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
        if new == root:
            break
        root = new
    return sorted(((i, len(links[i]), root[i], root[i] == i) for i, _ in rows), key=repr)


@pytest.mark.parametrize("block", [1024, 40])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = found(rp_forest.near_vectors(df))
    want = brute_vectors(rows)
    assert sum(r[1] for r in want) > 10000
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert [r[2] for r in got] == [r[2] for r in want]
    if block == 40:
        assert rp_forest.near_vectors(spark.createDataFrame([], df.schema)).collect() == []
        lone = rp_forest.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>"))
        assert found(lone) == [(4, 0, 4, True), (None, 0, None, None)]


PAGE = """<html><body class="home has-sidebar"><header class="site"><a href=/>Site</a> A long tagline of the site</header>
<div id="cookie-notice">We use cookies to make this site better for you.</div><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>First   paragraph with <a href=x>a link</a> and enough text to count.
<p>Second &mdash; para<b>graph</b> a < b.</p><div class="advert">Buy now</div><ul><li>one<li>two</ul><form><input>Sign up</form><script>x = "</p>";</script></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></ul></div></div>
<section id="comments"><p>A reader's long comment that goes on and on, longer than all of the article itself, to be dense indeed.</p></section>
<footer>Copyright</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more First paragraph with a link and enough text to count. Second — paragraph a < b. one two"
    assert html_text.main_text(PAGE) == want
    odd = {"": "", "plain": "plain", "<p>a<p>b": "a b", "<div><script>x</script></div>": "", "<!-- c --><p>x</p><!-- open": "x", '<p class="a>b': "b", "<article><h1>T</h1><p>x.</p></article>": "T x.", "<td>a<td>b": "a b", "<p>a&nbsp;&nbsp;b &#x41; &bogus;</p>": "a b A &bogus;"}
    for source, text in odd.items():
        assert html_text.main_text(source) == text, source
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (None, None, None, 1), (3, "v", "", 2), (4, "w", "<p>" + "long text " * 50000, 3)]
    got = found(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "u", len(want)), (1, "u", len(want)), (3, "v", 0), (4, "w", 499999), (None, None, 0)]


def test_pipeline_stages(spark, tmp_path):
    rows, labels = labelled()
    rng = random.Random(6)
    repeated = " ".join(str(rng.randrange(10**6)) for _ in range(60))
    plain = [(500 + i, f"{' '.join(str(rng.randrange(10**5)) for _ in range(80))} the firm pays a tax on its trade", "s") for i in range(4)]
    more = [(600, plain[0][1] + " x", "s"), (601, f"{plain[1][1][:100]} {repeated}", "s"), (602, f"{repeated} {plain[2][1][:90]}", "s"), (603, f"We ask: {ITEM}", "s")]
    docs = [(i, t, "en", s, len(t)) for i, t, s in [*rows, *plain, *more]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = materialise(stage(spark, df, str(tmp_path)), "stage")
        assert df.columns == columns
        seen.append({r.doc_id: r.text for r in df.collect()})
    assert all(i not in seen[0] for i, q, _ in labels if q == 0 and i % 8 == 0)
    assert (500 in seen[0]) <= (500 in seen[1] and 600 not in seen[1])
    assert all(repeated not in t for t in seen[2].values())
    assert 603 not in seen[3]
    final = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert final == set(seen[3])
    assert corpus_pipeline.packed(spark, df.limit(0), str(tmp_path)).collect() == []
