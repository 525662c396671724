"""Operators against brute force, and on awkward rows: nulls, empty and repeated ones, clashing columns."""

import re

import numpy as np
import pytest

from photonlake.llm import ann, decontaminate, html, jaccard, lattice, mixing, quality, substring, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or ""), 1.0, 5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    r = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    base = " ".join(r.choice(vocabulary, 60))
    rows = [(None, None, None), (1, "", "a"), (2, "one two", "a"), (2, "one two", "a"), (3, "One  two", None), (4, base, "b"), (5, base.upper(), "b"), (6, base + " tail.", "b"), (7, " ".join(r.choice(vocabulary, 5000)), "c"), (None, "lost words here", "a")]
    return docs_of(spark, rows + [(i, " ".join(r.choice(vocabulary, 30)), "abc"[i % 3]) for i in range(10, 40)])


def test_jaccard_is_exact(spark):
    r = np.random.default_rng(1)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in r.integers(0, 60, r.integers(0, 6)):
            w[j] = f"x{r.integers(0, 4)}"
        rows.append((i, " ".join(w), "s"))
    df = docs_of(spark, rows)
    got = {x.doc_id: x for x in jaccard.jaccard_components(df).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _ in rows]
    up = list(range(150))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(150):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert [(got[i].n_shingles, got[i].component_id) for i in range(150)] == [(len(sets[i]), root(i)) for i in range(150)]


def test_divide_skip():
    r = np.random.default_rng(2)
    q = np.unique(r.integers(0, 200, 80)).astype(np.int64)
    sets = [np.unique(r.integers(0, 200, 80)).astype(np.int64) for _ in range(50)]
    need = [int(r.integers(1, 40)) for _ in sets]
    assert jaccard.divide_skip(q, sets, need) == [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= need[i]]


def test_awkward_documents(spark, awkward):
    n = awkward.count()
    found = {(x.doc_id, x.n_shingles): x.component_id for x in jaccard.jaccard_components(awkward).collect()}
    assert found[(1, 0)] == 1 and found[(3, 1)] == 2 and found[(5, 56)] == 4
    mixed = mixing.mix(awkward).collect()
    assert len(mixed) == n and all(x.taken <= 3 * x.size for x in mixed)
    cut = substring.substring_dedup(awkward)
    assert cut.count() == n and cut.columns[:7] == awkward.columns
    model = (np.zeros(1 << quality.BITS), 0.0)
    assert quality.score(awkward, model, ["doc_id"]).where("score = 0.5").count() == n
    import pyspark.sql.functions as F

    scored = lattice.lm_scores(awkward, F.col("doc_id") > 3).collect()
    assert len(scored) == n and all(np.isfinite(x.score) and x.score < 0 for x in scored)
    items = spark.createDataFrame([(1, awkward.where("doc_id = 4").first().text), (2, None), (None, "x"), (3, "a")], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.contamination(awkward, items).collect()} == {4, 5, 6}
    assert decontaminate.decontaminated(awkward, items).count() == n - 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert substring.substring_dedup(none).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.url_filter(pages).count() == 0 and html.main_text(pages).count() == 0
    assert warc.audit(warc.layout(pages), warc.layout(pages)).count() == 0


def test_mixing_targets(spark):
    df = docs_of(spark, [(i, "w " * (i % 7 + 1), s) for i in range(300) for s in ["abc"[i % 3] if i % 50 else None]])
    rows = mixing.mix(df).collect()
    for s in {x.source for x in rows}:
        mine = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= mixing.BLOCK
    assert sorted(rows) == sorted(mixing.mix(df).collect()) if all(x.source for x in rows) else True


def test_passages_and_edits(spark):
    r = np.random.default_rng(3)
    say = lambda n: ". ".join(" ".join(f"q{k}" for k in r.integers(0, 5000, 8)) for _ in range(n)) + ". "
    passage = say(9)
    rows = [(i, say(6) + (passage if i < 5 else "") + say(6), "s") for i in range(20)]
    got = {x.doc_id: x for x in substring.substring_dedup(docs_of(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == rows[i][1] for i in range(5, 20))
    assert all(got[i]._words_cut >= 60 for i in range(1, 5))
    words = passage.split()
    for j in range(3, len(words), 9):
        words[j] = "edited"
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.contamination(docs_of(spark, rows), items).collect()} == {0, 1, 2, 3, 4}


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, k=5).collect()
    sims = x[::20].astype(float) @ x.T.astype(float)
    sims[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-sims, axis=1)[:, :5]
    hits = sum(g.vec_id in best[g.query_id // 20] for g in got)
    assert len(got) == 750 and hits / 750 >= 0.9


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.COM/en/a?b#c", "http://a.example.com/en/x", "http://x.net/es/1", "http://y.org/de/", "http://example.com"]
    got = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[3].rule == "example.com/en/" and got[4].verdict == "block" and got[0].host == "" and got[6].rule is None
    assert all(x.verdict in ("allow", "block") for x in got.values())


def test_pages():
    page = "<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it</div><article><h1>Title &amp; more</h1><p>One  sentence here,\nand more.</p><p><b>Two<br><p>Three.</p></article><section class='comments'><p>I think so.</p></section><footer>&copy; x</footer></body>"
    assert html.extract([page, None, ""], html.trained()) == ["Title & more\nOne sentence here, and more.\nTwo\nThree.", "", ""]
    wrong = total = 0
    for p in html.training_pages(60, seed=123):
        nodes = html.parse(p)
        label = html.decode(nodes, html.trained().margin(np.array(html.features(nodes), float)))
        wrong += sum(a != b for a, b in zip(label, html._truth(p)))
        total += len(nodes)
    assert wrong / total < 0.02


def test_lattice_is_the_sum_over_segmentations():
    names = [b" a", b" ab", b"a", b"b", b"ab", b" ", b"c"]
    model = lattice.Lattice(names, np.log(np.full(len(names), 1 / len(names))))

    def brute(word):
        return 1.0 if not word else sum(brute(word[len(p) :]) / len(names) for p in names if word.startswith(p))

    words = [b"ab", b"abab", b"c", b"a" * 70]
    got = model.words(words)
    assert np.allclose(got[:3], [np.log(brute(b" " + w)) for w in words[:3]])
    assert np.isfinite(got[3])


def test_words_are_ascii_runs():
    from photonlake.llm.text import Words

    text = "Ab c d\x0be f  G"
    w = Words([text.encode(), b"", b"x"])
    assert w.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", text)), 0, 1]


def test_edited_and_partial_copies(spark):
    r = np.random.default_rng(6)
    say = lambda n: [f"q{k}" for k in r.integers(0, 50_000, n)]
    items, rows = [], []
    for i in range(60):
        words = say(40 + i % 21)
        copy = list(words)
        if i % 3 == 2:
            copy = words[: len(words) // 2 + 1]
        else:
            for j in r.choice(len(words), len(words) * (25 + 5 * (i % 3)) // 100, replace=False):
                copy[j] = f"edited{j}"
        items.append((i, " ".join(words)))
        rows.append((i, " ".join(say(50) + copy + say(50)), "s"))
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for (i, item), (_, text, _) in zip(items, rows):
        a, b = (np.array([[hash(x) & (2**62 - 1) for x in t.split()]], np.uint64) for t in (item, text))
        score = decontaminate.align(a, b, np.array([a.shape[1]]))[0] / a.shape[1]
        # without a run of three words left there is no seed
        runs = {tuple(item.split()[k : k + 3]) for k in range(a.shape[1] - 2)} & {tuple(text.split()[k : k + 3]) for k in range(b.shape[1] - 2)}
        if score >= decontaminate.THRESHOLD and runs:
            want[(i, i)] = score
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tail_of_a_long_item(spark):
    r = np.random.default_rng(7)
    words = [f"q{k}" for k in r.integers(0, 50_000, 259)]
    say = lambda n: [f"z{k}" for k in r.integers(0, 50_000, n)]
    texts = [say(40) + words[-3:] + say(40), say(40) + words[:140] + say(40), words]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {x.doc_id: x.score for x in decontaminate.contamination(docs_of(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)]), items).collect()}
    assert {i: round(x, 9) for i, x in got.items()} == {1: 1, 2: 1}


def test_passages_in_mid_sentence(spark):
    r = np.random.default_rng(9)
    say = lambda n: " ".join(f"q{k}" for k in r.integers(0, 50_000, n))
    rows, passages = [], [say(51 + i % 10) for i in range(60)]
    for i, p in enumerate(passages):
        rows += [(i, f"{say(40)} {p} {say(40)}", "s"), (1000 + i, f"{say(33)}. {say(9)} {p} {say(7)}. {say(30)}", "s"), (2000 + i, f"{say(120)}. {say(20)}.", "s")]
    got = {x.doc_id: x for x in substring.substring_dedup(docs_of(spark, rows)).collect()}
    assert all(got[i].text == t for i, t, _ in rows if i < 1000 or i >= 2000)
    cut = [got[1000 + i]._words_cut for i in range(60)]
    assert min(cut) >= 20 and np.mean(cut) >= 45 and all(n <= len(p.split()) for n, p in zip(cut, passages))


@pytest.mark.parametrize("noise", [0, 0.001])
def test_neighbours_of_a_hot_vector(spark, noise):
    r = np.random.default_rng(10)
    x = r.normal(size=(9000, 32))
    x[r.permutation(9000)[:3000]] = x[0] + noise * r.normal(size=(3000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=60, k=20).collect()
    q = np.arange(0, 9000, 60)
    sims = ann.products(np.repeat(x[q].astype(float), 9000, 0), np.tile(x.astype(float), (len(q), 1))).reshape(len(q), 9000)
    sims[np.arange(len(q)), q] = -np.inf
    best = {(int(i), int(j)) for i, row in zip(q, sims) for j in np.lexsort((np.arange(9000), -row))[:20]}
    hot = set(q[(sims > 0.99).sum(axis=1) > 1000].tolist())
    found = {(g.query_id, g.vec_id) for g in got} & best
    assert len(hot) > 20 and len(found) / len(best) >= 0.9
    assert sum(i in hot for i, _ in found) / (20 * len(hot)) >= 0.95


def test_share_of_siblings_on_long_pages():
    nodes = html.parse("<body><div>" + "<p>Some text.</p>" * 398 + "<h2>Title</h2><div>Buy it</div></div></body>")
    at = [i for i, x in enumerate(nodes) if x.tag == "h2"] + [i for i, x in enumerate(nodes) if x.tag == "p"][:1]
    rows = html.features(nodes)
    assert [rows[i][15] for i in at] == [400, 400] and [rows[i][16] for i in at] == [1 / 400, 398 / 400]
