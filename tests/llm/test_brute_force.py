"""Operators without SQL against plain versions of themselves."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from photonlake.llm import ann, decontaminate, html, jaccard, lattice, mixing, quality, substring, url_filter, warc
from photonlake.llm.text import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def smith_waterman(a, b):
    best, before = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        now = [0.0]
        for j, y in enumerate(b):
            s = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            now.append(max(0.0, before[j] + s, before[j + 1] + decontaminate.GAP, now[j] + decontaminate.GAP))
            best = max(best, now[-1])
        before = now
    return best


def test_alignment_is_smith_waterman(spark):
    r = np.random.default_rng(1)
    say = lambda n, of=60: [f"w{k}" for k in r.integers(0, of, n)]
    for _ in range(40):
        a, b = say(int(r.integers(1, 20)), 6), say(int(r.integers(1, 40)), 6)
        code = lambda x: np.array([[int(t[1:]) + 1 for t in x]], np.uint64)
        assert abs(decontaminate.align(code(a), code(b), np.array([len(a)]))[0] - smith_waterman(a, b)) < 1e-9
    items = [(i, say(12, 400)) for i in range(20)] + [(20, ["solo"]), (21, ["two", "more"]), (22, [])]
    docs = []
    for i in range(120):
        words = say(30, 400)
        item = items[int(r.integers(0, 22))][1]
        copy = [t if r.random() > 0.15 else "edited" for t in item]
        docs.append((i, words[:15] + (copy if i % 2 else []) + words[15:]))
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contamination(frame(spark, [(i, " ".join(w)) for i, w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    want = {}
    for i, text in docs:
        for j, item in items:
            k = min(decontaminate.N, len(item))
            seeds = {tuple(item[a : a + k]) for a in range(len(item) - k + 1)} & {tuple(text[a : a + k]) for a in range(len(text) - k + 1)} if k else set()
            if seeds and (s := smith_waterman(item, text) / len(item)) >= decontaminate.THRESHOLD:
                want[i, j] = s
    assert len(want) > 40 and {20, 21} <= {j for _, j in want}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_dedup(rows):
    """Texts without sentences that a repeated run covers; rows are (doc_id, row hash, text)."""
    found, parts = {}, {}
    for key in rows:
        text = key[2]
        words = [m for m in WORD.finditer(text)]
        hashes = Words([text.encode()]).hash.tolist()
        low = [m[0].translate({i: i + 32 for i in range(65, 91)}) for m in words]
        ends = set()
        for a in range(len(words) - substring.REACH + 1):
            window = hashes[a : a + substring.REACH]
            ends |= {a + k for k, h in enumerate(window) if h == min(window)}
        ends |= {k for k, m in enumerate(words) if m[0][-1] in ".!?" or k + 1 == len(words) or re.search(r"[\r\n]", text[m.end() : words[k + 1].start()])}
        cuts = [0] + [k + 1 for k in sorted(ends)]
        parts[key] = (words, cuts)
        for i in range(len(cuts) - 1):
            for j in range(i + substring.SENTENCES, len(cuts)):
                if cuts[j] - cuts[i] >= substring.WORDS:
                    found.setdefault(tuple(low[cuts[i] : cuts[j]]), []).append((key[:2], i, j))
                    break
    gone = {key[:2]: set() for key in rows}
    for places in found.values():
        first = min((k[0], k[1], i) for k, i, _ in places)
        for k, i, j in places:
            if (k[0], k[1], i) != first:
                gone[k] |= set(range(i, j))
    out = {}
    for key, (words, cuts) in parts.items():
        at = [0] + [words[c].start() for c in cuts[1:-1]] + [len(key[2])]
        out[key[:2]] = "".join(key[2][at[i] : at[i + 1]] for i in range(len(cuts) - 1) if i not in gone[key[:2]]) if words else key[2]
    return out


def test_substring_dedup_is_exact(spark):
    r = np.random.default_rng(2)
    say = lambda n: " ".join("Abcd"[int(r.integers(0, 4)) :] + f"{k}" + r.choice(["", "", "", "", "", ".", "!", "\n"]) for k in r.integers(0, 4000, n))
    passages = [say(70) for _ in range(5)]
    rows = [(i, f"{say(int(r.integers(1, 60)))} {passages[i % 5].upper() if i % 7 == 0 else passages[i % 5]} {say(30)} {passages[(i + 1) % 5][20:-40] if i % 3 else ''}") for i in range(40)]
    rows += [(100, passages[0] + " " + passages[0]), (101, ""), (102, " \n "), (103, "a " * 90)]
    docs = frame(spark, rows)
    key = {x.doc_id: x.h for x in docs.selectExpr("doc_id", "xxhash64(doc_id, text) as h").collect()}
    want = plain_dedup([(i, key[i], t) for i, t in rows])
    got = {x.doc_id: x.text for x in substring.substring_dedup(docs).collect()}
    assert got == {i: want[i, key[i]] for i, _ in rows}
    assert sum(got[i] != t for i, t in rows) > 30


def test_lattice_scores(spark):
    r = np.random.default_rng(3)
    words = ["the", "Cat", "sat", "mats", "unbelievable", "ßtraße", "x" * 90, "qzv", "emoji😀"]
    rows = [(i, " ".join(r.choice(words, int(r.integers(0, 9))))) for i in range(30)] + [(40, None), (41, "never seen " + "y" * 80)]
    import pyspark.sql.functions as F

    got = {x.doc_id: x for x in lattice.lm_scores(frame(spark, rows), F.col("doc_id") < 25).collect()}
    tokens = {i: [t.translate({k: k + 32 for k in range(65, 91)}) for t in WORD.findall(t or "")] + [None] for i, t in rows}
    c = Counter(t for i, ts in tokens.items() if i < 25 for t in ts)
    n, v = sum(c.values()), len(c)
    counts = lattice.word_counts(frame(spark, rows).selectExpr("doc_id < 25 as train", "text"))
    model, end = lattice.fit(counts, 25)
    piece = {p: math.exp(w) for p, w in zip(model.names, model.weights)}
    assert abs(sum(piece.values()) + math.exp(end) / (1 - math.exp(end)) * sum(w for p, w in piece.items() if p[:1] == b" ") - 1) < 1e-9

    def over_all(word):
        total = [1.0] + [0.0] * len(word)
        for i in range(len(word)):
            for p, w in piece.items():
                if word.startswith(p, i):
                    total[i + len(p)] += total[i] * w
        return total[-1]

    paths = {t: over_all(b" " + t.encode()) if t is not None else math.exp(end) for ts in tokens.values() for t in ts}
    for i, ts in tokens.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ts), sum(t in c for t in ts), n)
        assert abs(x.base_score - sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) < 1e-9
        assert abs(x.score - sum(math.log10((c[t] + v * paths[t]) / (n + v)) for t in ts)) < 1e-6


def test_wide_words_add_expectations():
    names = [b" a", b" ab", b"a", b"b", b"ab", b" ", b"x" * 30] + [bytes([i]) for i in range(33, 97)]
    model = lattice.Lattice(names, np.log(np.full(len(names), 1 / len(names))))
    for width in (lattice.WIDE - 2, lattice.WIDE, lattice.WIDE + 2):
        word = b"ab" * (width // 2)
        a, b = np.zeros(len(names)), np.zeros(len(names))
        assert abs(model.forward_one(b" " + word, 3.0, a) - model.words([word], np.array([3.0]), b)[0]) < 1e-9
        assert np.allclose(a, b) and a.sum() > 3


def test_ftrl_against_a_plain_loop():
    r = np.random.default_rng(4)
    rows = [(int(r.integers(0, 2)), *np.unique(r.integers(0, 16, int(r.integers(0, 9))), return_counts=True)) for _ in range(60)]
    w, bias = quality.ftrl(rows, bits=4)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for y, ids, counts in rows:
            x = {int(i): c / math.sqrt(max(1, sum(counts))) for i, c in zip(ids, counts)} | {"bias": 1.0}
            now = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(now[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * now[i]
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(16)]) and abs(bias - weight("bias")) < 1e-9


def test_quality_is_learnt_and_takes_one_text_a_label(spark):
    r = np.random.default_rng(5)
    good = lambda: " ".join(r.choice(["rain", "falls", "on", "the", "green", "hills", "and", "rivers"], 30)) + "."
    bad = lambda: " ".join(r.choice(["$$$", "win", "now!!", "click", "rain", "the"], 30))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(None, good()), (1, bad()), (1, bad())]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, None), (None, 1), (8, 5), (9999, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = quality.train(docs, labels)
    out = {x.doc_id: x.score for x in quality.score(docs, model, ["doc_id"]).where("doc_id >= 300").collect()}
    assert np.mean([(s >= 0.5) == bool(i % 2) for i, s in out.items()]) > 0.97
    again = quality.train(docs.repartition(5), labels.unionByName(labels))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    w, bias = quality.train(docs, labels.limit(0))
    assert not w.any() and bias == 0
    clash = docs.selectExpr("*", "1 as _text", "2.0 as score", "3 as _TEXT_")
    assert quality.score(clash, model, clash.columns, out="p").columns == [*clash.columns, "p"]


def test_neighbours_are_ranked_and_scored(spark):
    r = np.random.default_rng(6)
    x = r.integers(-3, 4, (120, 6)).astype(np.float32)
    x[(x == 0).all(axis=1)] = 1
    rows = [(i, v.tolist(), 7, 8) for i, v in enumerate(x)]
    short = [(1000 + i, v[:4].tolist(), 7, 8) for i, v in enumerate(x[:60]) if v[:4].any()]
    rows += short + [(0, rows[0][1], 7, 8), (500, [1.0, None], 7, 8), (None, [1.0], 7, 8), (520, [], 7, 8), (540, [float("inf")] * 6, 7, 8), (2000, [5.0] * 3, 7, 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, v int")).collect()
    want = []
    for group in ([(i, v) for i, v in enumerate(x)], [(i, np.array(v, np.float32)) for i, v, *_ in short]):
        for q, v in group:
            if q % 20 == 0:
                near = sorted((-float(v.astype(float) @ u.astype(float)), i) for i, u in group if i != q)[:20]
                want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in got) == sorted(want)


@pytest.mark.parametrize("n", [400, 760, 900, 6000])
def test_recall_at_every_size(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    q = np.arange(0, n, 20)
    sims = x[q].astype(float) @ x.T.astype(float)
    sims[np.arange(len(q)), q] = -np.inf
    best = {(int(i), int(j)) for i, row in zip(q, sims) for j in np.argsort(-row)[:20]}
    assert len(got) == 20 * len(q) and len({(g.query_id, g.vec_id) for g in got} & best) / len(best) >= 0.9


PAGES = {
    # a blog in divs, with comments and a side column
    "<html><body><div class='masthead'><a href='/'>Site</a></div><div class='post'><h2>On rain</h2><div>It rained for days, and then it stopped.</div><p>We went out. The hills were green &mdash; greener than ever.</p></div><div class='comments'><div class='comment'><p>Nice post, thank you.</p></div></div><div class='sidebar'><ul><li><a href='/a'>Old</a></li><li><a href='/b'>Older</a></li></ul></div></body></html>": "On rain\nIt rained for days, and then it stopped.\nWe went out. The hills were green — greener than ever.",
    # upper-case tags, unquoted attributes, unclosed paragraphs
    "<HTML><BODY><NAV><A HREF=/>Home</A> <A HREF=/x>More</A></NAV><ARTICLE><H1>News of the day</H1><P>First, a sentence that says a thing.<P>Second, another one that says more.</ARTICLE><FOOTER>&copy; 2020 all rights</FOOTER></BODY></HTML>": "News of the day\nFirst, a sentence that says a thing.\nSecond, another one that says more.",
    # an article with a table, a list, code, and an advert inside
    "<main><article><h1>Guide</h1><p>Follow these steps, please.</p><ul><li>Open the box, slowly.</li><li>Close it again.</li></ul><div class='ad'>Buy now! Cheap boxes.</div><pre>x  =  1</pre><p>Done, that was all of it.</p></article></main><aside class='related'><a href='/1'>One</a><a href='/2'>Two</a></aside>": "Guide\nFollow these steps, please.\nOpen the box, slowly.\nClose it again.\nx = 1\nDone, that was all of it.",
    # mathematics, drawings and character references inside
    "<article><p>Let <math><mi>x</mi></math> be 3 &lt; 4 &#x41;, as in <svg><text>figure one</text></svg>, which is below.</p><script>var a = '<p>no</p>';</script><p>Nothing else is there, then.</p></article>": "Let x be 3 < 4 A, as in figure one, which is below.\nNothing else is there, then.",
}


def test_pages_of_several_styles(spark):
    assert html.extract(list(PAGES), html.trained()) == list(PAGES.values())
    rows = [(1, "u", page, 5) for page in PAGES] * 2 + [(None, None, None, 5), (2, "u", "", 5)]
    got = [(x.text, x.n_chars) for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    assert sorted(got) == sorted([(t, len(t)) for t in PAGES.values()] * 2 + [("", 0)] * 2)


def test_hostile_pages_take_seconds():
    import time

    start = time.time()
    for part, n in (("<div></x>", 40_000), ("<a x='\"", 100_000), ("<button>", 100_000), ("<a x=\"'>", 60_000), ("<!--", 100_000), ("<b><table></b>", 20_000), ("<", 300_000)):
        html.extract([part * n], html.trained())
    assert time.time() - start < 60


def test_text_without_article_elements():
    pages = html.training_pages(150, seed=77)
    model = html.trained()
    wrong = total = 0
    for p in pages:
        p = re.sub(r"<(/?)(article|main)\b", r"<\1div", p)
        nodes = html.parse(p)
        label = html.decode(nodes, model.margin(np.array(html.features(nodes), float)))
        wrong += sum(a != b for a, b in zip(label, html._truth(p)))
        total += len(nodes)
    assert wrong / total < 0.05


def test_url_model_and_awkward_urls(spark):
    r = np.random.default_rng(8)
    urls = [f"http://s{k}.com/{'/'.join(r.choice(['rain', 'hill', 'river'], 2))}" for k in range(120)] + [f"http://t{k}.net/es/{'/'.join(r.choice(['xxx', 'zzz9', 'qqq'], 2))}" for k in range(120)]
    new = ["http://a.org/rain/river", "http://b.org/hill/rain", "http://c.org/xxx/qqq", "http://d.org/zzz9/xxx", None, "", "http://e.org/rain/river"]
    rows = [(i, u, "r", 1.0) for i, u in enumerate(urls + new)] + [(None, "http://a.org/rain/river", "r", 1.0)] * 2
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, rule string, score double")).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got}
    assert [by[240 + i].verdict for i in range(4)] == ["allow", "allow", "block", "block"] and by[244].host == "" and by[246].verdict == "allow"
    assert {x.verdict for x in got if x.page_id is None} == {"allow"}


def test_awkward_records(spark):
    pages = spark.createDataFrame([(None, f"u{i % 3}", "<p>x</p>", 1) for i in range(12)] + [(5, "u", None, 1), (5, "u", None, 1), (6, None, "<b>", 1), (7, "v", "<b>y</b>", 1)], "page_id long, url string, html string, digest int")
    whole = warc.layout(pages)
    assert whole.count() == 16 and whole.where("file < 0").count() == 12
    assert warc.audit(whole, warc.layout(pages)).count() == 0
    import pyspark.sql.functions as F

    other = warc.layout(pages.withColumn("html", F.when(F.col("page_id") == 7, "<b>z</b>").otherwise(F.col("html")))).where("record is null or record <> 6")
    assert sorted((x.record, x.status) for x in warc.audit(whole, other).collect()) == [(6, "missing"), (7, "altered")]


def test_one_page_id_and_one_record_may_be_most_of_all(spark, monkeypatch):
    rows = [(9, f"u{i}", "<p>x</p>") for i in range(600)] + [(9, "u", "same")] * 50 + [(None, None, None)] * 30 + [(i * 5000, "v", "y" * (i % 7)) for i in range(-300, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(warc.layout(pages).collect(), key=repr)
    monkeypatch.setattr(warc, "COPIES", 4)
    assert sorted(warc.layout(pages).collect(), key=repr) == want and len(want) == len(rows)
    files: dict = {}
    for x in want:
        files.setdefault(x.file, []).append(x)
    for of in files.values():  # end to end, in order of page_id, then digest
        of.sort(key=lambda x: x.offset)
        assert [x.offset for x in of] == [sum(y.length for y in of[:i]) for i in range(len(of))]
        assert of == sorted(of, key=lambda x: (x.record is not None, x.record or 0, x.digest, x.offset))
    hot = [sum(x.record == 9 for x in of) for of in files.values()]
    assert max(hot) < 70 and len({x.file for x in want if x.record is None}) == 1
    assert sorted(len({x.offset for x in of}) for of in files.values()) == sorted(map(len, files.values()))


def test_one_source_and_one_row_may_be_most_of_all(spark):
    rows = [(1, "w " * 40, "a")] * 300 + [(i, "w " * (i % 9), "a") for i in range(300)] + [(i, "", None) for i in range(50)] + [(i, "one two", "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard=500).collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 3 * x.size for x in got)
    for s in ("a", "b"):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 0.02 * mine[0].target + mixing.BLOCK
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7), shard=500).collect()), key=repr)


def test_common_shingles(spark, monkeypatch):
    r = np.random.default_rng(9)
    line = "one line that stands in every text there is"
    rows = [(i, f"{line} " + " ".join(f"q{k}" for k in r.integers(0, 9000, 30))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(50)] + [(2000 + i, rows[0][1]) for i in range(100)]
    want = {i: (i if i < 1000 else i - 1000 if i < 2000 else 0) for i, _ in rows}
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "LIKELY", 8)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(frame(spark, rows)).collect()} == want


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, then all of them."""
    r = np.random.default_rng(10)
    good = lambda n: " ".join(f"{w}{k}" for w, k in zip(r.choice(["rain", "hill", "river", "green"], n), r.integers(0, 3000, n))) + "."
    junk = lambda: " ".join(r.choice(["$$$", "win!!", "click", "now"], 40))
    passage, item = good(60), good(30)
    rows = [(i, good(80), "fr", "abc"[i % 3]) for i in range(60)] + [(100 + i, junk(), "en", "a") for i in range(60)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "b") for i in range(5)] + [(300 + i, f"{good(40)} {passage} {good(40)}", "en", "c") for i in range(4)]
    rows += [(400, f"{good(40)} {item} {good(40)}", None, "a"), (None, good(50), None, None), (None, None, None, None), (60, "", "en", "a")]
    docs = spark.createDataFrame([(i, t, x, s, len(t or ""), 1, 2.0) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows if i is not None and i < 160], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "the rain")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stages[name](spark, df, str(tmp_path))
    ids = lambda df: sorted((x.doc_id if x.doc_id is not None else -1) for x in df.collect())
    every = [i if i is not None else -1 for i, *_ in rows]

    kept = step("quality classifier", docs)
    assert kept.columns == docs.columns and not set(ids(kept)) & set(range(100, 160))
    assert set(every) - set(range(100, 160)) - {60, -1} <= set(ids(kept))
    one = step("n-gram Jaccard join", docs)
    assert one.columns == docs.columns and ids(one) == sorted(i for i in every if not 200 <= i < 300)
    cut = step("substring dedup", docs)
    key = {(x.doc_id, x.text): x.h for x in docs.selectExpr("*", "xxhash64(doc_id, text) as h").collect()}
    want = plain_dedup([(-1 if i is None else i, key[i, t], t or "") for i, t, *_ in rows])
    assert cut.columns == docs.columns and sorted((x.doc_id or -1, x.text or "") for x in cut.collect()) == sorted((i or -1, t) for (i, _), t in want.items())
    clean = step("benchmark decontamination", docs)
    assert clean.columns == docs.columns and ids(clean) == sorted(i for i in every if i != 400)
    mixed = step("source mixing", docs).collect()
    assert len(mixed) == len(rows) and sum(x.size for x in mixed) == sum(len(WORD.findall(t or "")) for _, t, *_ in rows)

    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(out) & (set(range(100, 160)) | set(range(200, 205)) | {400}) and set(range(60)) | set(range(300, 304)) <= set(out)
    assert out[300].size > out[301].size + 20
    assert ids(step("n-gram Jaccard join", docs.limit(0))) == [] and ids(step("quality classifier", docs.limit(0))) == []
