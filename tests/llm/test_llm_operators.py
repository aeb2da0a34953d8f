"""Operators against brute force, held-out accuracy and hand-made cases."""

import itertools
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lakesift.llm import chat, decontamination, html_extract, license_scan, line_dedup, mixing, ngram_join, toxicity, url_filters
from lakesift.llm.common import components, lowered, stable, token_hashes
from lakesift.llm.decontamination import words


def grams(text, n=3):
    w = words(text or "")[0]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_groups(rows, t=0.6, n=3):
    """{row: root} by comparing all pairs; rows are (id, text), root is the least place."""
    sets, parent = [grams(x, n) for _, x in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= (t - 1e-9) * len(a | b):
            p, q = sorted((find(i), find(j)))
            parent[q] = p
    return {i: find(i) for i in range(len(rows))}


def expected_groups(rows, t=0.6, n=3):
    root, out = jaccard_groups(rows, t, n), {}
    for i, r in root.items():
        out.setdefault(r, []).append(rows[i][0])
    return {frozenset(v) for v in out.values() if len(v) > 1}


def found_groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r._nj_group, set()).add(r._nj_id)
    return {frozenset(v) for v in out.values()}


def noisy_corpus(seed, n_base, copies, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(vocab[: rng.choice([30, vocabulary])]) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(rng.randint(1, copies)):
            text = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.02, 0.08, 0.2]) else w for w in base]
            text = text[: len(text) - rng.choice([0, 0, 0, len(text) // 4])]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,t,n", [(1, 0.6, 3), (2, 0.6, 3), (3, 0.8, 2), (4, 0.35, 1)])
def test_jaccard_join_is_exact(spark, seed, t, n):
    rows = noisy_corpus(seed, 40, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.groups(df, n=n, t=t)
    assert found_groups(found) == expected_groups(rows, t, n)
    assert {r._nj_id: r.n_links for r in found.collect()} == brute_links(rows, t, n)


def test_jaccard_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", -1)
    rows = noisy_corpus(5, 25, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(ngram_join.groups(df)) == expected_groups(rows)
    kept = {r.doc_id for r in ngram_join.drop_copies(df, max_broadcast=-1).collect()}
    assert kept == {rows[i][0] for i, r in jaccard_groups(rows).items() if i == r}


def test_jaccard_join_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    assert found_groups(ngram_join.groups(df)) == expected_groups(rows) != set()


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        p, q = sorted((find(i), find(j)))
        parent[q] = p
    return [find(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1, max_size=9), st.booleans(), st.integers(0, 1), st.integers(1, 4)), min_size=1, max_size=14), st.sampled_from([0.3, 0.5, 0.6, 0.8]))
def test_settle(points, t):
    """A tile, or two of them, against all pairs."""
    sets, home, tile, weight = zip(*points)
    apart, tile = len(set(tile)) == 2, tile if len(set(tile)) == 2 else (0,) * len(tile)
    table = pa.table({"lo": pa.array([0] * len(tile), pa.int32()), "hi": pa.array([int(apart)] * len(tile), pa.int32()), "key": pa.array(range(len(sets)), pa.int64()), "n": pa.array(weight, pa.int64()), "home": pa.array(home), "tile": pa.array(tile, pa.int32()), "grams": pa.array([np.array(sorted(s), np.uint64).tobytes() for s in sets], pa.binary())})
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (home[i] or home[j]) and (not apart or tile[i] != tile[j]) and len(sets[i] & sets[j]) >= (t - 1e-9) * len(sets[i] | sets[j])]
    got = ngram_join.settle(table, t).to_pylist()
    want = {}
    for i, j in pairs:
        want[i], want[j] = want.get(i, 0) + weight[j], want.get(j, 0) + weight[i]
    assert {r["key"]: r["links"] for r in got} == want
    assert roots(len(sets), [(r["key"], r["root"]) for r in got]) == roots(len(sets), pairs)


@pytest.mark.parametrize("block,grams", [(5, 4_000_000), (12, 4_000_000), (1000, 60)])
def test_large_clusters_are_cut_by_pivots(spark, monkeypatch, block, grams):
    """Groups far above BLOCK: pivots, balls, guests, tiles give the links and groups of all pairs."""
    for name, value in (("BLOCK", block), ("BLOCK_GRAMS", grams), ("PIVOTS", 3), ("LEVELS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    rows = noisy_corpus(7, 6, 4)
    chain = [f"c{k}" for k in range(400)]
    rows += [(1000 + k, " ".join(chain[3 * k : 3 * k + 30])) for k in range(60)]  # a long chain: neighbours are similar, ends are not
    base = [f"b{k}" for k in range(60)]
    rows += [(2000 + k, " ".join(w if rng.random() > 0.04 else f"x{rng.randrange(5)}" for w in base)) for k in range(60)]
    rows += [(3000, rows[-1][1]), (3001, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.groups(df)
    assert found_groups(found) == expected_groups(rows)
    assert {r._nj_id: r.n_links for r in found.collect()} == brute_links(rows)


def brute_links(rows, t=0.6, n=3):
    """{id: rows within the radius} of the rows that have any."""
    sets, out = [grams(x, n) for _, x in rows], {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= (t - 1e-9) * len(sets[i] | sets[j]):
            for k in (i, j):
                out[rows[k][0]] = out.get(rows[k][0], 0) + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sampled_from([0.35, 0.6, 0.8]))
def test_windows_meet(a, b, t):
    """Sets within the radius meet in their windows as often as _least_meetings says."""
    if len(a & b) < t * len(a | b):
        return
    def window(s):
        size = np.array([len(s)])
        keep = int(np.minimum(size, size - np.ceil(t * size - 1e-9).astype(int) + ngram_join._k(size, t))[0])
        return set(sorted(s)[:keep])

    assert len(window(a) & window(b)) >= int(ngram_join._least_meetings(np.array([len(a)]), np.array([len(b)]), t)[0])


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_tokens_are_as_in_the_pattern():
    texts = ["Hello, World!", "a b", "Straße—Ünï 12x", "", "。、ok"]
    hashes, firsts = token_hashes(lowered(pa.array(texts)))
    assert np.diff(firsts).tolist() == [len(words(t)[0]) for t in texts]
    assert hashes[0] == token_hashes(lowered(pa.array(["HELLO"])))[0][0]


def brute_decontaminate(rows, items, n=decontamination.N, least=decontamination.MIN_TOKENS, share=decontamination.MAX_SHARE):
    windows = set()
    for item in items:
        w = words(item or "")[0]
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if len(w) >= least else set())
    out = {}
    for i, text in rows:
        w, places = words(text or "")
        cut = [False] * len(w)
        for k in range(len(w)):
            for g in {len(x) for x in windows}:
                if tuple(w[k : k + g]) in windows and k + g <= len(w):
                    cut[k : k + g] = [True] * g
        if sum(cut) > share * len(w):
            continue
        out[i] = (sum(cut), None if text is None else " ".join(x for x, c in zip(w, cut) if not c))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, sf_dir, limit):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, items = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]
    leak = " ".join(words(items[0])[0])
    rows += [(10**6, f"Before it. {leak.upper()} And after it, there is quite a lot of other text. " + "More and more words follow here. " * 30), (10**6 + 1, leak), (10**6 + 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens_cut, None if r.text is None else " ".join(words(r.text)[0])) for r in decontamination.decontaminate(df, bench, max_broadcast=limit).collect()}
    want = brute_decontaminate(rows, items)
    assert got == want and 10**6 in got and 10**6 + 1 not in got


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(0)
    plain = [f"word{k}" for k in range(300)]
    bad = {"en": ["idiot", "scum", "moron"], "fr": ["crétin", "ordure"]}
    rows = []
    for k in range(700):
        lang = rng.choice(["en", "fr"])
        toxic = rng.random() < 0.25
        text = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad[lang]))
        rows.append((k, " ".join(text), lang, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.filter("doc_id < 500"), df.filter("doc_id < 500").select("doc_id", "toxic"))
    got = toxicity.score(df.filter("doc_id >= 500"), model).collect()
    hit = sum(r.is_toxic and r.toxic for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.9 * sum(bool(r.is_toxic) for r in got)
    assert set(model.thresholds) == {"en", "fr"}


def test_pooling_is_the_convolution():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.arange(50))
    model.emb = rng.normal(size=model.emb.shape).astype(np.float32)
    tokens, firsts = rng.integers(0, 51, (23, 3)), np.array([0, 1, 3, 10, 23])
    got = toxicity.pooled(model.tables(), model.shift, tokens, firsts)
    vectors = model.emb[tokens].sum(1)
    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:])):
        want = []
        for w, kernel in model.kernels.items():
            own = vectors[a:b] if b - a >= w else np.concatenate([vectors[a:b], np.zeros((w - (b - a), toxicity.DIM))])
            want += list(np.max([sum(own[k + o] @ kernel[o] for o in range(w)) for k in range(len(own) - w + 1)], axis=0))
        assert got[i] == pytest.approx(np.maximum(want, 0), abs=1e-4)


def test_html():
    page = """<html><head><title>T</title><script>var x="<p>no, no, no</p>"</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="ad">Buy this now, and that, and also that over there, quickly.</div><article><h1>Head</h1><p>First paragraph, which has commas, and is long enough to count &amp; score.<p>Second one, also with <a href=x>a link</a>, and <b>bold
text</b>, is long enough too.<br>Next line</article><div class=related><p>Read this as well, and this, it is long enough to count, surely.</p></div><footer>All, rights, reserved, and so on and on and on.</footer>"""
    text, n, score = html_extract.extract(page)
    assert text == "Head\nFirst paragraph, which has commas, and is long enough to count & score.\nSecond one, also with a link, and bold text, is long enough too. Next line" and n == 3 and score > 2
    assert html_extract.extract(None) == (None, 0, 0.0) and html_extract.extract("")[0] is None
    assert html_extract.extract("just a text, without any tags in it")[0] == "just a text, without any tags in it"
    assert html_extract.extract("<!-- never <p>closed")[0] is None
    links = "<body><div>" + "<p><a href=x>only links here, in a long paragraph of links</a></p>" * 5 + "</div><div><p>Some plain text, which is what the page is about, really.</p></div></body>"
    assert html_extract.extract(links)[0] == "Some plain text, which is what the page is about, really."


class Page(HTMLParser):
    """Elements as nested lists, from the standard library's events: [tag, hidden, parent, children], where children are elements and texts."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.now = ["#root", False, None, []]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK:
            at = self.now
            while at[2] and at[0] != "p" and at[0] not in html_extract.BLOCK:
                at = at[2]
            self.now = at[2] if at[0] == "p" else self.now
        same, limits = html_extract._CLOSES.get(tag, (None, ()))
        at = self.now
        while same and at[2] and at[0] not in (tag, same) and at[0] not in limits:
            at = at[2]
        if same and at[0] in (tag, same):
            self.now = at[2]
        if tag in ("br", "hr"):
            self.now[3].append(" ")
        bad = self.now[1] or tag in html_extract.HIDDEN or tag in html_extract.UNLIKELY or any(k in ("class", "id", "role") and html_extract._BAD.search(v or "") for k, v in attrs)
        new = [tag, bool(bad), self.now, []]
        self.now[3].append(new)
        if tag not in html_extract.VOID:
            self.now = new

    def handle_endtag(self, tag):
        at = self.now
        while at[2] and at[0] != tag:
            at = at[2]
        self.now = at[2] if at[0] == tag else self.now

    def handle_data(self, data):
        self.now[3].append(data)


def brute_extract(page):
    """The definition, element by element: every paragraph's points are handed to each of its ancestors in turn."""
    root, squeeze = Page(page).root, lambda x: re.sub(r"\s+", " ", x)
    elements, paragraphs, last = [], [], [None]

    def walk(node, ancestors, link):
        elements.append((node, ancestors))
        own = [n for n in [*ancestors, node] if n[0] in html_extract.BLOCK or n is root][-1]
        for child in node[3]:
            if isinstance(child, list):
                walk(child, [*ancestors, node], link or child[0] == "a")
            elif child and not node[1]:
                if last[0] is own:
                    paragraphs[-1][1].append((child, [*ancestors, node], link))
                else:
                    paragraphs.append((own, [(child, [*ancestors, node], link)]))
                last[0] = own

    walk(root, [], False)
    ups = {id(n): a for n, a in elements}
    points, chars, linked = {}, {}, {}
    for own, parts in paragraphs:
        text = squeeze("".join(squeeze(x) for x, _, _ in parts)).strip()
        for x, up, link in parts:
            for n in up:
                chars[id(n)] = chars.get(id(n), 0) + len(squeeze(x))
                linked[id(n)] = linked.get(id(n), 0) + link * len(squeeze(x))
        if len(text) >= html_extract.LEAST and (own[0] in html_extract.PARAGRAPH or own is root):
            gain = 1 + text.count(",") + text.count("、") + min(len(text) / html_extract.CHARS_POINT, html_extract.MAX_LENGTH_POINTS)
            for level, n in enumerate(reversed(ups[id(own)] or [root])):
                points[id(n)] = points.get(id(n), 0) + gain * 0.5**level
    density = lambda n: linked.get(id(n), 0) / chars[id(n)] if chars.get(id(n)) else 0.0
    score = lambda n: points.get(id(n), 0) * (1 - density(n))
    texts = [(own, squeeze("".join(squeeze(x) for x, _, _ in parts)).strip()) for own, parts in paragraphs]
    best, most = None, 0.0
    for n, up in elements:
        if score(n) > most + 1e-9 or (best is not None and abs(score(n) - most) <= 1e-9 and len(up) > len(ups[id(best)])):
            best, most = n, score(n)
    if best is None:
        return [t for _, t in texts if t], 0.0
    good = [best, *(n for n in (best[2][3] if best[2] else []) if isinstance(n, list) and n is not best and ((n[0] == "p" and chars.get(id(n), 0) >= html_extract.SIBLING_CHARS and density(n) < html_extract.SIBLING_LINKS) or score(n) >= max(1.0, html_extract.SIBLING_SHARE * most)))]
    inside = lambda n: any(g is m for g in good for m in [*ups[id(n)], n])
    return [t for own, t in texts if t and inside(own) and density(own) <= 0.5], most


def test_html_on_pages_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    deep = "<div>" * 30 + "<p>Deep down there is one paragraph, with commas, of which, as we see, it has more, and it is long enough.</p>" + "</div>" * 30
    pages += [(-1, f"<body>{deep}<div><p>Another one, which is shorter, is here, on its own.</p></div></body>"), (-2, '<body><p title="a > b, and <i>c</i> > d">Attributes with marks, in quotes, aren\'t text of any paragraph.</p></body>')]
    pages += [(-3, "<body><div><p>One, two, three, four, five, six and so on in a line.</p><p>it's here and it's there, isn't it, and so on</p></div><div class='x\"y' id=a>More of it, and more, and still more of it.</div></body>")]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    for k, page in pages:
        text, score = brute_extract(page)
        assert (got[k].main_text or "").split("\n") == text and got[k].score == pytest.approx(score), k
    assert all(r.main_text for r in got.values()) and not any("track(" in r.main_text for r in got.values())
    assert got[-2].main_text == "Attributes with marks, in quotes, aren't text of any paragraph."


def test_url_filter_propagates(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    rows = [(1, "http://bad-spam.example/a", link("bad-spam.example")), (2, "https://farm.example/a", link("bad-spam.example")), (3, "https://www.uni.edu/", link("good.example", "GOOD.example")), (4, "https://good.example/z", link("uni.edu")), (5, "http://alone.example", None), (6, None, link("bad-spam.example")), (7, "https://mixed.example", link("bad-spam.example", "a.example", "b.example", "c.example", "uni.edu"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filters.filter_pages(pages).collect()}
    assert set(got) == {3, 4, 5, 6} and got[4].trust > 0.1 and got[3].host == "uni.edu"


def rank_by_hand(edges, seeds, d=url_filters.DAMPING):
    """The limit, by solving the linear equations."""
    hosts = sorted({x for a, b, _ in edges for x in (a, b)} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        m[at[b], at[a]] += n / sum(x for y, _, x in edges if y == a)
    start = np.array([(1 - d) * (h in seeds) for h in hosts])
    rank = np.linalg.solve(np.eye(len(hosts)) - d * m, start)
    return {h: rank[k] for h, k in at.items() if rank[k] > 0}


@pytest.mark.parametrize("split", [100_000, 2])
def test_propagation_against_equations(spark, monkeypatch, split):
    """Both sides at once, ranks within the tolerance of the limit; a cycle, long chains, hosts that are split."""
    monkeypatch.setattr(url_filters, "SPLIT", split)
    rng = random.Random(2)
    pairs = {(rng.randrange(20), rng.randrange(20)) for _ in range(60)}
    edges = [(f"h{a}", f"h{b}", rng.randint(1, 4)) for a, b in pairs if a != b] + [(f"c{k}", f"c{(k + 1) % 30}", 1) for k in range(30)] + [("h1", "c0", 5)]
    table = spark.createDataFrame([("x", *e) for e in edges] + [("y", b, a, n) for a, b, n in edges], "side string, src string, dst string, n long")
    seeds = spark.createDataFrame([("x", "h1"), ("x", "h2"), ("x", "h2"), ("y", "c5")], "side string, host string")
    ranks, rounds = url_filters.propagate(table, seeds)
    got = {(r.side, r.host): r["rank"] for r in ranks.collect()}
    want = {("x", h): v for h, v in rank_by_hand(edges, ["h1", "h2"]).items()} | {("y", h): v for h, v in rank_by_hand([(b, a, n) for a, b, n in edges], ["c5"]).items()}
    assert rounds > 30 and {k for k, v in want.items() if v > 1e-3} <= set(got) <= set(want)
    assert all(want[k] - 1e-9 <= v + url_filters.TOLERANCE and v <= want[k] + 1e-9 for k, v in got.items())


def test_title_links(spark):
    nav = lambda *labels: "<title>Own page</title><ul>" + "".join(f'<li><a href="/x">{x}</a></li>' for x in labels) + "</ul>"
    rows = [(1, "http://a.example/1", nav("Big", "news")), (2, "http://a.example/2", nav("Big", "news")), (3, "http://b.example/", "<title>Big news today</title>"), (4, "http://b.example/2", "<title>Big news again</title>"),
            (5, "http://aa.example/", "<title>Big news of aa</title>"), (6, "http://c.example/", nav("Own")), (7, None, nav("Big")), (8, "http://d.example/", None)]
    rows += [(9 + k, f"http://z{k}.example/", "<title>Big news</title>") for k in range(4)]
    got = {(r.src, r.dst, r.n) for r in url_filters.title_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {("a.example", x, 2) for x in ("b.example", "aa.example", *(f"z{k}.example" for k in range(4)))} | {("c.example", "a.example", 1)}


@pytest.mark.parametrize("spread,split", [(10**9, 100_000), (2, 100_000), (-1, 100_000), (-1, 2)])
def test_title_links_reach_every_host(spark, monkeypatch, spread, split):
    """All hosts of a title, pairs written out, some of them or none; hosts that link to themselves, and h15 to no other; edges of the pages besides."""
    monkeypatch.setattr(url_filters, "SPREAD", spread)
    monkeypatch.setattr(url_filters, "SPLIT", split)
    rng = random.Random(7)
    words, told, titles, rows = ["Big", "news", "of"], [], [], []
    for k in range(70):
        told.append((f"h{rng.randrange(15)}", rng.choices(words, k=rng.randint(1, 2)) if k % 2 else []))
        titles.append((told[-1][0], rng.choices(words, k=3)))
    told, titles = [*told, ("h15", ["Own"])], [*titles, ("h15", ["Own", "page"])]
    for k, ((host, x), (_, t)) in enumerate(zip(told, titles, strict=True)):
        rows.append((k, f"http://{host}/{k}", f"<title>{' '.join(t)}</title>" + "".join(f'<li><a href="/x">{y}</a></li>' for y in x) + ('<a href="http://h3/">x</a>' if k % 20 == 0 else "")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = Counter()
    for k, (src, x) in enumerate(told):
        edges.update((src, dst) for dst in {h for h, t in titles if x and t[: len(x)] == x} - {src})
        edges.update([(src, "h3")] if k % 20 == 0 and src != "h3" else [])
    edges = [(a, b, n) for (a, b), n in edges.items()]
    links = url_filters.title_links(pages).collect()
    assert (sum(r.src.startswith("#") for r in links) > 0) == (spread < 10**9) and (sum(r.src[0] == r.dst[0] == "h" for r in links) > 0) == (spread > 0)
    seeds = lambda *x: spark.createDataFrame([(h,) for h in x], "host string")
    scores, rounds = url_filters.score_hosts(pages, trusted=seeds("h1", "h2"), blocked=seeds("h5"), links=spark.createDataFrame(links))
    got = {r.host: (r.trust, r.distrust) for r in scores.collect()}
    trust, distrust = rank_by_hand(edges, ["h1", "h2"]), rank_by_hand([(b, a, n) for a, b, n in edges], ["h5"])
    assert rounds and set(got) == {h for h, _ in titles} and got["h15"] == (0, 0)
    for h, (t, d) in got.items():
        assert abs(trust.get(h, 0) - t) <= url_filters.TOLERANCE and abs(distrust.get(h, 0) - d) <= url_filters.TOLERANCE


def test_mix_meets_the_schedule(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(rng.randint(5, 30))), rng.choice(["a", "a", "a", "b", "c"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("a", 0.0, 6.0), ("a", 0.5, 2.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 0.5, 1.0), ("c", 1.0, 3.0), ("b", 0.5, 1.0)], "source string, u double, weight double")
    got = mixing.mix(df, schedule).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and {r.doc_id for r in got} == set(range(3000))
    total = sum(r.n_tokens for r in got)
    for lo, hi in ((0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)):
        part = [r for r in got if lo <= r.position < hi]
        us = np.linspace(lo, hi, 1001)
        w = {"a": np.interp(us, [0, 0.5, 1], [6 / 7, 2 / 4, 0]), "b": np.interp(us, [0, 0.5, 1], [1 / 7, 1 / 4, 1 / 4]), "c": np.interp(us, [0, 0.5, 1], [0, 1 / 4, 3 / 4])}
        for s in "abc":
            assert sum(r.n_tokens for r in part if r.source == s) / total == pytest.approx(w[s].mean() * (hi - lo), abs=0.006)
    assert mixing.mix(df, schedule.filter("source <> 'a'")).filter("source = 'a'").count() == 0


def viterbi_by_hand(model, emitted):
    n = emitted.shape[1]
    best = max(itertools.product(range(n), repeat=len(emitted)), key=lambda p: model["first"][p[0]] + sum(emitted[k, s] for k, s in enumerate(p)) + sum(model["step"][a, b] for a, b in zip(p, p[1:])))
    return list(best)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    n = 2 * len(chat.ROLES)
    model = {"first": rng.normal(size=n), "step": rng.normal(size=(n, n))}
    lengths = [3, 0, 5, 1, 4]
    starts = np.r_[0, np.cumsum(lengths)]
    emitted = rng.normal(size=(starts[-1], n))
    got = chat.viterbi(model, emitted, starts)
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            assert got[a:b].tolist() == viterbi_by_hand(model, emitted[a:b])


def test_roles_are_recovered(spark, sf_dir):
    rows = {}
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    convs = list(rows.values())
    model = chat.train([tuple(zip(*c)) for c in convs[::2]])
    good = total = 0
    for c in convs[1::2]:
        lines = chat.lines_of([None] * len(c), [x for _, x in c])
        truth = [r for r, x in c for _ in chat.lines_of([None], [x])]
        states = chat.viterbi(model, chat.emissions(model, np.array([x[0] for x in lines]), np.array([x[1] for x in lines])), np.array([0, len(lines)]))
        good += sum(chat.ROLES[s // 2] == t for s, t in zip(states, truth))
        total += len(truth)
    assert good / total > 0.9


def test_markers_and_rendering(spark):
    text = "Human: What is it?\n\nAI: A thing.\nIt is red.\nHuman: <|end|> thanks"
    df = spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")
    known = spark.createDataFrame([(k, t, r, x) for k in range(30) for t, (r, x) in enumerate([("user", "What is it?"), ("assistant", "A thing.\nIt is red."), ("user", "Thanks.")])], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, chat.fit(known)).first()
    assert r.chat == "<|user|>\nWhat is it?<|end|>\n<|assistant|>\nA thing.\nIt is red.<|end|>\n<|user|>\n< |end|> thanks<|end|>\n"


def brute_licences(text):
    """{licence: (first place, places)} of notices, word by word."""
    w, out = words(text or "")[0], {}
    short = {k: x.split() for k, x in license_scan.UNVERSIONED.items()}
    forms = [x.split() for (x, *_) in license_scan.TEMPLATES.values()] + list(short.values())
    for name, *parts in [*((k, *v) for k, v in license_scan.TEMPLATES.items()), *((k, v) for k, v in license_scan.UNVERSIONED.items())]:
        spots, gaps, gap = [], [], False
        for p in parts:
            if p == "...":
                gap = True
                continue
            spots.append(([k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()], len(p.split())))
            gaps.append(gap)
        for start in spots[0][0]:
            at = spots[0][1]
            ok = name not in short or not any(len(f) > len(short[name]) and f[: len(short[name])] == short[name] and w[start : start + len(f)] == f for f in forms)
            for (more, size), free in zip(spots[1:], gaps[1:]):
                ok &= any(start + at <= q and (free or q <= start + at + license_scan.SLACK) for q in more)
                at += size
            if ok:
                first, n = out.get(name, (start, 0))
                out[name] = (min(first, start), n + 1)
    return out


def test_licences_against_brute_force(spark, sf_dir):
    rng = random.Random(0)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fill = ["the", "of", "license", "public", "version", "software", "gnu", "general", "2", "3"]
    for k in range(300):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(fill) for _ in range(rng.randint(0, 20))]
            for p in license_scan.TEMPLATES[rng.choice(list(license_scan.TEMPLATES))]:
                text += [rng.choice(fill) for _ in range(rng.choice([0, 100, 260, 3000]))] if p == "..." else p.split() if rng.random() < 0.9 else p.split()[1:]
                text += [rng.choice(fill)] * rng.choice([0, 0, 1, 3, 20])
        rows.append((10**6 + k, " ".join(text)))
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if not r.license.endswith("-text"):
            got.setdefault(r.doc_id, {})[r.license] = (r.first_token, r.n_places)
    want = {i: f for i, t in rows if (f := brute_licences(t))}
    assert got == want and len({x for v in want.values() for x in v}) > 12


def brute_text(w, name, counts):
    """Places of a whole text: for every place that an anchor predicts, all anchors are looked for."""
    own, keys = words(license_scan.texts()[name][0])[0], license_scan.PHRASES[name]
    at = [min(range(k, min(k + license_scan.SEGMENT, len(own))), key=lambda i: (counts[own[i]], i)) for k in range(0, len(own), license_scan.SEGMENT)]
    drift, out = license_scan.SLACK + len(own) // 10, []
    spots = {x: [k for k, y in enumerate(w) if y == x] for x in {own[i] for i in at}}
    for p in sorted({q - i for i in at for q in spots[own[i]]}):
        agree = sum(any(p <= q - i <= p + drift for q in spots[own[i]]) for i in at)
        keyed = all(any(w[q : q + len(k.split())] == k.split() for q in range(max(0, p - drift), p + len(own) + drift + 1)) for k in keys)
        if agree >= license_scan.MIN_SHARE * len(at) and keyed and (not out or p > out[-1] + len(own)):
            out.append(p)
    return [max(0, p) for p in out]


def test_whole_licence_texts_against_brute_force(spark):
    rng = random.Random(3)
    full, rows = license_scan.texts(), []
    names = [n for n in full if len(full[n][0]) < 12000]
    assert len(full) > 12 and len(names) > 7
    for k, name in enumerate(names * 5):
        own = words(full[name][0])[0]
        damage = rng.choice([0, 0.02, 0.1, 0.2])
        own = [x if rng.random() >= damage else "changed" for x in own]
        own[len(own) // 2 : len(own) // 2] = ["inserted"] * rng.choice([0, 5, 60])
        rows.append((k, " ".join(["before"] * rng.choice([0, 7]) + own + ["between"] * 3 + own * rng.choice([0, 1]) + ["the", "copyright", "software"] * 5)))
    rows.append((1000, " ".join(w for n in names for w in words(full[n][0])[0][:60])))
    counts = {}
    for _, t in rows:
        for x in set(words(t)[0]):
            counts[x] = counts.get(x, 0) + 1
    counts = {x: counts.get(x, 0) for t, _ in full.values() for x in words(t)[0]}
    got = {i: {} for i, _ in rows}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.license.endswith("-text"):
            got[r.doc_id][r.license[:-5]] = (r.first_token, r.n_places)
    want = {i: {n: (p[0], len(p)) for n in full if (p := brute_text(words(t)[0], n, counts))} for i, t in rows}
    assert got == want and sum(n in want[k] for k, n in enumerate(names * 5)) > 2 * len(names) and not want[1000]


def test_line_dedup_without_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, line_dedup.drop_lines(docs, min_pages=2, min_on=2).collect()))
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", -1)
    assert one == sorted(map(tuple, line_dedup.drop_lines(docs, min_pages=2, min_on=2).collect()))


def test_pipeline_against_brute_force(spark, duck, sf_dir):
    """SQL for the first two stages and the last, all pairs and all windows for the others."""
    from lakesift.llm import quality_rules

    duck.execute(f"CREATE OR REPLACE TEMP TABLE t1 AS SELECT doc_id, lang, source, text FROM ({quality_rules.CLEANED_SQL.replace('{docs}', 'documents')})")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE t2 AS SELECT doc_id, source, text FROM ({line_dedup.DROPPED_SQL.replace('{docs}', 't1')})")
    rows = sorted(duck.execute("SELECT doc_id, text FROM t2").fetchall())
    kept = [rows[i] for i, r in jaccard_groups(rows).items() if i == r]
    items = [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()]
    want = brute_decontaminate(kept, items)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: " ".join(words(r.text)[0]) for r in got} == {i: t for i, (_, t) in want.items()}
    final = [(r.doc_id, r.source, r.text) for r in got if r.epoch == 0]
    duck.execute("CREATE OR REPLACE TEMP TABLE t4 (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO t4 VALUES (?, ?, ?)", final)
    mixed = duck.execute(f"SELECT doc_id, epoch, round(position, 9), n_tokens FROM ({mixing.MIXED_SQL.replace('{docs}', 't4').replace('{columns}', '')})").fetchall()
    assert sorted((r.doc_id, r.epoch, round(r.position, 6), r.n_tokens) for r in got) == sorted((a, b, round(c, 6), d) for a, b, c, d in mixed)
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_scans_are_not_copied(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stable(docs) is docs
    ordered = docs.orderBy("doc_id")
    assert stable(ordered) is not ordered
