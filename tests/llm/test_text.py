import collections
import random
import zlib

import numpy as np
import pytest

from krigmesh.llm.decontaminate import Myers, contaminated, cut, drop_contaminated, fold
from krigmesh.llm.html_extract import blocks, extract, main_text
from krigmesh.llm.quality import Logistic, calibrates, content_features, fit_quality, ranking_quality, score_quality
from krigmesh.llm.toxicity import drop_toxic, fit_logistic, packed, score_documents


def distance(pattern, text):
    """Least edits of pattern against any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        d, k = distance(p, t), rng.randint(0, 30)
        got = Myers(p).best(t, k)
        assert (got is None) == (d > k) and (got is None or got[0] == d)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        how = rng.randrange(3)
        if how == 0:
            s[i] = rng.choice("xyz")
        elif how == 1:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [sentence(20) for _ in range(8)] + ["short", None, "", "what is it"]
    items.append(items[0].upper() + "!")
    texts = [None, "", " \n", items[0], sentence(3000), "a Short one", "shorter, ashort", "short", "so: What is it?", "what is its"]
    for k in range(30):
        it = items[k % 8]
        texts.append(sentence(rng.randint(0, 60)) + ". " + edited(rng, it, k % 12) + "\n" + sentence(rng.randint(0, 60)))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(spark, docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            p = fold(it)
            if p and len(p) < 40:
                if f" {p} " in f" {fold(t)} ":
                    want[i, j] = 0
            elif p and (d := distance(p, fold(t))) <= int(0.06 * len(p)):
                want[i, j] = d
    assert got == want and any(d > 0 for d in got.values())
    small = {(r.doc_id, r.item_id): r.distance for r in contaminated(spark, docs, bench, item_bytes=100).collect()}
    assert small == want
    left = drop_contaminated(spark, docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert contaminated(spark, docs.limit(0), bench).count() == 0 and contaminated(spark, docs, bench.limit(0)).count() == 0


def test_pieces_cover_an_item():
    assert "".join(p for _, p in cut("abcdefghij" * 9, 4)) == "abcdefghij" * 9


def page(body, nav="<nav><ul><li>Home<li>News</ul></nav>", tail="<footer>&copy; us</footer>"):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>{nav}<!-- ad --><div class="ad">Buy</div>{body}{tail}</body></html>'


CASES = [
    (page("<article><h1>T &amp; U</h1><p><b>One<br><p>Two\n  three</p><p>a<i>b</i> c</article>"), "T & U\nOne\nTwo three\nab c"),
    (page("<article><p>x</p><section class='comments'><p>me</p></section><aside>s</aside><form>f<input></form><p>y</article>"), "x\ny"),
    (page("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></main>"), "a\nb\nc\nd\ne"),
    (page("<div id='content'><p>text one</p><p>text &lt;two&gt; &#233;</p></div>"), "text one\ntext <two> é"),
    ("<article><p>cut &am", "cut &am"), ("<p>plain<p", "plain"), ("no tags  at\nall", "no tags at all"), (None, ""), ("", ""), ("<article></article>", ""),
    ("<body class='has-sidebar'><article><p>x</p></article></body>", "x"), ("<body class='home no-sidebar'><p>x</p></body>", "x"),
    ("<article class='post comments-open'><p>main text</p></article>", "main text"), ("<article><p class='ad-free'>z</p><div class='related-work'>y</div></article>", "z\ny"),
    ("<article><p>text <button>Share</button> more</p></article>", "text more"), ('<article><p>text <span class="advert">Buy now</span> more</p></article>', "text more"),
    ('<article><p>a</p><ins class="adsbygoogle">AD</ins><p>b <label>l</label><noscript>n</noscript></p></article>', "a\nb"),
    ("<div class='widget'><article><p>in</p></article></div><div class='comments-area'><article class='comment-body'><p>c</p></article></div>", "in"),
    ("<div class='sidebar-left'>s</div><div class='topBanner'>t</div><p>x", "x"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" + "w " * 200_000, "w " * 199_999 + "w"),
    ('<article><p title="a > b">q</p><P CLASS=x>r</P></article>', "q\nr"), ("<article><p>a<br>b<script>x</article>", "a b"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_main_text(html, want):
    assert main_text(blocks(html), frozenset()) == want


def test_style_tree_drops_what_a_site_repeats(spark):
    rng = random.Random(8)
    body = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(20))
    rows = [(i, f"https://h.example/{i}", f"<html><body><div class='top7'>Always the same</div><div class='txt'><p>{body()}</p><p>{body()}</p></div><div class='rail'><ul><li>x<li>y</ul></div></body></html>") for i in range(30)]
    rows += [(100, "https://other.example/1", "<body><div class='top7'>Always the same</div><p>k</body>"), (101, None, None), (102, "bad url", ""), (None, "https://h.example/9", "<p>z")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r.text for r in extract(spark, pages).collect()}
    assert all(got[i].count("\n") == 1 and "same" not in got[i] for i in range(30))
    assert got[100] == "Always the same\nk" and got[101] == "" and got[102] == "" and got[None] == "z"
    assert all(r.n_chars == len(r.text) for r in extract(spark, pages).collect())
    assert extract(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_style_tree_reaches_into_the_main_part(spark, tag):
    rng = random.Random(9)
    body = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(20))
    rows = [(i, f"https://h.example/{i}", f"<body><{tag}><h1>t {i}</h1><p>{body()}</p><div><p>Same on every page</p></div><ul><li>x<li>y</ul><p>The last p is always this</p></{tag}></body>") for i in range(30)]
    rows += [(200, "https://h.example/0", rows[0][2])]  # a repeated row
    rows += [(100, "https://other.example/1", rows[0][2])]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i].startswith(f"t {i}\n") and got[i].count("\n") == 1 for i in range(30))
    assert got[100].endswith("Same on every page\nx\ny\nThe last p is always this") and got[200] == got[0]  # one page tells nothing


def test_names_and_the_tree_decide_together(spark):
    rng = random.Random(10)
    body = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(20))
    page = lambda i: f"<body class='no-sidebar'><article><p>{body()}</p><div class='related-work'><p>{body()}</p></div><div class='promo-strip'><p>offer {i % 2}</p></div><div class='strip'><p>offer {i % 2}</p></div></article></body>"
    pages = spark.createDataFrame([(i, "https://h.example/", page(i)) for i in range(40)], "page_id bigint, url string, html string")
    for r in extract(spark, pages).collect():
        parts = r.text.split("\n")
        assert len(parts) == 3 and parts[2] == f"offer {r.page_id % 2}"  # the hinted strip goes, the plain one and the work stay


def brute_tree(pages):
    """Paths to remove, by plain nested loops over the host's pages; paths are tuples of (label, place)."""
    seen = collections.defaultdict(lambda: collections.defaultdict(lambda: ([], [])))
    for html in set(pages):
        root, _ = blocks(html)

        def walk(node, path, page):
            own = list(node.texts)
            for c in node.children:
                same = [x for x in node.children if x.label == c.label]
                place = "first" if same[0] is c else "last" if same[-1] is c else ""
                own += walk(c, (*path, (c.label, place)), page)
            if own and path:
                short = [c.label for i, c in enumerate(node.children) if not i or node.children[i - 1].label != c.label]
                seen[path][page][0].append(own)
                seen[path][page][1].append(short)
            return own

        walk(root, (), html)
    low = set()
    for path, by in seen.items():
        n, share = len(by) + 2, []
        for k in (0, 1):
            c = np.array([*collections.Counter(str(v[k]) for v in by.values()).values()])
            share.append((np.log(n) - (c * np.log(c)).sum() / n) / np.log(n))
        if 1 - (1 - share[0]) * (1 - share[1]) < 0.2:
            low.add(path)
    return low


def test_the_tree_equals_plain_loops(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh"])
    part = lambda: rng.choice(["<div class='x'><p>same</p><p>and this</p></div>", "<ul><li>one<li>two</ul>", f"<p>{word()} {word()} {word()} {word()}</p>", f"<div><p>{word()}{rng.random()}</p></div>"])
    pages = [f"<body><article><h2>{i}</h2>{''.join(part() for _ in range(rng.randint(1, 5)))}<p>always</p></article></body>" for i in range(60)]
    low = brute_tree(pages)
    changed = 0
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")).collect()}
    for i, p in enumerate(pages):
        def path(node):
            if node.parent is None:
                return ()
            same = [x for x in node.parent.children if x.label == node.label]
            return (*path(node.parent), (node.label, "first" if same[0] is node else "last" if same[-1] is node else ""))

        kept = [b.text for b in blocks(p)[1] if not any(path(b.node)[:k] in low for k in range(1, len(path(b.node)) + 1))]
        assert got[i] == "\n".join(kept)
        changed += len(kept) < len(blocks(p)[1])
    assert changed > 30


def labelled_texts(n=600, seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["on", "er", "th", "an", "re", "ti"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moron", "scum", "idiot"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(9000, None, "en", 0.1), (9001, "", "en", 0.1), (None, "nice", "en", 0.1)], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = score_documents(spark, docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in by.values())
    held = [(by[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.97
    left = drop_toxic(spark, docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, r in by.items() if not r.predicted}


def brute_toxicity(rows, least_z=3.0):
    """Scores by n-gram sets of plain loops; rows: key, text, label or None."""
    mask = (1 << 32) - 1

    def places(text):
        code, out = [ord(c) for c in f" {(text or '').lower()} "], set()
        for n in (3, 4, 5):
            for i in range(len(code) - n + 1):
                h = code[i] * 0x9E3779B1 & mask
                for k in range(2, n + 1):
                    h = (h * 0x85EBCA6B + code[i + k - 1] * 0xC2B2AE35 + k) & mask
                h = (h ^ h >> 15) * 0x2C1B3C6D & mask
                out.add((h ^ h >> 12) >> 12)
        return out

    own = [(places(t), y) for k, t, y in rows if y is not None and zlib.crc32(str(k).encode()) % 5]
    n1, n0 = sum(y for _, y in own), sum(1 - y for _, y in own)
    p, q = collections.Counter(x for s, y in own if y for x in s), collections.Counter(x for s, y in own if not y for x in s)
    ratio = {x: np.log((p[x] + 1) / (n1 + 2)) - np.log((q[x] + 1) / (n0 + 2)) for x in {*p, *q}}
    chosen = sorted(x for x, r in ratio.items() if abs(r) / (1 / (p[x] + 1) + 1 / (q[x] + 1)) ** 0.5 >= least_z)
    index, scale = {x: i for i, x in enumerate(chosen)}, np.array([ratio[x] for x in chosen])
    w, b = fit_logistic(packed([np.array(sorted(index[x] for x in s if x in index), "<u2") for s, _ in own]), np.array([y for _, y in own], float), scale, 1e-6)
    return {k: 1 / (1 + np.exp(-(b + sum(w[index[x]] * scale[index[x]] for x in places(t) if x in index)))) for k, t, _ in rows}


def test_toxicity_equals_brute_force(spark):
    rows = [*labelled_texts(300, seed=4), (5000, None, None), (5001, "", 0), (5002, "moron " * 30_000, None)]
    rows += [(6000, rows[0][1], 0), (6001, rows[0][1], None)]
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if y is not None], "doc_id bigint, toxic int")
    rows += [rows[1]] * 2  # repeated rows count each
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    got, want = score_documents(spark, docs, labels).collect(), brute_toxicity(rows)
    assert len(got) == len(rows)
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-9


@pytest.mark.parametrize("n", [200, 10_000])
def test_toxicity_fit_ends_by_its_gradient_at_any_size(n):
    rng = np.random.default_rng(3)
    y = (rng.random(n) < 0.1).astype(float)
    scale = np.linspace(-2, 2, 400)
    rows = [np.flatnonzero(rng.random(400) < np.where(scale > 0, 0.02 + 0.02 * v, 0.03 - 0.01 * v)).astype("<u2") for v in y]
    w, b = fit_logistic(packed(rows), y, scale, 1e-6)
    heavy = np.where(y > 0, ((n - y.sum()) / y.sum()) ** 0.5, 1.0)
    x = np.zeros((n, 400))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    d = heavy * (1 / (1 + np.exp(-(x @ w + b))) - y) / n
    assert np.hypot(np.linalg.norm(x.T @ d + 1e-6 * w), d.sum()) <= 0.01
    with pytest.warns(RuntimeWarning, match="gradient norm"):
        fit_logistic(packed(rows), y, scale, 1e-6, rounds=1)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in score_documents(spark, docs, labels).collect()] == [0, 0]
    assert score_documents(spark, docs.limit(0), labels).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    base = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(spark, docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a", 3), (2, None, None), (None, "", 1)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.keep for r in score_quality(spark, docs, none).collect()] == [True] * 3
    two = spark.createDataFrame([(3, 0), (2, 1), (1, 1)], "doc_id bigint, quality int")
    many = spark.createDataFrame([(i, "ok words here" if i % 2 else "### ***", 1) for i in range(1, 40)], "doc_id bigint, text string, n_chars int")
    assert score_quality(spark, many, two).count() == 39
    assert score_quality(spark, docs.limit(0), none).count() == 0


def test_quality_equals_plain_loops(spark):
    """Co-training over all rows in memory, with plain sorts for the surest rows and dictionaries for the means."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["on", "er", "th", "an"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        text = " ".join(word() for _ in range(rng.randint(5, 40)))
        text = text if good != (rng.random() < 0.1) else text.upper().replace(" ", " ## ")
        docs.append((i, text, rng.choice(["en", "de"]), "a" if good == (rng.random() < 0.8) else "b", len(text) if i % 50 else None))
        if i % 2:
            labels.append((i, int(good)))
    docs += [(900, None, None, None, None), (901, "", "en", "a", 0), (docs[8])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    feats, co = fit_quality(spark, frame, spark.createDataFrame(labels, "doc_id bigint, quality int"), rounds=3)
    info = {r.doc_id: (r.h, r.c) for r in frame.selectExpr("doc_id", "xxhash64(doc_id) h").withColumn("c", calibrates()).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    lab = {i: q for i, q in labels if not held(i)}
    learn = [d for d in docs if d[0] in lab and not info[d[0]][1]]
    rate = sum(lab[d[0]] for d in learn) / len(learn)
    size = lambda d: float(np.log1p(max(d[4] or 0, 0)))
    keys = [lambda d: d[3] or "", lambda d: d[2] or "", lambda d: int(size(d)), lambda d: (d[3] or "", d[2] or "", int(size(d)))]

    def meta(d):
        out = []
        for k in keys:
            same = [lab[x[0]] for x in learn if k(x) == k(d)]
            out.append((sum(same) + 20 * rate) / (len(same) + 20))
        usual = [size(x) for x in learn if (x[3] or "") == (d[3] or "")]
        off = size(d) - sum(usual) / len(usual) if usual else 0.0
        return [*out, size(d), size(d) ** 2, off, abs(off), float(d[4] is None)]

    view = [content_features([d[1] for d in docs]).astype(np.float32).astype(float), np.array([meta(d) for d in docs])]
    own = sorted((i for i, d in enumerate(docs) if d[0] in lab), key=lambda i: info[docs[i][0]][0])
    y, keep = np.array([float(lab[docs[i][0]]) for i in own]), np.array([info[docs[i][0]][1] for i in own])
    own = np.array(own)
    balance = lambda v: np.where(v > 0, 0.5 / rate, 0.5 / (1 - rate))
    given = [[], []]

    def fit(v):
        x, lab_, w = (np.array([g[k] for g in given[v]]) for k in range(3)) if given[v] else (np.zeros((0, view[v].shape[1])), np.zeros(0), np.zeros(0))
        a = own[~keep]
        return Logistic(np.concatenate([view[v][a], x]), np.concatenate([y[~keep], lab_]), np.concatenate([balance(y[~keep]), w * balance(lab_)]))

    open_rows = [i for i, d in enumerate(docs) if d[0] not in lab and not held(d[0])]
    n = max(2, int(0.05 * (~keep).sum()))
    most, taken, report = (max(1, round(n * (1 - rate))), max(1, round(n * rate))), [set(), set()], []
    for _ in range(3):
        models = [fit(v) for v in (0, 1)]
        for v in (0, 1):
            worth = max(0.0, 2 * ranking_quality(models[v].logit(view[v][own[keep]]), y[keep]) - 1)
            s, handed = models[v].logit(view[v]), []
            for label in (0, 1):
                sure = sorted((float(-s[i] if label else s[i]), info[docs[i][0]][0], i) for i in open_rows if (s[i] > 0) == bool(label) and s[i] != 0)
                new = {}
                for _, h, i in sure:
                    if h not in taken[1 - v] and len(new) < most[label]:
                        new.setdefault(h, i)
                if worth:
                    taken[1 - v] |= new.keys()
                    given[1 - v] += [(view[1 - v][i], label, 0.5 * worth) for i in new.values()]
                handed.append(len(new) if worth else 0)
            report.append((handed, round(0.5 * worth, 9)))
    assert [([r["bad"], r["good"]], round(r["weight"], 9)) for r in co.report] == report and all(r["weight"] > 0 for r in co.report)
    for v in (0, 1):
        assert np.allclose(co.fit(v).logit(view[v]), fit(v).logit(view[v]), atol=1e-6)
    scored = score_quality(spark, frame, spark.createDataFrame(labels, "doc_id bigint, quality int"), rounds=3).collect()
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 for r in scored)
