import random
import re
import zlib
from collections import Counter

import numpy as np

from merganser.llm.extraction import DEFAULT, extract, learned, main_text
from merganser.llm.language import identify
from merganser.llm.quality import kept_documents, measured, quality, verdicts
from merganser.llm.top_k import top_k
from merganser.llm.toxicity import Hits, Lexicon, features, score


def test_quality_equals_plain_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\n ", "a\na\n\na b\na b", "é à\x1c b" * 30] + [" ".join(rng.choice("abcdé") + rng.choice(["", "\n", "#|"]) for _ in range(rng.randint(0, 200))) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality(df).collect()}
    for i, t in enumerate(t or "" for t in texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = t.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in kept_documents(df).collect()} == {i for i, r in got.items() if r.kept}
    clean = " ".join(f"w{i}" for i in range(300))
    assert verdicts(measured(clean.encode())) == (False, True)
    assert verdicts(measured((clean[:400] + "\n" + "the same line again and again here\n" * 30).encode()))[1] is False


def test_top_k_equals_all_products(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(700, 8)), 2)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(700, None, 1), (720, [float("nan")] * 8, 1), (740, [1.0, None] + [0.0] * 6, 1), (None, [9.0] * 8, 1), (5, v[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    m = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    ids, m = np.append(np.arange(700), 5), np.vstack([m, m[5]])
    want = []
    for q in range(0, 700, 20):
        s = m @ m[q]
        want += [(q, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:20])]
    assert sorted(map(tuple, top_k(df).collect())) == want
    assert top_k(df.limit(0)).count() == 0 and top_k(df.filter("vec_id in (0, 1)")).count() == 1


def test_pivots_bound_products_and_eliminate():
    from merganser.llm.top_k import Pivots, best_of

    rng = np.random.default_rng(4)
    for dim, n in ((16, 24), (16, 6), (3, 64)):
        v = np.floor(64 * rng.normal(size=(3000, dim)))
        pivots = Pivots(v[:500], n)
        at, off = pivots.places(pivots.distances(v))
        gap = ((at[:50, None] - at[None]) ** 2).sum(axis=2) + (off[:50, None] - off) ** 2
        real = ((v[:50, None] - v[None]) ** 2).sum(axis=2)
        slack = 1e-5 * real.max()
        assert (gap <= real + slack).all()
        one = np.sqrt(pivots.distances(v))
        assert (gap >= np.abs(one[:50, None] - one[None]).max(axis=2) ** 2 - slack).all()
        made = best_of(np.arange(50), v[:50], np.arange(3000), v, pivots, 20)[3]
        assert made < 50 * 3000 * (0.1 if n > dim else 0.9)


def test_language_by_held_out_accuracy(spark):
    rng = random.Random(2)
    letters = {"xx": "abcde ", "yy": "aefgh "}
    rows = [(i, "".join(rng.choices(letters[lang], k=120)), lang) for i in range(200) for lang in [rng.choice(["xx", "yy"])]] + [(900, None, "xx"), (901, "12 34", "xx"), (None, "abcd", None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, lang in rows[:200]:
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "xx"
    none = spark.createDataFrame(rows, "doc_id long, text string, lang string").limit(0)
    assert identify(none).count() == 0


def test_code_lengths_equal_plain_ppm():
    """Against contexts in dictionaries, byte by byte, unseen contexts and bytes included."""
    import math

    from merganser.llm.language import Trees

    rng = random.Random(5)
    texts = {lang: ["".join(rng.choices(letters, k=rng.randint(0, 60))).encode() for _ in range(12)] for lang, letters in (("a", "abcé "), ("b", "abcdxyz "))}
    trees = Trees(texts, 3)

    def plain(lang, text):
        seen = Counter(t[i : i + n + 1] for t in texts[lang] for n in range(4) for i in range(len(t) - n))
        by = {}
        for g, c in seen.items():
            by.setdefault(g[:-1], {})[g[-1]] = c

        def p(context, byte):
            shorter = p(context[1:], byte) if context else 1 / 256
            if context not in by:
                return shorter
            of = by[context]
            whole = sum(of.values()) + len(of)
            return of[byte] / whole if byte in of else len(of) / whole * shorter

        return -sum(math.log(p(text[max(0, i - 3) : i], x)) for i, x in enumerate(text))

    for text in [b"", b"a", b"ab", "abé cq".encode(), b"\xff\x00zz", *texts["a"][:3], "".join(rng.choices("abcdé xyzQ", k=300)).encode()]:
        assert np.allclose(trees.code_lengths(text), [plain("a", text), plain("b", text)], rtol=1e-5, atol=1e-5)


def test_long_words_are_looked_up(spark):
    hits = Hits(Lexicon({"nastyterm": 4.0}))
    assert hits["!" * 500 + "nastyterm"] and hits["nastyterm" + "?" * 500] and not hits["x" * 5000] and not hits["nastyterm" * 20]
    rows = [(i, f"{'!' * 150}nastyterm you" if i % 4 == 0 else "all is well with you", None) for i in range(80)] + [(7, "again, a row of the same id", 1), (None, "z" * 300_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    got = score(df, labels).collect()
    assert len(got) == 82 and all(r.predicted == int(r.doc_id is not None and r.doc_id % 4 == 0) for r in got)
    assert score(df.limit(0), labels).count() == 0


def test_levenshtein_automaton_equals_distance():
    def near(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["abcab", "abcba", "bacab", "cab"]
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))
    rng = random.Random(4)
    for _ in range(4000):
        w = "".join(rng.choices("abc", k=rng.randint(1, 7)))
        found = lexicon.find(w)
        if w in terms:
            assert found == (w, False)
        else:
            assert (found is not None) == any(near(w, t) == 1 for t in terms if len(t) >= 5)


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("lmnopqrst", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)] + (["nastyterm", "badword"] * 2 if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1001, "you nastytrem badwrod nastyterm"), (1002, None), (1003, 'they said "nastyterm" as a quote in the report of words about it')]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[1001].predicted == 1 and got[1002].predicted == 0
    lexicon = Hits(Lexicon({"nastyterm": 4.0}))
    assert features('he wrote "nastyterm" there', lexicon)[0] < features("you nastyterm there", lexicon)[0]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.01 for r in score(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()} == {True}


def test_main_text(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies here.</div><nav><a href=/>Home</a></nav><div id="content"><h2>Title</h2><p>Long first paragraph
 with many &amp; words, a <a href="x">link</a> in it.<br>More.<p>Second one&nbsp;here with words.<div class="advert">Buy</div><script>var a = "<p>no</p>";</script></div><div id="comments"><p>Great!</p></div><footer>(c)</footer>"""
    want = "Title\nLong first paragraph with many & words, a link in it. More.\nSecond one here with words."
    assert main_text(page, DEFAULT) == want and main_text(None, DEFAULT) == main_text("", DEFAULT) == main_text("<p></p>", DEFAULT) == ""
    assert main_text("<div class=ad>all the words of a page", DEFAULT) == "all the words of a page"
    article = "<html><head><title>T</title></head><body><ul><li><a>x y</a></li></ul><article><h1>A b</h1><p>c d e f</p></article><p>other words outside</p></body></html>"
    assert main_text(article, learned([article] * 5)) == "A b\nc d e f"
    df = spark.createDataFrame([(1, "u", article, "t"), (1, "u", article, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extract(df).collect()) == [0, 11, 11] and extract(df.limit(0)).count() == 0


def test_region_is_the_best_of_all():
    from merganser.llm.extraction import Page

    rng = random.Random(7)
    for _ in range(300):
        page = Page("")
        page.kinds = rng.choices(["word", "link", "out", "p", "/p", "div", "xyz"], k=rng.randint(0, 14))
        page.counts = [rng.randint(1, 9) if k in ("word", "link") else 1 for k in page.kinds]
        weights = {"word": 0.5, "link": 0.1, "out": -1.5, "tag": -0.8, "p": -0.2, "div": -rng.random() * 3}
        each = [n * weights[k] if k in ("word", "link", "out") else weights.get(k.lstrip("/"), -0.8) for k, n in zip(page.kinds, page.counts)]
        a, b = page.region(weights)
        best = max([0.0, *(sum(each[i:j]) for i in range(len(each)) for j in range(i + 1, len(each) + 1))])
        assert abs(sum(each[a:b]) - best) < 1e-9


def test_attributes_are_read_by_name():
    """What stands inside values, or in other attributes, doesn't hide text; names in part about something else don't, where they hold the page's words."""
    text = "some words of the article " * 18
    want = text.strip()
    for tag in ('title="The hidden city"', "title='a class=nav b'", 'data-hidden="false"', 'data-id="nav"', 'data-role="menu"', 'onclick="hidden=1"', 'class="search-article"', 'class="tags-and-text"', 'data-x="a" data-class="ad"'):
        assert main_text(f"<article><h1>T</h1><div {tag}>{text}</div><p>tail</p></article>", DEFAULT) == f"T\n{want}\ntail", tag
        assert main_text(f"<body><h1>T</h1><div {tag}>{text}</div><p>a tail of several words</p></body>", DEFAULT).endswith(f"{want}\na tail of several words"), tag
    for tag in ("hidden", 'hidden=""', "class='x ad'", "class=nav", 'ID = "sidebar"', 'role="navigation"', 'style="display: none"', 'aria-hidden="true"', 'class="footer-text"', 'class="sidebar-content"'):
        assert main_text(f"<body><div>{text}</div><div {tag}>menu and more</div><p>{text}</p></body>", DEFAULT) == f"{want}\n{want}", tag


def test_pages_of_any_size_and_rows(spark):
    html = "<article>" + "<p>a paragraph of words</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", html, 1), (1, "u", html, 2), (2, None, "<p>" + "x" * 300_000, 3)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.n_chars) for r in extract(df).collect())
    assert got == [(1, 20_000 * 21 - 1)] * 2 + [(2, 300_000)]
