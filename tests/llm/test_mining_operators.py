"""Collocations, page texts and hard negatives against brute force, and at their edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import collocations, hard_negatives, html_extraction
from ledgerlight.llm.page_blocks import blocks

# --- collocations --------------------------------------------------------------------------


def brute_counts(rows):
    counts, words = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").translate({65 + i: 97 + i for i in range(26)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, 5):
                counts.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    return counts, words


def brute_phrases(rows, threshold, top):
    counts, words = brute_counts(rows)
    frequent = {k: v for k, v in counts.items() if v >= threshold}
    found = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1:
            cuts = [((2_000_000 * a) // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (a, counts[lang, w[:k]], counts[lang, w[k:]], score)
    kept = {}
    for (lang, w), values in found.items():
        longer = [v[0] for (other, x), v in found.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * f >= 80 * values[0] for f in longer):
            kept[lang, w] = values
    out = set()
    for lang in {key[0] for key in kept}:
        mine = sorted(((-v[3], -v[0], " ".join(w).encode()), w, v) for (at, w), v in kept.items() if at == lang)
        out |= {(lang, i + 1, " ".join(w), v[0], v[1], v[2], words[lang], v[3]) for i, (_, w, v) in enumerate(mine[:top])}
    return out


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    words = ["a", "B", "b", "über", "x\x1cy", "the", "of", "new york", "stock exchange"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice([".", "\n", "\t;", ""])) for _ in range(300)]
    return [*rows, ("en", None), ("en", ""), ("de", "!?.,"), ("fr", " \t "), *[("en", "rare pair of words")] * 7]


@pytest.mark.parametrize("max_cells", [1 << 24, 1])
def test_phrases_equal_brute_force(spark, spoken, max_cells, monkeypatch):
    monkeypatch.setattr(collocations, "MIN_CELLS", 1 << 6 if max_cells == 1 else 1 << 14)
    docs = spark.createDataFrame(spoken, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit("x"), "w": F.lit(0)}).repartition(3)
    found = {tuple(r) for r in collocations.collocations(docs, threshold=6, top=25, max_cells=max_cells).collect()}
    assert found == brute_phrases(spoken, 6, 25) and len(found) > 50


def test_sketches_never_count_less(spark, spoken):
    texts = spark.createDataFrame([(lang or "und", text or "") for lang, text in spoken], "lang string, text string").repartition(3)
    reached = collocations._reached(collocations._sketches(texts, (1, 2), list, 8, 30), (1, 2), 8, 30).cells
    counts, _ = brute_counts(spoken)
    exact = collocations.count_sequences(texts, threshold=30)
    assert {(r["lang"], r["phrase"]): r["n"] for r in exact.filter("phrase != ''").collect()} == {(lang, " ".join(w)): n for (lang, w), n in counts.items() if n >= 30}
    assert reached.shape == (collocations.DEPTH, 1 << 5) and reached.any()


def test_sketches_do_not_fill_up(spark):
    texts = spark.range(4000).selectExpr("'en' as lang", "array_join(transform(sequence(1, 20), i -> concat('w', id * 20 + i)), ' ') || '. often said' as text").repartition(3)
    reached = collocations._reached(collocations._sketches(texts, (1, 2), list, 10, 30), (1, 2), 10, 30).cells
    assert 1 <= np.unpackbits(reached, axis=1).sum(axis=1).min() and np.unpackbits(reached).sum() <= 3 * collocations.DEPTH


def test_words_are_told_apart_by_their_bytes():
    text = "Ab ab\tAB\0  ab. " + "x" * 300 + " " + "x" * 299 + "y " + "x" * 300 + ";über abcdefgh abcdefghi abcdefgh\0 " + "z" * 255 + " " + "z" * 256 + " " + "z" * 257
    words = collocations.Words(text.encode())
    pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.lower())]
    said = [w.encode() for p in pieces for w in p]
    assert [words.word(k) for k in range(len(words.starts))] == said and words.phrases(np.array([0]), 4) == [b"ab ab ab\0 ab"]
    assert words.joined.tolist() == [a for p in pieces for a in [*[True] * (len(p) - 1), False]][:-1]
    assert len(set(words.hashes.tolist())) == len(set(said))
    for hashes in (words.hashes, np.full(len(said), 7, np.uint64)):
        at = np.arange(1, len(said))
        ids = collocations.numbers(words, at, hashes[1:])
        assert ids[0] == -1 and all((ids[i] == ids[j]) == (said[i] == said[j]) for i in at for j in at)
    assert not len(collocations.Words(b" .\n").starts)


def test_sequences_of_one_hash_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 3])
    first, times = collocations.distinct(ids, np.array([0, 1, 3, 4, 5]), np.array([7, 7, 7, 7, 7], np.uint64), 2)
    assert sorted(zip(first.tolist(), times.tolist(), strict=True)) == [(0, 2), (1, 2), (5, 1)]


def test_phrases_of_one_hash_are_told_apart():
    said = [b"", b"a b", b"c", b"a b", b"d", b"c", b"", b"rare", b"a b"]
    for hashes in ([0, 5, 6, 5, 7, 6, 0, 8, 5], [0, 5, 5, 5, 7, 5, 0, 8, 5], [0] * 9):
        phrases, sums = collocations.frequent_phrases(np.array(hashes, np.uint64), np.array([1, 2, 2, 2, 9, 3, 1, 3, 1], np.uint32), pa.array(said, pa.large_binary()), 5)
        assert dict(zip(phrases.to_pylist(), sums.tolist(), strict=True)) == {b"": 2, b"a b": 5, b"c": 5, b"d": 9}


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).isEmpty()


def test_long_texts_and_wide_products(spark):
    text = "tick tock " * 300_000
    (row,) = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).filter("phrase = 'tick tock tick tock'").collect()
    assert (row["a"], row["n"]) == (299_999, 600_000)
    wide = spark.createDataFrame([("en", "", 9), ("en", "p q", 9 * 10**18), ("en", "p", 9 * 10**18), ("en", "q", 9 * 10**18 + 7)], "lang string, phrase string, n long")
    (row,) = collocations.score_phrases(wide).collect()
    assert row["score"] == 2_000_000 * 9 * 10**18 // (18 * 10**18 + 7)


# --- page texts ----------------------------------------------------------------------------


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 6])
def test_alignments_are_longest_common_subsequences(bits, monkeypatch):
    monkeypatch.setattr(html_extraction, "_BITS", bits)
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = html_extraction.align(a, b)
        assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_blocks_leave_out_what_markup_names():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
    <header><h1>Site</h1><nav><ul><li><a href="/">Home</a></ul></nav></header><div class="cookie-banner">We use cookies</div><main><h1>Title &amp; more</h1>
    <article><header>By <b>me</b><h2>Sub&nbsp;title</h2></header><p>One<br>two <i>three</i>
    four<p>&lt;five&gt; &#x41;&am<div class="has-ads">kept</div><aside>Related</aside><div class='ad'>Buy</div><form>x<input></form><!-- <p>no</p> --><section id="comments"><p>First!</p></section></article>
    <div>beside</div></main><footer>Foot</footer>"""
    assert blocks(page) == (["Title & more", "Sub title", "One two three four", "<five> A&am", "kept"], True)
    assert blocks("") == ([], False) and blocks("<p") == ([], False) and blocks("a < b<br>c") == (["a < b c"], False)
    assert blocks("<div class=ad>x</div><p style='display: none'>y</p><div hidden>z</div><ul><li>1<li>2</ul><table><tr><td>a<td>b</table>") == (["1", "2", "a b"], False)


def test_scans_take_linear_time():
    for piece in ("<b>", "<!--", "<div class=\"x", "<a title='", "</p>", "<li>", "&amp", "<p><b>"):
        blocks(piece * 100_000)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"lines": F.lit(1), "gone": F.lit("x"), "row": F.lit(2), "text": F.lit(3)})


def test_lines_that_a_site_repeats_are_deleted(spark):
    rng = random.Random(4)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))
    rows, wanted = [], {}
    for host in ("a.org", "b.org"):
        for i in range(60):
            own = [say() for _ in range(4)]
            lines = [f"Welcome to {host}", *own[:2], "Read our guide", *own[2:], "Send us a word"]
            rows.append((len(rows), f"https://{host}/s{i % 3}/{i}?x=1", "".join(f"<div>{x}</div>" for x in lines)))
            wanted[rows[-1][0]] = "\n".join(own)
    copy = "".join(f"<div>{x}</div>" for x in ("Welcome to c.org", *[f"copied {k} {say()}" for k in range(5)]))
    copies = [(1000 + i, f"http://c.org/{i:03}", copy) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_texts(pages_of(spark, rows + copies).repartition(5)).collect()}
    assert {k: got[k] for k in wanted} == wanted
    assert all(got[1000 + i].count("\n") == 5 for i in range(40))  # copies say nothing about one another


def test_articles_keep_common_lines_but_not_a_sites(spark):
    rows = []
    for i in range(40):
        body = f"<p>own text number {i} {'word ' * i}</p>" + ("<p>A licence line.</p>" if i % 3 == 0 else "") + "<p>Share this story</p>"
        rows.append((i, f"https://h.org/{i:02}", f"<nav>menu</nav><article>{body}</article><p>elsewhere {i}</p>"))
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_texts(pages_of(spark, rows)).collect()}
    assert all("Share" not in t and t.startswith("own text") and "elsewhere" not in t for t in got.values())
    assert all(("licence" in got[i]) == (i % 3 == 0) for i in range(40))


def test_page_runs_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "RUN", 40)
    rng = random.Random(7)
    rows = [(i % 90, f"https://h.org/{rng.randint(0, 300)}", "".join(f"<div>{rng.randint(0, 30)} common</div>" for _ in range(rng.randint(0, 9)))) for i in range(300)]
    some = [sorted((r["page_id"], r["url"], r["text"]) for r in html_extraction.extract_texts(pages_of(spark, rows).repartition(n)).collect()) for n in (1, 7)]
    pages = sorted(rows, key=lambda r: r[1])
    assert some[0] == some[1] and len(some[0]) == len(pages)


def test_page_edges(spark):
    rows = [(1, None, None), (None, "no url", "<p>x"), (2, "http://a/", ""), (2, "http://a/", "<p>long</p>" * 20_000), (3, "http://a/", " <p>&nbsp;</p>")]
    found = html_extraction.extract_texts(pages_of(spark, rows))
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in found.collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 20_000 * 5 - 1), (3, 0)] and found.columns == ["page_id", "url", "text", "n_chars"]
    assert html_extraction.extract_texts(pages_of(spark, [])).isEmpty()


# --- hard negatives ------------------------------------------------------------------------


def brute_negatives(rows, every=100):
    held = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v])
        held[i] = min(held.get(i, one), one)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, q) in held.items():
        if a % every:
            continue
        scores = sorted((-dot(q, x), b, other) for b, (other, x) in held.items() if b != a)
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            negatives = [(n, b) for n, b, other in scores if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            out |= {(a, positive, k + 1, b, -p, -n) for k, (n, b) in enumerate(negatives[:5])}
    return out


@pytest.mark.parametrize("scale", [0.1, 60.0, 1e6])
def test_negatives_equal_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "ROWS", 90)
    monkeypatch.setattr(hard_negatives, "_ROWS_AT_ONCE", 50)
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 3), [rng.gauss(0.3, 1) * scale for _ in range(rng.choice([6, 6, 6, 5]))]) for i in range(600)]
    rows += [(600 + i, 1, [scale] * 6) for i in range(30)] + [(i, 2, [scale] * 6) for i in range(100, 110)]
    rows += [(700, None, [1.0]), (800, 1, None), (900, 1, [float("nan")]), (1000, 1, [None]), (None, 1, [1.0]), (1100, 3, []), (1200, 2, [float("inf")])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"x": F.lit(1), "slot": F.lit("y"), "score": F.lit(2)})
    found = {tuple(r) for r in hard_negatives.hard_negatives(table, every=25).collect()}
    assert found == brute_negatives(rows, 25) and len(found) > 100


def test_planes_drop_what_cannot_qualify():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-200, 200, (500, 16)), rng.integers(-200, 200, (4, 16))
    exact = x @ q.T
    seen = []

    def reach(low, high, anchor):
        kept = high >= np.sort(exact, axis=0)[-5][anchor]
        seen.append(int(kept.sum()))
        return kept

    row, of, scores = hard_negatives.sliced_scores(hard_negatives.BitSlices(x), q, reach)
    assert (exact[row, of] == scores).all() and {*zip(row.tolist(), of.tolist(), strict=True)} == {(i, j) for j in range(4) for i in np.argsort(-exact[:, j])[:5].tolist()}
    assert seen == sorted(seen, reverse=True) and seen[3] < 600


def test_negatives_of_tables_without_anchors(spark):
    empty = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], empty)).isEmpty()
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], empty)).isEmpty()
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0])], empty)).isEmpty()
