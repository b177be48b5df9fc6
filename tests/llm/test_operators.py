import collections
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from hypothesis import given, settings
from hypothesis import strategies as st

import quiverlake.llm.ngram_jaccard as J
from quiverlake.llm import ann, html_text, mixing, packing, quality, queries, toxicity, warc
from quiverlake.llm.boosting import BoostedTrees, Isotonic
from quiverlake.llm.components import components
from quiverlake.llm.ngram_jaccard import near_representatives, ngram_jaccard
from quiverlake.llm.store import new_folder
from quiverlake.llm.substring_dedup import deduplicated, without_repeats
from quiverlake.llm.token_counts import TokenRollup, deletes, document_counts, inserts, revisions

DATA = "/root/testdata/sf0.001"
real = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, n_words int, token string"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards mix potions in the old tower by the sea. "


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(50)) + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns with clashing names."""
    texts = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, prose(4, 40_000)), (5, prose(5)), (6, prose(5)), (5, prose(5)), (None, prose(6)), (None, None), (7, "four words no more"), (8, "four words no more"), (9, PROSE * 30), (10, "a" * 200_000)]
    rows = [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "x", None, i, "y") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real_docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 1 mixing


def test_mixing_targets_follow_repeated_sharing(spark):
    rng = random.Random(3)
    for case in range(4):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 10, 500, 90_000]) + rng.randrange(5) for i in range(7)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(mixing.cycled_weights(df)).collect()}
        assert got == pytest.approx(brute.mixed_targets(sizes), rel=1e-9), case


@real
def test_mixing_takes_near_the_targets(spark, real_docs):
    rows = mixing.rates(real_docs).collect()
    again = mixing.rates(real_docs).collect()
    assert sorted(rows) == sorted(again) and all(r["copies"] <= 2 for r in rows)
    taken, target = sum(r["size"] * r["copies"] for r in rows), sum({r["source"]: r["target"] for r in rows}.values())
    assert abs(taken / target - 1) < 0.2
    assert mixing.mix(real_docs).count() == sum(r["copies"] for r in rows)


def test_mixing_odd_rows(odd, none):
    rows = mixing.rates(odd).collect()
    assert len(rows) == odd.count() and rows[0].__fields__[-4:] == ["size_", "source_size", "target", "copies"]
    assert {r["copies"] for r in rows if r["doc_id"] == 5} <= {0, 1, 2}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.rates(none).count() == mixing.mix(none).count() == 0


# 2 quality


@real
def test_quality_matches_brute_force(real_docs):
    rows = quality.judged(real_docs).collect()
    kept = brute.verdicts([(r["text"], r["lang"], r["source"]) for r in rows])
    for r, k in zip(rows, kept, strict=True):
        assert {n: r[n] for n in brute.measures("")} == brute.measures(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|.\n\t ", max_size=60) | st.none(), min_size=1, max_size=6))
def test_quality_measures_any_text(texts):
    import pyarrow as pa

    from quiverlake.llm.kernels import buffers

    got = quality._measure(*buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert {n: int(c[i]) for n, c in zip(quality._NAMES, got, strict=True)} == brute.measures(t)


@real
def test_quality_fences_follow_each_group(spark):
    """Every fence differs between languages and sources, and clean documents pass them."""
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    narrow = docs.select("lang", "source", "text").toDF("c0", "c1", "c2")
    fences = quality.thresholds(quality.sketches(quality.features(narrow, "c2"), "c0", "c1")).toPandas()
    assert len(fences) > 20
    for name in fences.columns[2:]:
        assert fences[name].nunique() > len(fences) / 3, name
    found = quality.judged(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.05 * n[0, False]


def test_quality_odd_rows(odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == odd.count() and "n_words_" in rows[0].__fields__
    assert all(not r["kept"] for r in rows if not r["text"] or r["base_failed"])
    assert quality.quality_filter(odd).columns == odd.columns and quality.quality_filter(none).count() == 0


# 3 n-gram Jaccard


def corpus(seed, n=60):
    """Documents with near copies at every degree, exact copies, shared passages and one large group."""
    rng = random.Random(seed)
    shared, rows = prose(999, 25), []
    hot = prose(1000, 80).split()
    for i in range(n):
        base = prose(i, rng.choice([3, 5, 6, 12, 60, 200])).split()
        for copy in range(rng.choice([1, 1, 2, 4])):
            w = [x if rng.random() > 0.01 * copy * rng.random() * 4 else f"new{rng.randrange(10**6)}" for x in base]
            rows.append(" ".join(w) + (f"\n{shared}" if rng.random() < 0.3 else ""))
    rows += [" ".join(w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"h{rng.randrange(10**6)}" for w in hot) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.components(rows))
    kept = near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in brute.components(rows)})


@pytest.mark.parametrize("tile", [7, 1000])
def test_jaccard_of_long_lists_in_tiles(spark, monkeypatch, tile):
    """Every list in several tiles, pairs formed a few at a time."""
    monkeypatch.setattr(J, "LIST_TILE", tile)
    monkeypatch.setattr(J, "PAIR_TILE", 50)
    rows = corpus(5, 40)
    rng, hot = random.Random(6), prose(7, 90).split()
    # around one passage, with more or fewer words of their own: some link, chains among them, most don't
    rows += [(1000 + i, " ".join([*hot, *(f"own{i}x{j}" for j in range(rng.choice([1, 5, 9, 11, 14, 20])))])) for i in range(60)]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.components(rows))


def test_jaccard_forms_no_pairs_around_a_passage(monkeypatch):
    """Documents of 86 words in common and 14 of their own can't link, and their list gives no pair."""
    import pyarrow as pa

    n = 20_000
    sign = np.random.default_rng(1).integers(-(2**62), 2**62, n)
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32), sign, np.full(n, 96), np.full(n, 82), sign, np.ones(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.zeros(n, bool))], names=list("abcdefghi"))
    made = []
    monkeypatch.setattr(J, "_grouped", lambda a, b, need: made.append(sum(map(len, a))))
    list(J._cross_pairs(8, 10)(iter([batch])))
    assert sum(made) == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, c), (3, c + " more"), (4, c), (5, b + " more"), (6, None), (6, ""), (6, prose(4))]
    kept = near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], (r["text"] or "").removesuffix(" more")) for r in kept)
    assert got == sorted([(1, a), (2, b), (3, c), (6, ""), (6, prose(4))])


@real
def test_jaccard_real_rows(real_docs):
    rows = [tuple(r) for r in real_docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in ngram_jaccard(real_docs).collect()) == sorted(brute.components(rows))


def test_jaccard_odd_rows(odd, none):
    rows = ngram_jaccard(odd).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == odd.count() and {(1, 0, 1), (2, 0, 2), (3, 0, 3), (7, 1, 7), (8, 1, 7), (None, 0, None)} <= got
    assert {c for d, _, c in got if d in (5, 6)} == {5}
    kept = collections.Counter(r["doc_id"] for r in near_representatives(odd).collect())
    assert kept[5] == 1 and kept[6] == kept[8] == 0 and kept[None] == 2 and kept[1] == 1
    assert near_representatives(odd).columns == odd.columns
    assert ngram_jaccard(none).count() == near_representatives(none).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5)] + [(1, x) for x in range(200, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[7] == got[3] == 3 and 5 not in got and got[229] == 1


# 4 substring dedup


@real
def test_spans_match_brute_force(real_docs):
    rows = sorted(tuple(r) for r in real_docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in deduplicated(real_docs).collect()}
    for (d, _), (n, gone, left) in zip(rows, brute.deduplicated(rows), strict=True):
        assert (got[d]["n_sentences"], got[d]["n_removed"], brute.words(got[d]["text"], True)) == (n, gone, left)


@real
def test_spans_catch_passages_of_fifty_words(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in deduplicated(docs).collect()}
    repeated = brute.repeated_words(rows)
    caught = [got[d]["words_removed"] >= 0.6 * n for (d, _), n in zip(rows, repeated, strict=True) if n]
    assert len(caught) > 50 and sum(caught) >= 0.98 * len(caught)
    # what repeats for less than the shortest run stays: documents without a window of 40 words that is there elsewhere or twice
    seen = collections.Counter()
    for _, text in rows:
        w = brute.words(text, True)
        seen.update(tuple(w[i : i + 40]) for i in range(len(w) - 39))
    for d, text in rows:
        w = brute.words(text, True)
        if all(seen[tuple(w[i : i + 40])] == 1 for i in range(len(w) - 39)):
            assert got[d]["n_removed"] == 0 and got[d]["text"] == text


def test_spans_keep_the_first_and_the_rest(spark):
    passage = " ".join(f"passage{i}" for i in range(52)) + "."
    rows = [(3, f"Own start three. {passage} Own end three."), (1, f"Start one here.\n{passage}\nEnd one here."), (2, f"{passage}  Kept."), (4, "Nothing in common with others at all.")]
    got = {r["doc_id"]: r["text"] for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[1][1] and got[4] == rows[3][1]
    for own, text in (("Own start three. Own end three.", got[3]), ("Kept.", got[2])):
        left = brute.words(text)
        assert [w for w in left if "passage" not in w] == own.split() and len(left) - len(own.split()) <= 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZÉ.!\n\t ", max_size=80) | st.none(), min_size=1, max_size=6))
def test_sentences_of_any_text(texts):
    import pyarrow as pa

    from quiverlake.llm.kernels import buffers
    from quiverlake.llm.substring_dedup import Sentences

    s = Sentences(*buffers(pa.array(texts, pa.string())))
    assert s.words.tolist() == [len(x) for t in texts for x in brute.sentences(t)]


def test_spans_odd_rows(odd, none):
    rows = deduplicated(odd).collect()
    assert len(rows) == odd.count() and sum(r["text"] is None for r in rows) == 2
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[5] == prose(5) and text[6] == "" and text[2] == ""
    assert without_repeats(odd).columns == odd.columns and 6 not in {r["doc_id"] for r in without_repeats(odd).collect()}
    assert deduplicated(none).count() == 0


# 5 html

LONG = "This is a paragraph of the article that is long enough to be told from what is around it, and it has the words of the language."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words", "plain words"),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;&eacute;<br>three</p><p>.</p></article><footer>&copy; x</footer>", "T & U\n\nOne two é three\n\n."),
        (f"<div id=cookie-banner><p>{LONG}</p></div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><div class='sidebar'>{LONG}</div><section class=comments><p>{LONG}</p></section>", f"Head\n\n{LONG}\n\nShort."),
        (f"<main><p><b>Open<p>{LONG}<script>var p='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><p>{LONG}</p></form><p>End", f"Open\n\n{LONG}\n\nEnd"),
        ("<article><p title='a>b'>x</p><ul><li>one</li><li>two</li></ul></article>", "x\n\none\n\ntwo"),
        ("<article><p>unclosed \" quote <a href=\"x>y</p><p>z</p></article>", None),
        ("<" * 2000 + "p>", None),
    ],
)
def test_html_cases(page, text):
    got = html_text.main_text(page)
    assert text is None or got == text


def test_html_names_inside_an_article():
    """Prose under a name that surroundings have too stays if its blocks read like prose."""
    page = f"<article><p>{LONG}</p><section class=%s><h2>Head</h2><p>{LONG} {LONG}</p></section><p>End.</p></article>"
    inside = f"{LONG}\n\nHead\n\n{LONG} {LONG}\n\nEnd."
    for name in ("legal-history", "form_of_government", "relatedWork", "body"):
        assert html_text.main_text(page % name) == inside, name
    for name in ("legal", "related", "legal-notice", "comments", "social-ad", "form", "cookie-box"):
        assert html_text.main_text(page % name) == f"{LONG}\n\nEnd.", name
    links = "<article><p>" + LONG + "</p><div class=related-posts><p><a href=x>Another article of ours</a></p><p>By us</p></div></article>"
    assert html_text.main_text(links) == LONG


def test_html_pages_of_known_blocks():
    """Pages built from an article and what surrounds it, with markup inside the blocks."""
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choice("the of river and stone to cloud is in a house that was old".split()) for _ in range(n))
    surroundings = ["<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>", "<div class='ad'>%s</div>", "<aside><h3>More</h3><p>%s</p></aside>", "<form><p>%s</p><input name=q></form>", "<script>if (a < b) { '%s' }</script>", "<div id='cookie-notice'><p>%s</p></div>", "<section class='comments'><p>%s</p></section>", "<footer><p>%s</p></footer>"]
    around = lambda *more: "".join(t % some(40) if "%s" in t else t for t in rng.sample([*surroundings, *more], rng.randrange(5)))
    for _ in range(200):
        blocks, html = [], []
        for _ in range(rng.randrange(1, 9)):
            tag, words = rng.choice(["p", "p", "h2", "li", "blockquote"]), some(rng.choice([2, 8, 30, 90])).split()
            plain = words.copy()
            i = rng.randrange(len(words))
            words[i], plain[i] = rng.choice([(f"<b>{words[i]}</b>", words[i]), (f"<a href='x'>{words[i]}</a>" if len(words) > 2 else words[i], words[i]), ("A &amp; B", "A & B"), ("&#8364;&nbsp;5", "€ 5"), (f"{words[i]}<br>\n x", f"{words[i]} x")])
            blocks.append(" ".join(plain))
            html.append(f"<{tag}>" + "  ".join(words) + f"</{tag}>" + (around() if rng.random() < 0.2 else ""))
        page = f"<html><head><title>t</title><style>p {{}}</style></head><body>{around('<header><p>%s</p></header>')}<article>{''.join(html)}</article>{around()}</body></html>"
        assert html_text.main_text(page) == "\n\n".join(blocks)


def test_html_second_pass_matches_all_distances():
    """The nearest decided block of the region, looked for at every distance; equal distances: either will do, but a heading outside goes with what follows."""
    rng = random.Random(3)
    for _ in range(300):
        found = [html_text._Block(rng.choice(["p", "h2", "li"]), rng.choice(["x", LONG, LONG.replace(" is ", " zz ").replace(" the ", " zz "), "a b c " * 20]), 0, rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 14))]
        named = any(b.region for b in found)
        first = [False if named and not b.region else html_text._decide(b, b.region > 0) for b in found]
        expected = []
        for i, b in enumerate(found):
            label = first[i]
            for step in range(1, len(found)):
                near = [first[j] for j in (i + step, i - step) if 0 <= j < len(found) and found[j].region == b.region and first[j] is not None]
                if label is None and near:
                    label = near[0] if b.tag == "h2" and not b.region else any(near)
            expected.append(label if label is not None else b.region > 0 or not named)
        assert html_text.classify(found) == expected


def test_html_long_pages_take_proportional_time():
    import time

    for part in ("<li>one two</li>", "<li>one two", "<b>x", "<span><p>y", "</i><b>z", "<dt>a<dd>b", "<div>w"):
        begin = time.perf_counter()
        html_text.main_text(part * 40_000)
        assert time.perf_counter() - begin < 15, part


@real
def test_html_real_pages(spark):
    rows = queries.op5_html_text(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] and "©" not in r["text"] for r in rows)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>" + "x " * 200_000 + "</p>", 6)], "page_id long, url string, html string, text int")
    rows = {r["page_id"]: r for r in html_text.extracted(df).collect()}
    assert rows[1]["text"] == "" and rows[None]["n_chars"] == 399_999 and html_text.extracted(df.limit(0)).count() == 0


# 6 toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.15
        w = prose(i, 40).split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["wretch", "vermin", "oaf", "zorkly", "zorkum", "zorkex"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_isotonic_fit_matches_the_min_max_formula():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        score, y = rng.permutation(n).astype(float), rng.integers(0, 2, n)
        own = y[np.argsort(score)]
        best = [max(min(own[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        fit = Isotonic().fit(score, y)
        # a step's value holds at its middle; between steps values lie on a line
        assert sorted(set(np.round(fit.value, 12))) == sorted(set(np.round(best, 12)))
        for at, value in zip(fit.at, fit.value, strict=True):
            step = [i for i in range(n) if abs(best[i] - value) < 1e-9]
            assert at == pytest.approx(np.mean(step))
        out = fit(np.linspace(-1, n, 50))
        assert (np.diff(out) >= -1e-12).all() and out.min() >= 0 and out.max() <= 1


def test_one_tree_splits_where_brute_force_does():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
        tree = BoostedTrees(trees=1, depth=1, rate=1.0, bins=64, least=5, l2=1.0).fit(x, y)
        p = y.mean()
        grad, hess = p - y, np.full(60, p * (1 - p))
        score = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        gains = {}
        for f in range(3):
            for cut in np.unique(x[:, f])[1:]:
                right = x[:, f] >= cut
                if min(right.sum(), (~right).sum()) >= 5:
                    gains[f, cut] = score(right) + score(~right) - score(np.ones(60, bool))
        base = np.log(p / (1 - p))
        raw = tree.raw(x)
        best = max(gains.values())
        expected = [np.where(x[:, f] >= c, *(base - grad[r].sum() / (hess[r].sum() + 1.0) for r in (x[:, f] >= c, x[:, f] < c))) for (f, c), g in gains.items() if g > best - 1e-9]
        assert any(np.allclose(raw, e) for e in expected)


def test_trees_lower_the_loss_and_find_interactions():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    loss = []
    for n in (1, 5, 20, 60):
        raw = BoostedTrees(trees=n).fit(x, y).raw(x)
        loss.append(np.log1p(np.exp(-(2 * y - 1) * raw)).mean())
    assert loss == sorted(loss, reverse=True) and loss[-1] < 0.1
    new = rng.random((500, 4))
    assert ((BoostedTrees().fit(x, y).raw(new) > 0) == ((new[:, 0] > 0.5) ^ (new[:, 1] > 0.3))).mean() > 0.97


def test_toxicity_is_learned(insults):
    docs, labels, truth = insults
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_toxicity_of_held_out_labels_is_never_seen(spark, insults):
    docs, labels, _ = insults
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.scored(docs, toxicity.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_is_learned_where_a_fold_misses_a_label(spark):
    """No toxic id falls in fold 0 by its hash."""
    F = toxicity.F
    ids = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) % toxicity.FOLDS).alias("fold"), toxicity.held_out(F.col("id")).alias("held")).collect()
    bad = [r["id"] for r in ids if r["fold"] and not r["held"]][:20] + [r["id"] for r in ids if r["held"]][:8]
    good = [r["id"] for r in ids if r["id"] not in bad][:400]
    docs = spark.createDataFrame([(i, prose(i, 40) + " you wretch vermin" * (i in bad)) for i in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in bad + good], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] in bad) for r in held) >= 0.97 * len(held) and all(r["predicted"] for r in held if r["doc_id"] in bad)


def test_toxicity_odd_rows(odd, none, insults):
    docs, labels, _ = insults
    model = toxicity.fit(docs, labels.unionByName(labels.limit(3)))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None for r in rows)
    assert toxicity.scored(none, model).count() == 0
    assert {r["score"] for r in toxicity.scored(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.0}


# 7 neighbours


def test_neighbours_recall_and_measure(spark):
    x = np.random.default_rng(2).standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.neighbours(df, df.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in own)
        hits += len({r["vec_id"] for r in own} & set(np.argsort(d)[:10]))
    assert hits >= 0.9 * 300


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", ann.F.lit("x"))
    got = [tuple(r) for r in ann.neighbours(df, df.where("vec_id in (0, 4, 8)"), 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0)] and [g[2] for g in got[3:]] == [0, 1, 2]
    assert ann.neighbours(df.limit(0), df).count() == 0


def test_scan_drops_nothing_when_told_so():
    x = np.random.default_rng(3).standard_normal((500, 40))
    q, ids = x[:5], np.arange(500)
    i, j, s = ann.scan(q, ids[:5], np.full(5, np.inf), x, ids, np.linalg.qr(np.random.default_rng(4).standard_normal((40, 40)))[0], 10, np.inf)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for a in range(5):
        assert list(j[i == a].astype(int)) == list(np.argsort(d[a])[:10]) and np.allclose(s[i == a], np.sort(d[a])[:10])


# 8 packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_gives_each_piece_one_place(counts):
    runs = packing.plan(counts, 64)
    bins, given_ = collections.defaultdict(list), collections.Counter()
    for length, first, slots, n, base, offset in runs.tolist():
        assert first == given_[length]
        given_[length] += slots * n
        for b in range(n):
            bins[base + b] += [(offset + k * length, length) for k in range(slots)]
    assert given_ == collections.Counter(counts)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    # no worse than plain best-fit decreasing
    rooms = []
    for length in sorted((x for k, v in counts.items() for x in [k] * v), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(64 - length)
    assert len(bins) == len(rooms)


def check_packed(rows, ids_of):
    seen, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(seen[doc], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in seen[doc] if r["piece"])
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    return len(places)


@real
def test_packing_real_rows(spark, real_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in real_docs.collect()}
    n = check_packed(packing.packed(real_docs).collect(), ids)
    assert n <= 1.03 * sum(map(len, ids.values())) / 2048 + 1


@real
def test_special_strings_are_one_token(spark):
    """As the JSON tokenizer has them; also in the fallback for texts that the fast matcher can't take."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "<|endoftext>", "a<|ENDOFTEXT|>", "plain  text", PROSE * 50 + "<|endoftext|>"]
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    check_packed(packing.packed(docs).collect(), ids)
    counts = {r["doc_id"]: r["tokens"] for r in document_counts(docs, ("byte_bpe_50k",)).collect()}
    assert counts == {i: len(x) - 1 for i, x in ids.items()}


def test_packing_deals_equal_rows(spark):
    """Rows that are equal throughout still fall to all salts, and each gets a place of its own."""
    rows = packing.packed(spark.createDataFrame([(None, None)] * 3000 + [(1, "a b c")] * 3000, "doc_id long, text string")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 6000 and len({r["sequence_id"] for r in rows}) <= 8


def test_packing_odd_rows(odd, none):
    rows = packing.packed(odd).collect()
    by_id = collections.Counter(r["doc_id"] for r in rows)
    assert by_id[1] == by_id[2] == 1 and by_id[5] == 2 and by_id[None] == 2 and by_id[4] > 10
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.packed(none).count() == 0


# 9 token counts


@real
def test_rollup_matches_a_recount(spark, real_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = queries.op9_token_counts(spark, DATA).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {"words": lambda t: len(brute.words(t)), "byte_bpe_50k": lambda t: len(bpe.encode(t or "", add_special_tokens=False).ids)}
    assert {r["version"] for r in found} == size.keys()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for version, count in size.items():
        expected = collections.defaultdict(lambda: [0, 0])
        for r in real_docs.collect():
            mark = labels.get(r["doc_id"])
            if mark is None or mark["quality"] != 0:
                expected[r["source"], r["lang"]][0] += 1
                expected[r["source"], r["lang"]][1] += 0 if mark is not None and mark["toxic"] == 1 else count(r["text"])
        assert {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in found if r["version"] == version} == {k: tuple(v) for k, v in expected.items() if any(v)}


def test_rollup_batches_commit_once(spark, odd, none):
    counts = document_counts(odd)
    assert counts.count() == 2 * odd.count()
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.apply("a", inserts(counts)) and not rollup.apply("a", inserts(counts))
    first = sorted(map(tuple, rollup.totals().collect()), key=repr)
    assert rollup.apply("b", revisions(counts.withColumn("revised", queries.F.col("tokens") + 1)))
    assert rollup.apply("none", inserts(document_counts(none)))
    rollup.compact()
    assert not rollup.apply("b", inserts(counts)) and rollup.committed() == {"a", "b", "none"}
    again = sorted(map(tuple, rollup.totals().collect()), key=repr)
    assert [(*r[:4], r[4] + r[3]) for r in first] == again
    assert rollup.apply("c", deletes(counts)) and rollup.apply("d", revisions(counts.withColumn("revised", queries.F.col("tokens") - 1)))
    assert rollup.totals().count() == 0
    with pytest.raises(ValueError):
        rollup.apply("x/y", inserts(counts))


# 10 WARC


@pytest.mark.parametrize("records", [[b"x"], [b""] * 3, [b"WARC/1.1 one and the same record"] * 5, [bytes([i % 7]) * (300_000 + i) for i in range(3)], [os.urandom(5000) for _ in range(4)], [str(i).encode() * 50 for i in range(500)]])
def test_archives_of_any_size_have_a_dictionary(records):
    data = warc.archive(records)
    magic, size = np.frombuffer(data[:8], "<u4")
    assert magic == warc.DICTIONARY_MAGIC and size > 0 and list(warc.records_of(data)) == records


def test_archive_round_trips_each_record():
    payloads = [(b"<p>%d " % i + b"some words that all pages share " * 40) for i in range(50)] + [b"", b"x", b"\r\n\r\n" * 9, "é".encode() * 900]
    records = [warc.record(i, f"http://x/{i}\r\nX: y", p, hashlib.sha1(p).hexdigest()) for i, p in enumerate(payloads)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.records_of(data)) == records
    assert len(data) < len(warc.archive(records[:1])) * 30
    fields, block = warc.parse(records[0])
    assert block.partition(b"\r\n\r\n")[2] == payloads[0] and "X" not in fields
    assert list(warc.records_of(warc.archive([]))) == []
    for broken in (data[:-9], b"\0" * 20):
        with pytest.raises(Exception):  # noqa: B017  zstd's own error or ours
            list(warc.records_of(broken))


def test_warc_odd_rows(spark):
    big, other = "x" * 1000, "é" * 700
    rows = [(1, "u", big), (5, None, big), (3, "u", big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", other), (8, "u", other), (9, "u", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", warc.F.lit(1))
    got = collections.Counter(tuple(r) for r in warc.archived(df).collect())
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[(5, 1000, digest(big), "response", None)] == 1 and got[(3, 1000, digest(big), "revisit", 5)] == 2 and got[(1, 1000, digest(big), "revisit", 5)] == 1
    assert got[(2, 5, digest("small"), "response", None)] == got[(4, 5, digest("small"), "response", None)] == 1
    assert got[(6, 0, digest(""), "response", None)] == 1 and got[(None, 1400, digest(other), "revisit", 8)] == 1
    assert sum(got.values()) == len(rows) and warc.archived(df.limit(0)).count() == 0


# the queries and the pipeline


@real
def test_sql_of_the_operators(spark):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        expected = sorted((plain(r[names.index(k)] for k in df.columns) for r in cur.fetchall()), key=repr)
        assert sorted((plain(r) for r in df.collect()), key=repr) == expected


@real
def test_pipeline_matches_brute_force(spark, real_docs):
    import corpus_pipeline as P

    rows = sorted(tuple(r) for r in real_docs.collect())
    ok = brute.verdicts([(t, lang, s) for _, t, lang, s, _ in rows])
    rows = [r for r, k in zip(rows, ok, strict=True) if k]
    least = {d: c for d, _, c in brute.components([r[:2] for r in rows])}
    rows = [r for r in rows if least[r[0]] == r[0]]
    left = brute.deduplicated([r[:2] for r in rows])
    left = {r[0]: w for r, (n, gone, w) in zip(rows, left, strict=True) if not n == gone > 0}
    docs = real_docs
    for i, (_, stage) in enumerate(P.STAGES[:3]):
        docs = stage(spark, docs, DATA)
        assert docs.columns == real_docs.columns, i
    assert {r["doc_id"]: brute.words(r["text"], True) for r in docs.collect()} == left
    taken = mixing.rates(docs).collect()
    copies = {r["doc_id"]: r["copies"] for r in taken if r["copies"]}
    assert sum(len(left[r["doc_id"]]) == r["size"] for r in taken) == len(taken)
    out = P.run(spark, DATA).collect()
    whole = collections.Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert whole == copies and len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_pipeline_odd_rows(spark, odd, none):
    import corpus_pipeline as P

    for start in (odd, none):
        docs = start
        for _, stage in P.STAGES:
            last, docs = docs, stage(spark, docs, "")
            docs.count()
        assert last.columns == start.columns
