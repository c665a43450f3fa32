import math
import zlib

import numpy as np
import pytest

from tessella.llm import html_text, language_id, linear, quality_model, toxicity
from tests.llm import data

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held(i, parts, out):
    return zlib.crc32(str(i).encode()) % parts == out


@pytest.mark.parametrize(("run", "label", "parts", "out", "sf"), [(quality_model.op3_quality_classifier, "quality", 4, 2, SF), (toxicity.op10_toxicity, "toxic", 3, 1, LARGER)])
def test_held_out_accuracy(spark, run, label, parts, out, sf):
    got = {r.doc_id: r for r in run(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(i, parts, out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    truth = [(got[r.doc_id].score, r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    ones, zeros = [s for s, y in truth if y == 1], [s for s, y in truth if y == 0]
    auc = np.mean([a > b for a in ones for b in zeros])
    assert auc > 0.94
    assert np.mean([s >= 0.7 for s in ones]) > (0.97 if label == "quality" else 0.82)
    assert np.mean([s >= 0.7 for s in zeros]) < (0.3 if label == "quality" else 0.02)


def test_awkward_rows_are_scored(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (quality_model.score_quality, toxicity.score_toxicity):
        assert run(data.frame(spark), labels).where("score is not null").count() == len(data.rows())
        assert run(data.empty(spark), labels).count() == 0
        assert {r.score for r in run(data.frame(spark), labels.limit(0)).collect()} == {0.5}


def test_ftrl_separates_and_is_sparse():
    rows = [((np.array([0, 1 + i % 2, 3 + i % 50]), np.ones(3)), i % 2) for i in range(400)]
    at, w = linear.train(rows, [[]] * 400, 100, 3, alpha=0.5, l1=3.0, l2=0.0)
    score = linear.Scorer((at, w))
    assert score.margin((np.array([0, 2]), np.ones(2))) > 1 > -1 > score.margin((np.array([0, 1]), np.ones(2)))
    assert len(at) < 20


def test_counterfactuals_even_out_group_names():
    insults = ["those {} are idiot scum", "what a worthless {} idiot"]
    praise = ["the {} came to the market", "we met many {} today", "some {} live here"]
    rows = [(t.format("muslims") + f" w{i}", 1) for i in range(60) for t in insults] + [(t.format("christians") + f" w{i}", 0) for i in range(60) for t in praise]
    neutral = "some muslims live here today"
    score = {p: linear.sigmoid(linear.Scorer(toxicity.fit(rows, penalty=p)).margin(toxicity.features(neutral))) for p in (0.0, 1.0)}
    assert score[1.0] < 0.5 and score[1.0] < score[0.0]
    insult = linear.sigmoid(linear.Scorer(toxicity.fit(rows)).margin(toxicity.features("those christians are idiot scum")))
    assert insult > 0.7


def test_counterfactuals_exist_on_any_text():
    words = [toxicity.vocabulary(data.text(i)) for i in range(200)] + [{"some", "women", "here"}]
    made = toxicity.counterfactuals(words)
    assert [c for i, w, c in made if i == 200] == [[{"some", x, "here"} for x in ("men", "girls", "boys")]]
    put_in = [(i, w, c) for i, w, c in made[:-1] if c]
    assert len(put_in) == 50 and all(len(w - words[i]) == 1 and words[i] in c and len(c) == 2 for i, w, c in put_in)


def test_fitted_model_equals_plain_updates():
    """The sparse FTRL against the same updates with dictionaries, penalty included."""
    texts = [(f"the {x} {'idiot' if k % 3 == 0 else 'river'} w{k % 7}", int(k % 3 == 0)) for k, x in enumerate(["women", "men", "stone"] * 12)]
    at, w = toxicity.fit(texts, epochs=3)
    learned = toxicity.counterfactuals([toxicity.vocabulary(t) for t, _ in texts])
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / toxicity.RATE)

    def update(gradients):
        for i, g in [(i, g) for i, g in gradients.items() if g]:
            before, now = n.get(i, 0.0), n.get(i, 0.0) + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(now) - math.sqrt(before)) / toxicity.RATE * weight(i) if i in z else g
            n[i] = now

    order, rng = np.arange(len(learned)), np.random.default_rng(7)
    slots = lambda words: set(toxicity.row_of(words)[0].tolist())
    for _ in range(3):
        rng.shuffle(order)
        for k in order:
            row, words, copies = learned[k]
            own = slots(words)
            p = 1 / (1 + math.exp(-sum(map(weight, own))))
            update({i: p - texts[row][1] for i in own})
            for copy in copies:
                other = slots(copy)
                sign = {i: (i in own) - (i in other) for i in own ^ other}
                apart = sum(weight(i) * v for i, v in sign.items())
                update({i: 2 * toxicity.PENALTY * apart * v for i, v in sign.items()})
    expected = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w)) == pytest.approx(expected, abs=1e-6)


def test_quality_scores_equal_plain_updates():
    """Features by counting, and the same updates with dictionaries; scores from the whole text."""
    texts = [("good plain words in a row " * 3 + data.text(k, 20), 1) if k % 2 else ("# % & bad bad " * 6, 0) for k in range(30)]
    at, w = quality_model._fit(texts)
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= 0.3 else (math.copysign(0.3, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.3 + 0.5)

    order, rng = np.arange(30), np.random.default_rng(7)
    for _ in range(quality_model.EPOCHS):
        rng.shuffle(order)
        for k in order:
            row = dict(zip(*(x.tolist() for x in quality_model.features(texts[k][0]))))
            p = 1 / (1 + math.exp(-sum(weight(i) * x for i, x in row.items())))
            for i, x in row.items():
                g, before = (p - texts[k][1]) * x, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / 0.3 * weight(i)
                n[i] = before + g * g
    assert dict(zip(at.tolist(), w)) == pytest.approx({i: weight(i) for i in z if abs(z[i]) > 0.3}, abs=1e-6)


def test_language_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language_id.op5_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    out = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(out) > 0.97
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    got = language_id.identify_languages(data.frame(spark)).collect()
    assert len(got) == len(data.rows())
    assert {r.lang_pred for r in got if r.doc_id in (300, 301, 302)} == {"und"}
    assert {r.lang_pred for r in got} <= {"und", "en", "fr", "de"}
    assert language_id.identify_languages(data.empty(spark)).count() == 0


def test_sixty_languages(spark):
    """Each of many languages is learned and told, and no repeated id multiplies the sample."""
    import random

    def text(lang, seed):
        rng = random.Random(seed)
        letters = chr(0x4E00 + 2 * lang) + chr(0x4E01 + 2 * lang) + "aeio"
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))

    rows = [(i, text(i % 60, i), f"l{i % 60:02}") for i in range(60 * 20)] + [(1, text(1, 5000 + k), "l01") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample_of(docs).groupBy("lang").count().collect()
    assert len(sample) == 60 and {r["count"] for r in sample} == {20}
    got = language_id.identify_languages(docs).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 60:02}" and r.score > 0.5 for r in got) and len(got) == len(rows)


def test_scores_equal_brute_force():
    """Kernels from sets, weights from least squares on stacked equations."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefg " if k % 2 else "defghij "), 60)) for k in range(40)]
    labels = ["x" if k % 2 else "y" for k in range(40)]
    model = language_id.fit([np.packbits(language_id.presences(t)) for t in texts], labels, per_language=10).prepared()
    _, got = model.score(np.stack([language_id.presences(t) for t in texts]))
    held_in = [set(np.flatnonzero(language_id.presences(t)).tolist()) for t in texts]
    like = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [k for x in ("x", "y") for k in [i for i in range(40) if labels[i] == x][:10]]
    values, vectors = np.linalg.eigh(np.array([[like(held_in[a], held_in[b]) for b in marks] for a in marks]))
    features = np.array([[like(held_in[a], held_in[b]) for b in marks] for a in range(40)]) @ vectors / np.sqrt(values)
    best = np.full(40, -9.0)
    for x in ("x", "y"):
        y = np.array([1.0 if v == x else -1.0 for v in labels])
        centre = features.mean(axis=0)
        equations = np.vstack([features - centre, np.sqrt(language_id.RIDGE * 40) * np.eye(20)])
        w = np.linalg.lstsq(equations, np.concatenate([y - y.mean(), np.zeros(20)]), rcond=None)[0]
        best = np.maximum(best, (features - centre) @ w + y.mean())
    assert np.allclose(got, np.clip((best + 1) / 2, 0, 1), atol=2e-3)


def test_kernel_counts_shared_presences():
    a, b = language_id.presences("abc"), language_id.presences("abd")
    k = language_id.kernel(np.stack([a]), np.stack([b]))[0, 0]
    assert k == pytest.approx((a & b).sum() / np.sqrt(a.sum() * b.sum()))
    assert language_id.presences("").sum() == 0
    long = "the quick brown fox " * 80_000
    assert (language_id.presences(long) == language_id.presences("the quick brown fox " * 3)).all()


@pytest.mark.parametrize("n, each", [(4, {24}), (30, {13, 14}), (450, {1})])
def test_every_language_has_landmarks(n, each):
    rng = np.random.default_rng(3)
    count = 30 if n < 100 else 2
    rows = np.zeros((n * count, language_id.DIMENSIONS), bool)
    rows[:, 1000:1200] = rng.random((n * count, 200)) < 0.3
    rows[np.arange(n * count), np.arange(n * count) % n] = True  # a presence of each language's own
    model = language_id.fit(list(np.packbits(rows, axis=1)), [f"l{i % n:03}" for i in range(n * count)]).prepared()
    assert set(model.landmarks[:, :n].sum(axis=0).astype(int)) == each
    assert (model.landmarks[:, :n].argmax(axis=1) == np.sort(model.landmarks[:, :n].argmax(axis=1))).all()


def test_lstm_gradients_are_right():
    rng = np.random.default_rng(1)
    model = html_text.Labeller()
    model.w = [w.astype(np.float64) for w in model.w]
    x, mask = rng.standard_normal((3, 5, html_text.WIDTH)), np.ones((3, 5))
    mask[0, 3:] = 0
    x *= mask[:, :, None]
    y = rng.integers(0, 2, (3, 5)).astype(float)

    def loss():
        p = model.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for w, g in zip(model.w, grads):
        for k in rng.choice(w.size, 12, replace=False):
            at = np.unravel_index(k, w.shape)
            old = w[at]
            w[at] = old + 1e-4
            up = loss()
            w[at] = old - 1e-4
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_labeller_equals_plain_cells():
    """Scores of two pages in one batch against LSTM cells written out step by step."""
    rng = np.random.default_rng(6)
    model = html_text.Labeller()
    pages = [rng.standard_normal((n, html_text.WIDTH)).astype(np.float32) for n in (7, 3)]
    got = model.scores(*html_text.padded(pages))
    h = html_text.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def states(rows, w):
        hidden, cell, out = [0.0] * h, [0.0] * h, []
        for x in rows:
            z = [*x, *hidden] @ w.astype(np.float64)
            for k in range(h):
                cell[k] = sigmoid(z[h + k]) * cell[k] + sigmoid(z[k]) * math.tanh(z[3 * h + k])
            hidden = [sigmoid(z[2 * h + k]) * math.tanh(cell[k]) for k in range(h)]
            out.append(hidden)
        return out

    for row, page in zip(got, pages):
        both = zip(states(page, model.w[0]), states(page[::-1], model.w[1])[::-1])
        expected = [sigmoid(float(np.dot([*a, *b], model.w[2][:-1]) + model.w[2][-1])) for a, b in both]
        assert row[: len(page)] == pytest.approx(expected, abs=1e-4)


def article_text(page):
    import html
    import re

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner.replace("<br>", " ")))
    return "\n".join(p for p in parts if p)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_text.op7_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    assert np.mean([r.text == article_text(pages[r.page_id]) for r in got]) > 0.99
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_outside_the_sample():
    """Pages that weren't learned from: as they are, with plain containers, without any telling
    element or name, and with readers' comments that nothing names."""
    import re

    import pandas as pd

    pages = pd.read_parquet(f"{LARGER}/pages.parquet").sort_values("page_id").html.tolist()
    model = html_text.Labeller(html_text.fit(pages[: html_text.SAMPLE_PAGES]))
    unseen = pages[-300:]
    expected = [article_text(p) for p in unseen]
    plain = lambda p: re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", p)
    bare = lambda p: re.sub(r"<(/?)(?:nav|aside|footer|header|article|main|section)\b", r"<\1div", re.sub(r'\s(?:class|id)="[^"]*"', "", p))
    said = lambda p: p.replace("</article>", '</article><div class="zz-q"><div><p>I think that this is right, thank you.</p></div><div><p>No, it is not what I saw.</p></div></div>')
    for change in (lambda p: p, plain, bare, said, lambda p: plain(said(p)), lambda p: bare(said(p))):
        got = html_text.main_texts(model, [change(p) for p in unseen])
        assert np.mean([g == e for g, e in zip(got, expected)]) >= 0.95


@pytest.mark.parametrize("part", ["<div><p>x", "<a '", "<a ='>' ", '<a ="', "</q>", "<!", "<b><p>x", "<td title='"])
def test_hostile_pages_take_linear_time(part):
    import time

    model = html_text.Labeller()
    took = []
    for size in (20_000, 160_000):
        start = time.process_time()
        html_text.main_texts(model, [part * (size // len(part))])
        took.append(time.process_time() - start)
    assert took[1] < 16 * max(took[0], 0.05)


def test_long_pages_are_read_whole(monkeypatch):
    """However many blocks are read side by side, each page is read from end to end and back."""
    pages = ["".join(f"<div><p>words {i * k} and {'more ' * (i % 7)}</p></div>" for i in range(n)) for k, n in enumerate((2_500, 3, 40))]
    model = html_text.Labeller()
    rng = np.random.default_rng(2)
    model.w = [w + rng.normal(0, 0.4, w.shape).astype(np.float32) for w in model.w]
    middle = float(np.median(model.scores(*html_text.padded([html_text.vectors(html_text.blocks(pages[0]))]))))
    model.w[2][-1] -= np.log(middle / (1 - middle))  # half of the blocks are main text
    expected = []
    for p in pages:
        found = html_text.blocks(p)
        scores = model.scores(*html_text.padded([html_text.vectors(found)]))[0]
        expected.append("\n".join(b.text for b, s in zip(found, scores) if s >= 0.5))
    assert 0 < expected[0].count("\n") < 2_400
    for cells in (10, 100, html_text.CELLS_AT_ONCE):
        monkeypatch.setattr(html_text, "CELLS_AT_ONCE", cells)
        assert html_text.main_texts(model, pages) == expected


def test_repeated_ids_dont_multiply_the_sample(spark):
    """One row of an id is learned from, whatever repeats."""
    from tessella.llm.linear import labelled_sample

    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] * 3, "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 3, 99, 100).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted([(i, min(f"text {j}" for j in range(500) if j % 5 == i)) for i in range(5)] + [(7, None)], key=str)


def test_broken_markup():
    text = lambda p: [b.text for b in html_text.blocks(p)]
    assert text("a<p>b<p>c</i></p>d") == ["a", "b", "c", "d"]
    assert text("<p title=\"x > y\">b</p><p title='open>c<p>d") == ["b", "c", "d"]
    assert text("x < y and <b") == ["x < y and <b"]
    assert text("<script>a<p>b</script >c<style>d") == ["c"]
    assert text("<ul><li>a<li>b</ul><b>c<p>d</b>e") == ["a", "b", "c", "de"]


def test_awkward_pages(spark):
    good = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One &amp; <b>two</b>\n three<!-- no --></p></article><aside><p>Other news</p></aside><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", good, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (4, "u", "<<<>>>&#0;</div></div>", "x"), (1, "u", good, "x")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6
    assert [r.text for r in got if r.page_id == 1] == ["Head\nOne & two three"] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
