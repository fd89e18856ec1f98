"""Language identification, quality rules and toxicity: held-out accuracy and brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import pyarrow as pa

from siftline.llm import langid, quality, toxicity

from .conftest import SF

MID = "/root/testdata/sf0.01"


def test_language_held_out(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.op1_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_not_read_from_labels(spark, docs):
    model = langid.train(langid.learning_rows(docs))
    renamed = docs.selectExpr("doc_id", "text", "'xx' as lang", "source")
    assert sorted(map(tuple, langid.identify(docs, model).collect())) == sorted(map(tuple, langid.identify(renamed, model).collect()))


def test_language_grams_by_hand():
    """Each text has the n-grams of its letters, blanks at its ends included, whatever stands beside it."""
    texts = ["Ab c", "", "é", "12", "xyz"]
    together, lettered = langid.gram_buckets(texts)
    for k, text in enumerate(texts):
        alone, own = langid.gram_buckets([text])
        assert own[0] == lettered[k] == any(c.isalpha() for c in text)
        for n, ((a, o), (b, p)) in enumerate(zip(together, alone), 1):
            assert a[o[k]:o[k + 1]].tolist() == b[p[0]:p[1]].tolist()
            padded = f" {text} "
            assert p[1] - p[0] == sum(any(c.isalpha() for c in padded[i:i + n]) for i in range(len(padded) - n + 1)), (text, n)


def test_language_scores_by_hand(spark, docs):
    model = langid.train(docs)
    texts = [r["text"] for r in docs.limit(5).collect()]
    names, scores = langid.score_texts(model, texts)
    for text, name, score in zip(texts, names, scores):
        total = model.prior.copy()
        for grams, _ in langid.gram_buckets([text])[0]:
            for g, n in Counter(grams.tolist()).items():
                total += n * model.matrix[g].astype(float) / 3
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert name == model.languages[int(share.argmax())] and abs(score - share.max()) < 1e-3


def test_language_edges(spark, edge_docs, no_docs, docs):
    model = langid.train(docs)
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    unknown = [r for r in rows if r["lang_pred"] == "und"]
    assert sorted(repr(r["doc_id"]) for r in unknown) == sorted(["None", "2", "3", "3", "4", "5"]) and all(r["score"] == 0 for r in unknown)
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.identify(edge_docs, empty).collect()} == {"und"}
    langid.train(edge_docs)


def brute_statistics(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics(docs, edge_docs):
    texts = [r["text"] for r in docs.unionByName(edge_docs.select(docs.columns)).collect()]
    texts += ["a b\na b\n\n a b\n", "\n\n", " \n \n", "a b c a b c", "a\na\na", "a\rb\rb", "###\n###"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert tuple(int(got[c][k]) for c in quality._STATS) == brute_statistics(text)


def brute_kneser_ney(texts, order, least):
    """Textbook form, over tuples of code points; None is the edge of a text. Probability of a gram by a level."""
    levels = {order: Counter()}
    for text in texts:
        codes = [None] * (order - 1) + list(text) + [None]
        levels[order].update({tuple(codes[i: i + order]) for i in range(len(codes) - order + 1)})
    held = {order: {g for g, n in levels[order].items() if n >= least}}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
        held[n] = {g for g, c in levels[n].items() if c >= 2 or n == 1} | {g[1:] for g in held[n + 1]}

    def discounts(c):
        t = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        d = [min(max(k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5 * k, 0.05), k) for k in (1, 2, 3)]
        return [min(d[0], 0.95), *d[1:]]

    cuts = {n: discounts(levels[n]) for n in levels}

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 1 / quality.SYMBOLS
        own = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return prob(gram[1:])
        cut = {g: cuts[n][min(c, 3) - 1] if g in held[n] else c for g, c in own.items()}
        total = sum(own.values())
        return (own.get(gram, 0) - cut.get(gram, 0)) / total + sum(cut.values()) / total * prob(gram[1:])

    return prob


TONGUES = {"en": ["abracadabra abra", "cadabra bar", "bar", "a bar of abra", "xyz abra"],
           "ru": ["молоко и масло", "масло и молоко", "молоко", "колокол около молока"],
           "zh": ["日本語の本", "本日は日本語", "日本の本", "語学の本"], "": ["", None, "abra"]}


@pytest.mark.parametrize("order, least", [(5, 2), (3, 1), (4, 2)])
def test_kneser_ney_by_hand(spark, order, least):
    """Perplexities of whole texts, and that the probabilities after a context sum to one."""
    rows = [(i, text, lang or None) for i, (lang, text) in enumerate((k, t) for k, v in TONGUES.items() for t in v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = quality.fit_model(quality.count_grams(docs, order), order, least)
    new = [(100, "abra bra zz", "en"), (101, "масло из колокола", "ru"), (102, "日本語", "zh"), (103, "日本語", "en"), (104, "日本語", "xx")]
    both = docs.union(spark.createDataFrame(new, docs.schema))
    got = {r["doc_id"]: r for r in quality.measure(both, model).collect()}
    for i, text, lang in rows + new:
        if lang == "xx":
            assert got[i]["log_ppl"] is None and got[i]["log_ppl_short"] is None
            continue
        prob = brute_kneser_ney([t or "" for t in TONGUES[lang or ""]], order, least)
        codes = [None] * (order - 1) + list(text or "") + [None]
        grams = [tuple(codes[k: k + order]) for k in range(len(codes) - order + 1)]
        for column, skip in (("log_ppl", 0), ("log_ppl_short", 1)):
            assert abs(got[i][column] + np.mean([np.log(prob(g[skip:])) for g in grams])) < 1e-9
    head, tail, _ = quality.grams(["молок"], order)
    every = np.arange(quality.SYMBOLS)
    same = lambda x: np.full(len(every), x)
    for h, t in [(head[-2], tail[-2]), (head[0], tail[0])]:
        logs = model.log_probability(same(quality._seed("ru")).astype(np.uint64), same(h), t >> quality.BITS << quality.BITS | every)
        assert all(abs(np.exp(x).sum() - 1) < 1e-9 for x in logs)


def test_verdict_by_hand(spark):
    """``kept`` follows from the statistics and the bands of each language by numpy."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = quality.judge(docs).collect()
    lang = {r["doc_id"]: r["lang"] or "" for r in docs.collect()}
    for name in set(lang.values()):
        own = [r for r in rows if lang[r["doc_id"]] == name]
        sound = [r for r in own if not r["base_failed"]]
        inside = {r["doc_id"]: not r["base_failed"] for r in own}
        for c in ("log_ppl", "log_ppl_short"):
            v = np.sort([r[c] for r in sound])
            middle = v[(len(v) - 1) // 2]
            away = np.sort(abs(v - middle))
            width = max(1.4826 * away[(len(v) - 1) // 2], quality.NARROWEST)
            for r in own:
                inside[r["doc_id"]] &= middle - quality.BELOW * width <= r[c] <= middle + quality.ABOVE * width
        assert {r["doc_id"]: r["kept"] for r in own} == inside


def test_model_in_ranges(spark, docs, monkeypatch):
    """Many small ranges, groups and gatherings give the same perplexities, and the model grows with the corpus."""
    model = quality.fit_model(quality.count_grams(docs))
    want = sorted((r["doc_id"], r["log_ppl"], r["log_ppl_short"]) for r in quality.measure(docs, model).collect())
    monkeypatch.setattr(quality, "RANGE", 3000)
    monkeypatch.setattr(quality, "GROUP_BYTES", 5000)
    monkeypatch.setattr(quality, "GATHERED", 5000)
    small = quality.fit_model(quality.count_grams(docs))
    assert len(small.files) > 10 and len(model.files) == 1
    got = sorted((r["doc_id"], r["log_ppl"], r["log_ppl_short"]) for r in quality.measure(docs, small).collect())
    assert np.allclose(got, want, atol=1e-12)
    half = quality.entries(quality.count_grams(docs.where("doc_id % 2 = 0"))).count()
    assert quality.entries(quality.count_grams(docs)).count() > 1.2 * half


def test_quality(spark, edge_docs, no_docs):
    rows = quality.op2_quality_rules(spark, MID).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    sound = [r for r in rows if not r["base_failed"] and label.get(r["doc_id"]) == 1]
    assert np.mean([r["kept"] for r in sound]) > 0.98
    edge = quality.judge(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(not r["kept"] for r in edge if r["n_words"] < 50)
    assert quality.judge(no_docs).count() == 0


def test_quality_band_over_labels(spark):
    """Either side of the band rejects labelled junk and hardly any good document."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = lambda **band: {r["doc_id"]: r for r in quality.judge(docs, **band).where("not base_failed").collect()}
    whole, upper = judged(), judged(below=1e9)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    kept = lambda rows, value: np.mean([r["kept"] for i, r in rows.items() if label.get(i) == value])
    assert kept(whole, 1) > 0.98 and kept(upper, 1) > 0.98
    assert kept(upper, 0) < 0.75 and kept(whole, 0) < 0.4
    assert not any(whole[i]["kept"] for i in (78, 270, 367))


def test_perplexity_of_strange_texts(spark, docs):
    """Noise is far above what the language's documents have; one word over and over fails the base rules."""
    rng = np.random.default_rng(2)
    noise = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(200))
    english = docs.where("lang = 'en'").select("doc_id", "text", "lang")
    models = quality.fit_model(quality.count_grams(english))
    own = [r["log_ppl"] for r in quality.measure(english, models).where("n_words >= 50").collect()]
    more = spark.createDataFrame([(1, noise, "en"), (2, "the " * 200, "en"), (3, noise, "fr"), (4, None, "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality.measure(more, models).collect()}
    got = {i: r["log_ppl"] for i, r in rows.items()}
    assert got[1] > max(own) + 0.5 and got[3] is None and got[4] > 0
    # counted once a document, one word over and over is not likely any more; the base rules reject it
    assert 100 * rows[2]["n_repeat_words"] > 50 * rows[2]["n_words"]


def brute_marginals(field, given, cuts):
    u = field.weights[given].sum(axis=1) + field.bias
    out, pairs = [], np.zeros((2, 2))
    for a, b in itertools.pairwise(cuts):
        weight, single = 0.0, np.zeros(b - a)
        both = np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(u[a + k] for k in range(b - a) if tags[k]) + sum(field.transition[x, y] for x, y in itertools.pairwise(tags)))
            weight += w
            single += w * np.array(tags)
            for x, y in itertools.pairwise(tags):
                both[x, y] += w
        out += (single / weight).tolist()
        pairs += both / weight
    return np.array(out), pairs


def test_field_marginals():
    rng = np.random.default_rng(4)
    given = rng.integers(0, 9, (17, 3))
    field = toxicity.Field(rng.normal(size=10), -0.3, rng.normal(size=(2, 2)), np.zeros(3))
    cuts = np.array([0, 1, 6, 8, 17])
    p, pairs = field.marginals(given, cuts, pairs=True)
    want, want_pairs = brute_marginals(field, given, cuts)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_toxicity_held_out(spark):
    rows = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, MID).collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    groups = defaultdict(list)
    for i, r in rows.items():
        if r["held_out"] and i in label:
            groups[label[i]].append(r["score"])
    assert np.mean(np.array(groups[0]) < 0.5) > 0.9 and np.mean(groups[1]) > np.mean(groups[0]) + 0.3


def test_toxic_spans(spark, edge_docs, no_docs):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(200):
        own = list(rng.choice(words, 40))
        if k % 2:
            own[int(rng.integers(40))] = "badword"
        texts.append(" ".join(own) + ".")
        toxic.append(k % 2)
    field = toxicity.fit(texts, np.array(toxic))
    docs = spark.createDataFrame([(1, "É w1 w2 BadWord w3. Fine w4"), (2, "w1 w2 w3")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, field).collect()}
    assert found[1]["score"] > 0.5 > found[2]["score"] and [(s["start"], s["end"]) for s in found[1]["spans"]] == [(8, 15)] and found[2]["spans"] == []
    edge = toxicity.score_documents(edge_docs, field).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score_documents(no_docs, field).count() == 0
    for some in ([], [True], [False, False]):
        one = toxicity.fit(["a b"] * len(some), np.array(some))
        assert 0 <= toxicity.score_documents(docs, one).first()["score"] <= 1


def _with_bad_words(rng, n, bad, words):
    """n toxic texts with one of the bad words each, and 3 n clean ones."""
    texts = [list(rng.choice(words, 40)) for _ in range(4 * n)]
    for k in range(n):
        texts[k][int(rng.integers(40))] = bad[k % len(bad)]
    return [" ".join(t) + "." for t in texts], np.arange(4 * n) < n


def test_toxic_weight_is_not_shared(spark):
    """A clean word whose hash begins like that of a toxic one is scored as any unknown word."""
    words = [f"w{k}" for k in range(300)]
    field = toxicity.fit(*_with_bad_words(np.random.default_rng(7), 100, ["badword"], words))
    many = [f"q{k}" for k in range(3_000_000)]
    hashes = toxicity.tokens_of(pa.array([" ".join(many)])).hashes >> np.uint64(46)
    twins = [many[k] for k in np.flatnonzero(hashes == toxicity.tokens_of(pa.array(["badword"])).hashes[0] >> np.uint64(46))[:3]]
    assert twins
    rows = [(0, "w1 w2 badword w3."), (1, "w1 w2 unheard w3."), *((k, f"w1 w2 {t} w3.") for k, t in enumerate(twins, 2))]
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert got[0]["score"] > 0.5 and all(got[k]["score"] == got[1]["score"] < 0.5 and not got[k]["spans"] for k, _ in rows[1:])


def test_toxicity_of_few_labels(spark):
    """Fifteen toxic texts are enough to learn from; without a word to go by no text is toxic."""
    words, bad = [f"w{k}" for k in range(300)], ["badone", "badtwo", "badthree"]
    rng = np.random.default_rng(8)
    few = toxicity.fit(*_with_bad_words(rng, 15, bad, words))
    blank = toxicity.fit(_with_bad_words(rng, 15, ["w1"], words)[0], np.arange(60) < 15)
    texts, toxic = _with_bad_words(rng, 30, bad, words)
    fresh = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = lambda field: {r["doc_id"]: r["score"] for r in toxicity.score_documents(fresh, field).collect()}
    learned, unlearned = score(few), score(blank)
    assert np.mean([(learned[k] >= 0.5) == bool(toxic[k]) for k in range(len(texts))]) > 0.95
    assert all(s < 0.5 for s in unlearned.values())
    assert toxicity.fit(["a b", "c d", "e f"], np.array([True, True, False])).documents(np.zeros(1), np.array([0, 1]))[0] < 0.5
