"""Toxicity, quality and language: accuracy on held-out documents, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import language_id, quality_classifier, toxicity
from tarnbeck.llm.queries import op4_toxicity, op8_language_id, op9_quality_classifier
from tarnbeck.llm.store import Store
from tarnbeck.llm.text import pieces
from tarnbeck.llm.training import remainder, sample_labels

LARGER = "/root/testdata/sf0.01"


def auc(y, x):
    pos, neg = [a for a, b in zip(x, y, strict=True) if b == 1], [a for a, b in zip(x, y, strict=True) if b == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def held(spark, query, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    return query(spark, LARGER).filter("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", F.col(label).alias("y")).toPandas()


def test_toxicity_held_out(spark):
    p = held(spark, op4_toxicity, "toxic")
    assert auc(p.y, p.score) > 0.9
    assert ((p.score >= 0.7).astype(int) == p.predicted).all()
    assert p[p.y == 0].predicted.mean() < 0.05 and p[p.y == 1].predicted.mean() > 0.75


def test_quality_held_out(spark):
    p = held(spark, op9_quality_classifier, "quality")
    assert auc(p.y, p.score) > 0.97
    assert ((p.score >= 0.3).astype(int) == p.predicted).all()
    assert p[p.y == 1].predicted.mean() > 0.97 and p[p.y == 0].predicted.mean() < 0.2


def test_language_held_out(spark):
    langs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    p = op8_language_id(spark, LARGER).filter("held_out").join(langs, "doc_id").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.98 and p.score.between(0, 1).all()


def test_models_are_deterministic(spark):
    a, b = (op4_toxicity(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    a, b = (op9_quality_classifier(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect() for _ in range(2))
    assert a == b


def test_language_odd_rows(odd, none, documents):
    model = language_id.train(documents)
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert language_id.predict(odd, model).count() == 16
    for i in (3, 4, 5):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[1].lang_pred in model.langs
    assert language_id.predict(none, model).count() == 0
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.train(odd).langs == ["en"]  # null languages and texts are left out


def test_spectrum_kernel_against_sets():
    """The matrix product counts common n-grams as sets do, places of the hash aside."""
    texts = ["the cat sat", "the cat", "zzz", ""]
    (_, _, present), = list(language_id.spectra(pa.array(texts)))
    size = present.sum(axis=1)
    assert size[3] == 0 and (present @ present.T)[0, 1] >= size[1] - 1 and (present @ present.T)[0, 2] == 0


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_labelled_odd_rows(spark, odd, none, documents, small, module, label):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = module.train(documents, labels.unionByName(labels.limit(3).withColumn("doc_id", F.lit(None).cast("long"))), label)
    rows = module.score(odd, model).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(none, model).count() == 0
    assert module.train(documents, labels.limit(0), label) is None
    assert module.score(odd, None).count() == 16
    clear = module.filter_toxic if module is toxicity else module.filter_quality
    kept = clear(odd, model)
    assert kept.columns == odd.columns and kept.count() <= 16
    assert clear(odd, None).count() == 16


def test_toxic_words_are_found(spark, documents):
    model = toxicity.train(spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet"))
    base = documents.filter("length(text) > 2000").select("text").first().text.split()
    bad = list(base)
    for k in range(0, len(bad), 40):
        bad[k] = "idiot"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(bad))], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert s[1] < 0.7 <= s[2]


def test_a_language_with_a_larger_share_of_a_class(spark):
    """Of the toxic documents 7 in 20 are in a language that 1 in 4 of the others is in: its ordinary documents are left alone, and toxic words are found in both."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(3000):
        toxic = int(k % 5 == 0)
        lang = "ab"[int(rng.random() < (0.35 if toxic else 0.25))]
        text = [f"{lang}{n}" for n in np.minimum(rng.geometric(0.04, int(rng.integers(60, 140))), 120)]
        rows.append((k, " ".join([*text, *(["vile", "scum"] if toxic else [])]), toxic, lang, k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string, held int").repartition(4)
    model = toxicity.train(docs, docs.filter("held = 0"))
    found = toxicity.score(docs, model).join(docs, "doc_id").filter("held = 1").toPandas()
    flagged = (found.score >= 0.7).groupby([found.toxic, found.lang]).mean()
    assert flagged[0].max() < 0.01 and flagged[1].min() > 0.99


def counted(texts, slack=toxicity.SLACK):
    """Kneser-Ney of lists of words, counted plainly: a function to the probability of a word after another. The sample is all there is, or `everything`."""

    def grams(rows):
        return [(b, w, k) for k, t in enumerate(rows) for b, w in zip([None, *t], t, strict=False)]

    def model(rows, everything):
        own, every = grams(rows), grams(everything)
        known = {w for t in texts for w in t}
        name = lambda w: w if w is None or w in known else "?"
        lowest = {}
        for _, w in {(name(b), name(w)) for b, w, _ in every}:
            lowest[w] = lowest.get(w, 0) + 1
        lowest["?"] = max(lowest.get("?", 0), 0.5)

        def kept(count, expression, z):
            mean = len({k for b, w, k in every if expression(b, w)}) * len(rows) / len(everything)
            return count * max(1 - (mean + z * (mean + 1) ** 0.5) / len({k for b, w, k in own if expression(b, w)}), 0)

        follows = {w: len({b for b, x, _ in own if x == w}) for _, w, _ in own}
        word = {w: kept(n, lambda b, x, w=w: x == w, slack[0]) for w, n in follows.items()}
        free = 1 - sum(word.values()) / sum(follows.values())
        pairs = {(b, w): kept(sum((b, w) == (x, y) for x, y, _ in own), lambda x, y, b=b, w=w: (x, y) == (b, w), slack[1]) for b, w, _ in own}

        def probability(b, w):
            low = word.get(w, 0) / sum(follows.values()) + free * lowest.get(name(w), 0) / sum(lowest.values())
            seen = max(sum(x == b for x, _, _ in own), 1)
            return pairs.get((b, w), 0) / seen + (1 - sum(n for (x, _), n in pairs.items() if x == b) / seen) * low

        return probability

    return model


def toy(seed=0):
    """Texts of two classes, and more that have no label; some words and pairs are telling."""
    rng = np.random.default_rng(seed)
    plain = [f"w{k}" for k in range(14)]
    toxic = [[*rng.choice(plain, 9), "vile", *rng.choice(plain, 3), "you", "rat"] for _ in range(30)]
    ordinary = [[*rng.choice(plain, 12), *(["kind"] if k % 2 else [])] for k in range(40)]
    return [list(map(str, t)) for t in toxic], [list(map(str, t)) for t in ordinary], [[*map(str, rng.choice(plain, 6)), f"x{k}"] for k in range(50)]


def hashed(texts):
    (piece,) = pieces(pa.array([" ".join(t) for t in texts]))
    return toxicity.hashed_words(piece)


def test_kneser_ney_against_plain_counts(spark):
    """Probabilities and evidence equal a plain count of all documents; the shared counts come from the job itself."""
    toxic, ordinary, rest = toy()
    slack = (0.5, 0.5)
    (tw, tf), (ow, of) = hashed(toxic), hashed(ordinary)
    words = np.unique(np.concatenate([tw, ow]))
    pairs = np.unique(np.concatenate([toxicity.bigram(toxicity.befores(w, f), w) for w, f in ((tw, tf), (ow, of))]))
    docs = spark.createDataFrame([(" ".join(t),) for t in (*toxic, *ordinary, *rest)], "text string").repartition(3)
    shared = toxicity.shared_counts(docs, Store(spark, "test"), words, pairs)
    model = toxicity.ToxicityModel(toxicity.ClassModel(tw, tf, shared, slack), toxicity.ClassModel(ow, of, shared, slack))
    plain = counted([*toxic, *ordinary], slack)
    known = sorted({w for t in (*toxic, *ordinary) for w in t})
    code = {w: hashed([[w]])[0][0] for w in [*known, "never"]}
    for rows, got in ((toxic, model.toxic), (ordinary, model.ordinary)):
        want = plain(rows, [*toxic, *ordinary, *rest])
        assert got.own_pairs.values.max() > 0 or rows is ordinary
        for b in [None, "you", "w3", "never"]:
            all_words = np.array([code[w] for w in [*known, "never"]])
            p = got.probability(all_words, np.full(len(all_words), 1 if b is None else code[b], np.uint64))
            assert np.allclose(p, [want(b, w) for w in [*known, "never"]], rtol=0, atol=1e-9)
            assert abs(p.sum() - 1) < 1e-9
    a, b = plain(toxic, [*toxic, *ordinary, *rest]), plain(ordinary, [*toxic, *ordinary, *rest])
    for texts in (toxic[:3], ordinary[:3], rest[:3], [["vile"], ["never", "you", "rat"]]):
        want = [sum(np.log(a(x, w) / b(x, w)) for x, w in zip([None, *t], t, strict=False)) / (len(t) + toxicity.ADDED) for t in texts]
        assert np.allclose(model.evidence(*hashed(texts)), want, rtol=0, atol=1e-9)
        assert np.allclose(model.compact().evidence(*hashed(texts)), want, rtol=0, atol=1e-9)


def test_all_expressions_are_counted():
    """The class models hold every word and pair of their sample, and shared counts do not depend on how tasks hand them on."""
    texts = toy(1)[0]
    w, f = hashed(texts)
    pairs = toxicity.bigram(toxicity.befores(w, f), w)
    n = len(np.unique(w))
    shared = toxicity.Shared(np.unique(w), np.ones(n + 1), toxicity.in_rows(w, f), toxicity.in_rows(pairs, f), len(texts))
    model = toxicity.ClassModel(w, f, shared)
    assert len(model.follows.keys) == n and len(model.pairs.keys) == len(np.unique(pairs)) and model.pairs.values.sum() == len(w)


def test_what_the_shared_counts_need_not_know():
    """Expressions in too few documents have no mass of their own, so their shared counts make no difference to any other's."""
    texts = toy(3)[0]
    w, f = hashed(texts)
    words, pairs = toxicity.known_expressions([(w, f)])
    n, m = toxicity.in_rows(w, f), toxicity.in_rows(toxicity.bigram(toxicity.befores(w, f), w), f)
    assert set(words) == set(n.keys[n.values > 3]) and set(pairs) == set(m.keys[m.values > 5]) and len(pairs)
    models = []
    for known, known_pairs in ((words, pairs), (n.keys, m.keys)):
        shared = toxicity.Shared(known, np.ones(len(known) + 1), toxicity.Counts(known, n(known) / 9), toxicity.Counts(known_pairs, m(known_pairs) / 9), len(texts))
        models.append(toxicity.ClassModel(w, f, shared))
    assert (models[0].own_words.values == models[1].own_words.values).all() and (models[0].own_pairs.values == models[1].own_pairs.values).all()


def test_shared_counts_handed_on_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(t),) for part in toy(2) for t in part] + [(None,), ("",)], "text string").repartition(2)
    w, f = hashed(toy(2)[0])
    asked = np.unique(w), np.unique(toxicity.bigram(toxicity.befores(w, f), w))
    one = toxicity.shared_counts(docs, Store(spark, "test"), *asked)
    monkeypatch.setattr(toxicity, "HELD", 1)
    two = toxicity.shared_counts(docs, Store(spark, "test"), *asked)
    assert (one.follows == two.follows).all() and (one.word_docs.values == two.word_docs.values).all() and one.docs == two.docs == 122
    assert (one.pair_docs.values == two.pair_docs.values).all() and one.follows[:-1].min() > 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=600) * 0.1 > 0).astype(int)
    m = quality_classifier.fit(x, y, 0.3)
    s = m.scores(x)
    assert m.weight[0] > 0 > m.weight[1] and ((s >= 0.3) == y).mean() > 0.95


def test_ranking_against_plain_gradient():
    """The weights are those at which the logistic loss of the preference pairs is least, and the threshold is the best of all cuts."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=400) > 0.3).astype(int)
    m = quality_classifier.fit(x, y, 0.3, pairs=3000)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    pick = np.random.default_rng(0)
    d = z[pick.choice(np.flatnonzero(y == 1), 3000)] - z[pick.choice(np.flatnonzero(y == 0), 3000)]
    loss = lambda w: sum(np.log1p(np.exp(-v)) for v in d @ w) / 3000 + 0.5e-3 * float(w @ w)
    for k in range(4):
        for step in (-1e-3, 1e-3):
            other = m.weight.copy()
            other[k] += step
            assert loss(m.weight) < loss(other)
    s = m.raw(x)
    wrong = lambda c: (s[y == 0] >= c).mean() + 2 * (s[y == 1] < c).mean()
    assert wrong(m.threshold) <= min(map(wrong, s)) + 0.01
    assert ((m.scores(x) >= 0.3) == (s >= m.threshold)).all()


def test_threshold_is_a_quantile_of_all_documents(spark, documents, small):
    """The quantiles come from every document's score, not from the sample's."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality_classifier.train(documents, labels)
    texts = [r.text for r in documents.collect()]
    s = np.concatenate([model.raw(quality_classifier.features(p)) for p in pieces(pa.array(texts))])
    edges = np.sort(s)[::7]
    got = quality_classifier.corpus_quantiles(documents, model, edges)
    want = [edges[min(sum(e < edge_at for e in edges), len(edges) - 1)] for edge_at in (sorted(s)[max(int(np.ceil(q * len(s))) - 1, 0)] for q in quality_classifier.LEVELS)]
    assert np.allclose(got, want)


def plain_spectrum(text):
    """Places of the n-grams of a text, from its bytes."""
    out, raw = set(), text.lower().encode()
    letter = lambda b: 97 <= b <= 122 or b >= 128
    for n in language_id.LENGTHS:
        for k in range(len(raw) - n + 1):
            if letter(raw[k]) or (n > 1 and letter(raw[k + 1])):
                code = 0
                for b in raw[k : k + n]:
                    code = (code * 257 + (b if letter(b) else 0)) % (1 << 32)
                out.add(int(language_id.mix(np.array([code + (n << 40)], np.uint64))[0]) % language_id.BUCKETS)
    return out


def test_language_against_plain_kernel(spark, documents):
    """Predictions equal those of plain sets, their kernel with the landmarks, and the weights; with every text a landmark, exact kernel ridge regression."""
    rows = documents.filter("length(text) < 1500").limit(60).collect()
    sets = [plain_spectrum(r.text) for r in rows]
    present = np.concatenate([p for _, _, p in language_id.spectra(pa.array([r.text for r in rows]))])
    assert [set(np.flatnonzero(p).tolist()) for p in present] == sets
    kernel = np.array([[len(a & b) / max(np.sqrt(len(a) * len(b)), 1) for b in sets] for a in sets])
    langs, ridge = [r.lang for r in rows], 0.1
    names = sorted(set(langs))
    model = language_id.fit(present, langs, 1000, ridge)
    share = np.diag([1 / langs.count(x) for x in langs])
    target = np.array([[1.0 if y == x else -1.0 for x in names] for y in langs])
    exact = kernel @ np.linalg.solve(share @ kernel + ridge * np.eye(len(rows)), share @ target)
    assert np.allclose(model.scores(present), exact, atol=0.02)
    few = language_id.fit(present, langs, 12, ridge)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(rows), few).collect()}
    marks = [set(np.flatnonzero(m).tolist()) for m in few.landmarks.T]
    s = np.array([[len(a & b) / max(np.sqrt(len(a) * len(b)), 1) for b in marks] for a in sets]) @ few.weights
    for r, values in zip(rows, s, strict=True):
        assert got[r.doc_id][0] == names[values.argmax()]
        assert abs(got[r.doc_id][1] - 1 / np.exp(6 * (values - values.max())).sum()) < 1e-3


def test_very_long_texts(spark, documents, small):
    """Texts of millions of characters are one document to every classifier."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    base = documents.filter("lang = 'en'").orderBy("doc_id").first().text
    df = spark.createDataFrame([(1, base * (2_000_000 // len(base))), (2, base)], "doc_id long, text string")
    for module, label in ((toxicity, "toxic"), (quality_classifier, "quality")):
        rows = module.score(df, module.train(documents, labels, label)).collect()
        assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.predict(df, language_id.train(documents)).collect()} == {"en"}


def test_sample_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as label")
    counts = {r.label: r["count"] for r in sample_labels(labels, "label", 500).groupBy("label").count().collect()}
    assert 400 < counts[0] < 600 and 400 < counts[1] < 600


def test_remainder(spark):
    import zlib

    rows = spark.createDataFrame([(5,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 3).alias("r")).collect()
    assert {r.doc_id: r.r for r in rows} == {5: zlib.crc32(b"5") % 3, None: 0}


def test_features_of_empty_texts():
    (piece,) = list(pieces(pa.array(["", " ", None, "a b"])))
    x = quality_classifier.features(piece)
    assert (x[:3] == x[0]).all() and x[0].sum() == 1 and x[3, 0] > 0
