import numpy as np
import pytest
from pyspark.sql import functions as F

from codegrain.llm import langid, quality_classifier
from codegrain.llm.common import remainder, table
from codegrain.llm.queries import op4_quality_classifier, op10_language_id

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    out, last = [" "], " "
    for ch in (text or "").lower():
        ch = ch if ch.isalpha() else " "
        if ch != " " or last != " ":
            out.append(ch)
        last = ch
    s = "".join(out) + (" " if last != " " else "")
    s = s if s.endswith(" ") else s + " "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} if s.strip() else set()


@pytest.mark.parametrize("text", [None, "", "123 !", "Ab  c1d", "é", "ÀÉ zß-zß", "中文 abc", "x" * 10])
def test_grams(text):
    got = langid.grams(text)
    decode = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0) if g >> s & (1 << 21) - 1)
    want = plain_grams(text)
    if want:  # both ends count as spaces; two spaces never follow each other inside
        assert {decode(int(g)) for g in got} - {"  "} == want - {"  "}
    else:
        assert len(got) == 0


def test_kernel_is_presence_over_the_mean_of_sizes():
    texts = [langid.grams(t) for t in ("the cat sat", "le chat noir", "", "12", "cats that sit")]
    marks = [texts[0], texts[1]]
    got = langid.landmarks(marks).kernel(texts)
    for i, x in enumerate(texts):
        for j, y in enumerate(marks):
            want = len(set(x.tolist()) & set(y.tolist())) / np.sqrt(len(x) * len(y)) if len(x) else 0
            assert got[i, j] == pytest.approx(want, abs=1e-6)


def test_language_of_held_out_texts(spark):
    got = {r["doc_id"]: r for r in op10_language_id(spark, SF).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in table(spark, SF, "documents").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([lang == r["lang_pred"] for lang, r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


ODD = [(1, None, "en"), (2, "", None), (3, "1234 !!", "de"), (None, "the and", "en"), (4, "le la", "fr"), (4, "le la", "fr"), (5, "the of and " * 20_000, "en"), (6, "Привет мир", None)]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got][:3] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == len(ODD)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 4, 5}
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.keep_known(docs, None).count() == 5
    assert langid.predict(docs.limit(0), model).count() == 0


def test_quality_of_held_out_texts(spark):
    marks = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    held = [(marks[r["doc_id"]], r["score"], r["predicted"]) for r in op4_quality_classifier(spark, SF).collect() if r["held_out"] and r["doc_id"] in marks]
    good, bad = ([s for q, s, _ in held if q == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([q == p for q, _, p in held]) > 0.9


def copied(spark, tmp_path, **changed):
    for name in ("documents", "labels"):
        changed.get(name, table(spark, "/root/testdata/sf0.001", name)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_queries_do_not_look_at_held_out_labels(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    flipped = labels.withColumn("quality", F.when(remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert flipped.exceptAll(labels).count() > 5
    assert rows(op4_quality_classifier(spark, copied(spark, tmp_path / "a", labels=flipped))) == rows(op4_quality_classifier(spark, small))
    other = docs.withColumn("lang", F.when(remainder(F.col("doc_id"), 3) == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("elsewhere"))
    assert rows(op10_language_id(spark, copied(spark, tmp_path / "b", documents=other))) == rows(op10_language_id(spark, small))


def test_features_and_network_are_those_of_a_plain_pass():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(quality_classifier.SLOTS, quality_classifier.DIMS)).astype(np.float32)
    ids = quality_classifier.tokens("some words, SOME words and some more " * 9)
    taken = [vectors[i].astype(float) for i in ids]
    mean = sum(taken) / len(taken)
    spread = np.sqrt(sum((v - mean) ** 2 for v in taken) / len(taken))
    assert np.allclose(quality_classifier.pooled(ids, vectors), [*mean, *spread], atol=1e-4)
    x = rng.normal(size=(4000, 6))
    y = (x[:, 0] - x[:, 1] ** 2 > -0.5).astype(float)
    net = quality_classifier.fit(x, y)
    w1, b1, w2, b2 = net.layers
    for row, p in zip(x[:20], net.probability(x[:20]), strict=True):
        scaled = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        inner = [np.tanh(sum(a * w1[i, j] for i, a in enumerate(scaled)) + b1[j]) for j in range(w1.shape[1])]
        out = sum(h * w2[j, 0] for j, h in enumerate(inner)) + b2[0]
        assert p == pytest.approx(1 / (1 + np.exp(-out / net.temperature)), abs=1e-9)
    fresh_x = rng.normal(size=(2000, 6))
    truth = fresh_x[:, 0] - fresh_x[:, 1] ** 2 > -0.5
    assert ((net.probability(fresh_x) > 0.5) == truth).mean() > 0.9
    # calibrated: no other temperature of the grid does better on the fifth held back
    held = np.random.default_rng(3).permutation(4000)[:800]
    raw = net.logits(x[held])
    loss = [np.logaddexp(0, -np.where(y[held] > 0.5, raw, -raw) / t).mean() for t in np.geomspace(0.25, 8, 61)]
    assert net.temperature == np.geomspace(0.25, 8, 61)[int(np.argmin(loss))]


def test_regression_on_landmarks_is_plain_kernel_ridge_where_all_texts_are_landmarks():
    texts = [langid.grams(t) for t in ("the cat sat there", "this is the hat", "le chat est la", "la rue et le pain", "das ist der Hund", "der Mann und die Frau")]
    labels = ["en", "en", "fr", "fr", "de", "de"]
    model = langid.landmarks(texts)
    values = model.kernel(texts).astype(float)
    solved = langid.solve(model, values, labels, ridge=0.1)
    gram = np.array([[len(set(a.tolist()) & set(b.tolist())) / np.sqrt(len(a) * len(b)) for b in texts] for a in texts])
    sign = np.array([[1.0 if x == n else -1.0 for n in ("de", "en", "fr")] for x in labels])
    # every language has two texts, each of weight 1/2: (K/2 + ridge) alpha = Y/2 in the space of the kernel
    dual = np.linalg.solve(gram / 2 + 0.1 * np.eye(6), sign / 2)
    asked = [langid.grams(t) for t in ("the dog and the cat", "der Hund ist da", "le chien")]
    cross = np.array([[len(set(a.tolist()) & set(b.tolist())) / np.sqrt(len(a) * len(b)) for b in texts] for a in asked])
    assert solved.names == ["de", "en", "fr"]
    assert np.allclose(solved.kernel(asked) @ solved.coefficients, cross @ dual, atol=1e-4)


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c a", "b b, C", None, ""]
    got = quality_classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), seed=1)
    places, signs = quality_classifier.index_vectors(1)
    want = np.zeros((quality_classifier.SLOTS, quality_classifier.DIMS))
    for t in texts:
        ids = quality_classifier.tokens(t)
        for i, x in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(want[x], places[ids[j]], signs[ids[j]])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in ODD], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (5, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    one = quality_classifier.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality_classifier.score(docs, one).collect()} == {1.0}
    assert quality_classifier.score(docs.limit(0), one).count() == 0


@pytest.mark.parametrize(("most", "least"), [(1024, 0.97), (200, 0.8)])
def test_every_language_is_learned(spark, most, least):
    """300 languages of their own syllables; in the second case a third of them have no landmark and are told by others."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéèßñçøåþ"))
    syllables = [["".join(rng.choice(letters, rng.integers(2, 4))) for _ in range(12)] for _ in range(300)]
    text = lambda k: " ".join("".join(rng.choice(syllables[k], rng.integers(1, 4))) for _ in range(40))
    rows = [(i, text(i % 300), f"l{i % 300:03d}", "x", 1) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int").repartition(6)
    learned = docs.where("doc_id % 8 <> 0 or doc_id % 300 = 7")
    model = langid.train(learned, per_language=20, most_landmarks=most)
    assert model.names == sorted({r[2] for r in rows}) and len(model.scale) <= most
    right = {r[0]: r[2] for r in rows}
    got = [r for r in langid.predict(docs, model).collect() if r["doc_id"] % 8 == 0]
    assert np.mean([right[r["doc_id"]] == r["lang_pred"] for r in got]) > least


def test_a_model_made_dense_in_steps_is_the_same():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 400, rng.integers(0, 90))) for _ in range(50)]
    whole = langid.landmarks(texts[:20])
    before, langid.DENSE = langid.DENSE, 64
    try:
        values, among = whole.kernel(texts), whole.among()
    finally:
        langid.DENSE = before
    assert np.allclose(values, whole.kernel(texts), atol=1e-6) and np.allclose(among, whole.kernel(texts[:20])[:20], atol=1e-5)
