import numpy as np

from tessera.llm.quality_pairs import FEATURES, accepted, features, fit, fold, predictions, train
from tessera.sources import read_table

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, DATA, "documents"), read_table(spark, DATA, "labels")
    held = predictions(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_scores_follow_pairs_and_the_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(FEATURES)))
    label = (x[:, 3] + 0.3 * rng.normal(size=600) > -0.8).astype(int)
    model = fit(x, label)
    assert ((model.score(x) >= 0.3) == label).mean() > 0.85
    assert abs((model.score(x) < 0.3).mean() - (label == 0).mean()) < 0.01


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "word", 3.0), (1, None, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    assert model.weights == ()  # one kind of label only: nothing is rejected
    rows = predictions(docs, labels).collect()
    assert len(rows) == 4 and {(r.score, r.predicted) for r in rows} == {(1.0, 1)}
    assert accepted(docs, labels).columns == docs.columns and accepted(docs, labels).count() == 4
    assert predictions(docs.limit(0), labels.limit(0)).collect() == []
    assert features("") == [0.0] * len(FEATURES) and len(features("x\n" * 50_000)) == len(FEATURES)


def test_labels_and_ids_are_no_inputs(spark):
    docs = read_table(spark, DATA, "documents").limit(50)
    labels = read_table(spark, DATA, "labels")
    moved = docs.withColumn("doc_id", docs.doc_id + 1_000_000)
    from tessera.llm.quality_pairs import scorer

    model = train(read_table(spark, DATA, "documents"), labels)
    a = [r[0] for r in docs.orderBy("doc_id").select(scorer(model)("text")).collect()]
    b = [r[0] for r in moved.orderBy("doc_id").select(scorer(model)("text")).collect()]
    assert a == b


def test_the_loss_is_that_of_all_pairs():
    """At the weights found, the gradient over every pair vanishes; over a sample of pairs it would not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(FEATURES)))
    label = (x[:, 5] + x[:, 9] + rng.normal(size=300) > 0.5).astype(int)
    model = fit(x, label, ridge=0.03)
    w = np.array(model.weights)
    z = np.clip((x - np.array(model.mean)) / np.array(model.scale), -8, 8)
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, len(w))
    gradient = 0.03 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    assert np.abs(gradient).max() < 1e-4 < 0.01 < np.abs(w).max()
    assert ((model.score(x) < 0.3) == (label == 0)).mean() > 0.8 and (model.score(x) < 0.3).sum() == (label == 0).sum()


def test_all_labelled_rows_count(spark):
    """More labelled rows than the 6,000 that once were all that was read: the table's model is that of all, and its threshold their quantile."""
    rng, words = np.random.default_rng(6), "the of dog runs far away from every house and tree!!! | 7 Zz".split()
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(10_000)]
    quality = [int(rng.random() < (0.2 if "|" in t else 0.9)) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int")
    model, mine = train(docs, labels), [i for i in range(len(texts)) if fold(i)]
    x, y = np.array([features(texts[i]) for i in mine]), np.array([quality[i] for i in mine])
    assert len(mine) > 7_000
    whole = fit(x, y)
    assert np.allclose(model.weights, whole.weights, atol=2e-5) and np.allclose(model.mean, whole.mean, atol=1e-6) and abs(model.threshold - whole.threshold) < 1e-4
    assert (model.score(x) < 0.3).sum() <= (y == 0).sum() <= (model.score(x) <= 0.3 + 1e-9).sum()
