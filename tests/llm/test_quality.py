import os
import random

import numpy as np
import pyarrow as pa

from tessera.llm import _text, quality

VOCAB = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * (i % 5)}" for i in range(300)]


def make(n, seed):
    """Texts with grades: bad words make 0, signs after every word or loops make 1."""
    r, out = random.Random(seed), []
    for i in range(n):
        words = [r.choice(VOCAB) for _ in range(r.randint(10, 200))]
        kind = r.choice((0, 1, 1, 2, 2, 2, 2))
        if kind == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(("rotten", "Rotten,", "filthy", "filthier")))
        elif kind == 1:
            words = [w + "%%%" for w in words] if r.random() < 0.5 else [w for w in words for _ in range(12)]
        out.append((i, " ".join(words), kind))
    return out


def rows_of(texts):
    buf, offsets = _text.text_buffer(pa.array(texts, pa.string()))
    doc, slot = quality.features(buf, offsets)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [slot[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def test_features_do_not_depend_on_neighbours(texts):
    together = rows_of(texts)
    for t, got in zip(texts, together):
        assert got.tolist() == rows_of([t])[0].tolist() == sorted(set(got.tolist()))


def test_case_and_punctuation_do_not_hide_words():
    shared = set(rows_of(["idiot"])[0]) & set(rows_of(["Well, (IDIOT)!"])[0])
    assert len(shared) >= 4  # the word and its prefixes


def test_tails_are_ordered_and_sum_to_the_expected_grade():
    model = quality.Model(np.zeros(0, np.int64), np.zeros(0), np.array([-1.0, 0.5, 2.0]))
    tails = model.tails(np.array([-3.0, 0.0, 4.0]))
    assert (np.diff(tails, axis=1) <= 0).all() and (np.diff(tails, axis=0) > 0).all()


def test_fit_against_a_grid():
    """On one feature, no weight and thresholds on a grid have a lower penalised loss than those fitted."""
    r = np.random.default_rng(3)
    has = r.random(80) < 0.5
    grades = np.where(has, r.choice(3, 80, p=[0.6, 0.3, 0.1]), r.choice(3, 80, p=[0.1, 0.3, 0.6]))
    model = quality.fit([np.array([5] if h else [], dtype=np.int64) for h in has], grades, l1=1e-3, rounds=3000)
    assert model.slots.tolist() == [5]
    counts = np.bincount(grades, minlength=3) + 0.5
    weight = (80 / 3 / counts)[grades]
    weight /= weight.sum()

    def loss(w, a, b):
        f = w * has
        cut = np.stack([np.zeros(80), 1 / (1 + np.exp(f - a)), 1 / (1 + np.exp(f - b)), np.ones(80)], axis=1)
        p = np.maximum(cut[np.arange(80), grades + 1] - cut[np.arange(80), grades], 1e-9)
        return -(weight * np.log(p)).sum() + 1e-3 * abs(w)

    grid = [loss(w, a, b) for w in np.arange(-4, 0.1, 0.1) for a in np.arange(-4, 2, 0.2) for b in np.arange(a + 0.1, a + 4, 0.2)]
    assert loss(model.weights[0], *model.thresholds) <= min(grid) + 1e-3


def test_labels_that_clash_and_long_training_texts(spark, monkeypatch):
    """The lowest grade of a doc_id counts, so labels added to bad texts change nothing; slots of one training text are bounded; a few labels suffice."""
    texts = [(i, ("bad words here " if i % 2 else "good words there ") * 3 + " ".join(VOCAB[i % 7 : i % 7 + 9])) for i in range(60)]
    docs = spark.createDataFrame(texts + texts[:5] + [(None, None)], "doc_id long, text string")
    labels = [(i, int(i % 2 == 0), 0) for i in range(40)] + [(1, 1, 0), (3, 1, 0), (None, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in quality.select_quality(docs, table).collect()]
    assert {i for i in kept if i is not None and i > 40} == set(range(42, 60, 2))
    monkeypatch.setattr(quality, "TRAIN_SLOTS", 10)
    assert quality.train(docs, table).thresholds.shape == (2,)


def test_held_out_accuracy_through_spark(spark):
    train, test = make(700, 1), make(400, 2)
    rows = train + [(1000 + i, t, g) for i, t, g in test]
    docs = spark.createDataFrame([(i, t, "extra", 1.0) for i, t, _ in rows], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, int(g == 2 or i % 2 == 0 and g == 0), int(g == 0)) for i, _, g in train], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    truth = {i: g for i, _, g in rows if i >= 1000}
    got = {r["row"]["doc_id"]: r for r in quality.score(docs, model).filter("row.doc_id >= 1000").collect()}
    keep = {r["doc_id"] for r in quality.select_quality(docs, labels).collect()}
    right = sum((i in keep) == (g == 2) for i, g in truth.items())
    assert right / len(truth) > 0.97
    mean = [np.mean([got[i]["expected_grade"] for i, g in truth.items() if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert quality.select_quality(docs, labels).columns == docs.columns
    assert all(abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in got.values())


def test_no_labels_one_grade_nulls_and_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_quality(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.select_quality(docs, one).count() == docs.count()
    model = quality.train(docs, one)
    assert quality.score(no_docs, model).count() == 0
    assert quality.score(docs.union(docs), model).count() == 2 * docs.count()


def test_query(spark, folder, tmp_path, texts):
    import os

    os.symlink(f"{folder}/documents.parquet", tmp_path / "documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op1_ordinal(spark, str(tmp_path))
    assert got.columns == ["doc_id", "expected_grade", "p_not_toxic", "p_good", "kept"]
    first = sorted(map(tuple, got.collect()))
    assert len(first) == len(texts) and first == sorted(map(tuple, quality.op1_ordinal(spark, str(tmp_path)).collect()))


def test_the_driver_does_not_fit(spark, monkeypatch):
    """Feature lists stay in a task; of rows that share a doc_id one is learned from, in whatever order they come."""
    rows = [(i, "good words here" if i % 2 else "rotten filthy things") for i in range(60)] + [(1, "rotten things"), (2, "good here")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    driver, fit = os.getpid(), quality.fit

    def elsewhere(*args, **options):
        assert os.getpid() != driver, "the driver fits"
        return fit(*args, **options)

    monkeypatch.setattr(quality, "fit", elsewhere)
    models = [quality.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1])]
    assert len(models[0].slots) and models[0].slots.tolist() == models[1].slots.tolist()
    assert models[0].weights.tolist() == models[1].weights.tolist() and models[0].thresholds.tolist() == models[1].thresholds.tolist()
