import random
import re
from collections import Counter

import corpus_pipeline
from tessera.llm import mixing

from .conftest import SCHEMA
from .test_overlap import brute_first, brute_sets


def make(n=260, seed=3):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * (i % 5)}" for i in range(300)]
    texts = []
    for _ in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        kind = r.random()
        if kind < 0.2:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(("rotten", "filthy", "filthier")))
        elif kind < 0.35:
            words = [w + "%%%" for w in words]
        texts.append((" ".join(words), 0 if kind < 0.2 else 1 if kind < 0.35 else 2))
    good = [t for t, g in texts if g == 2]
    texts += [(good[0], 2), (good[1].replace(" ", "  "), 2), (good[2].upper(), 2), (good[3] + " end", 2)]
    return texts


def test_each_stage_against_brute_force(spark, tmp_path):
    data = make()
    source = lambda i: f"s{i % 3}"
    docs = spark.createDataFrame([(i, t, "en", source(i), len(t)) for i, (t, _) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(g == 2), int(g == 0)) for i, (_, g) in enumerate(data) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, now, text = str(tmp_path), docs, dict(enumerate(t for t, _ in data))
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            assert all(r["text"] == text[r["doc_id"]] for r in now.collect())
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(now)
    kept = {r["doc_id"] for r in outs[0].collect()}
    good = {i for i, (_, g) in enumerate(data) if g == 2}
    assert len(kept ^ good) <= 0.03 * len(data)
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(text[i].split()), i)
    assert {r["doc_id"] for r in outs[1].collect()} == set(first.values())
    left = sorted(first.values())
    groups = brute_first(brute_sets([text[i] for i in left]))
    assert sorted(r["doc_id"] for r in outs[2].collect()) == sorted({left[k] for k in groups.values()})
    want = {r["row"]["doc_id"]: r["n_copies"] for r in mixing.copies(outs[2]).collect() if r["n_copies"]}
    assert Counter(r["doc_id"] for r in outs[3].collect()) == want
    sizes = Counter()
    for r in outs[4].collect():
        sizes[r["doc_id"]] += r["size"]
    assert sizes == Counter({i: n * (len(text[i].split()) + 1) for i, n in want.items()})
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, outs[4].collect()))


def test_rows_of_every_kind(spark, tmp_path, texts):
    """Nulls in every column, blanks, repeated rows, repeated and missing ids, clashing column names: defined results, no text lost."""
    rows = [(None if i % 5 == 0 else i // 2, t, None if i % 3 else "en", None if i % 4 == 0 else "s", None, None, i % 2, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(now)
    assert all(x.columns == docs.columns for x in outs[:4])
    assert outs[0].count() == len(rows) + 20  # no labels: all are kept
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    distinct = [normal(r["text"]) for r in outs[1].collect()]
    assert sorted(distinct) == sorted({normal(t) for t in texts})
    groups = brute_first(brute_sets(distinct))
    assert outs[2].count() == len(set(groups.values()))
    packed = outs[4].agg({"size": "sum"}).first()[0]
    assert packed == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1 for r in outs[3].collect())


def test_empty(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
