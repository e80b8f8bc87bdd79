import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _store, overlap, simhash
from tessera.llm import components as components_module
from tessera.llm.components import components

from .conftest import SCHEMA


def brute_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    return out


def brute_first(sets):
    """Smallest index reachable over pairs with Jaccard similarity 0.8 or more."""
    found = {}
    for i in range(len(sets)):
        if i in found:
            continue
        todo, found[i] = [i], i
        while todo:
            x = todo.pop()
            for j in range(len(sets)):
                if j not in found and 5 * len(sets[x] & sets[j]) >= 4 * len(sets[x] | sets[j]):
                    found[j] = i
                    todo.append(j)
    return found


def edited(seed=8):
    """Chains of texts with some words replaced: pairs around 0.8, and a shared passage in a third of all."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    out = []
    for k in range(40):
        words = [word() for _ in range(r.randint(8, 160))] + (passage if k % 3 == 0 else [])
        for _ in range(r.randint(1, 9)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(r.randint(1, 1 + len(words) // 30)):
                words[r.randrange(len(words))] = word()
    r.shuffle(out)
    return out


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("bucket", [8192, 3])
def test_groups_are_those_of_all_pairs(spark, texts, monkeypatch, bucket):
    monkeypatch.setattr(overlap, "PIVOT_ROWS", 2)
    monkeypatch.setattr(overlap, "BUCKET", bucket)
    data = edited() + texts
    want = brute_first(brute_sets(data))
    assert {r["doc_id"]: r["component_id"] for r in overlap.near_groups(rows(spark, data)).collect()} == want


def test_stage_finds_pairs_beyond_four_bits(spark):
    data = edited()
    want = brute_first(brute_sets(data))
    got = corpus_pipeline.near_stage(spark, rows(spark, data), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_dedup_keeps_columns_and_copies(docs, texts, no_docs):
    want = set(brute_first(brute_sets(texts)).values())
    assert overlap.near_dedup(docs).columns == docs.columns
    assert overlap.near_dedup(docs.union(docs)).count() == len(want)
    assert overlap.near_dedup(no_docs).count() == 0


FIVE = [(3, "a b c d e f g"), (7, "A b  c d e f g"), (7, "quite another text that resembles nothing"), (None, "a b c d e f g"), (None, "one more text of its own kind")]


@pytest.mark.parametrize("dedup", [overlap.near_dedup, simhash.near_dedup])
def test_rows_that_share_an_id_are_judged_one_by_one(spark, dedup):
    got = dedup(spark.createDataFrame(FIVE, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {FIVE[0], FIVE[2], FIVE[4]}
    twice = dedup(spark.createDataFrame(FIVE + FIVE, "doc_id long, text string"))
    assert sorted(map(str, twice.collect())) == sorted(map(str, got.collect()))


def test_simhash_links_are_candidates(spark, texts):
    """Texts with fingerprints (five words) within four bits are connected by the pairs that the stage verifies first."""
    data = edited() + texts
    found = _store.materialise(overlap.prefixes(rows(spark, data)), "prefixes")
    got = {r["doc_id"]: (r["node"], r["fp"] & (1 << 64) - 1) for r in found.collect()}
    assert [got[i][1] for i in range(len(data))] == [simhash.text_fingerprint((t or "").encode(), 5) for t in data]
    name = {r["node"]: r["component"] for r in components(overlap.simhash_pairs(found)).collect()}
    close = [(i, j) for i in got for j in got if i < j and got[i][0] != got[j][0] and (got[i][1] ^ got[j][1]).bit_count() <= 4]
    assert close and all(name[got[i][0]] == name[got[j][0]] for i, j in close)


def test_stage_verifies_simhash_links(spark, monkeypatch):
    """SimHash pairs are linked where the whole sets are similar and nowhere else, also if no prefix is searched."""
    same = " ".join(f"w{i}" for i in range(400))
    data = [same, same + " end", " ".join(f"v{i}" for i in range(400))]
    monkeypatch.setattr(overlap, "_pairs", lambda step: lambda batches: iter(()))
    monkeypatch.setattr(overlap, "simhash_pairs", lambda found: found.alias("x").join(found.alias("y"), F.expr("x.node < y.node")).selectExpr("x.node AS a", "y.node AS b"))
    got = corpus_pipeline.near_stage(spark, rows(spark, data), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_in_one_task_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    r = random.Random(4)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    want = {}
    for a, b in edges:
        if a != b:
            joined = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(joined, joined)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(c)) for x, c in want.items())
