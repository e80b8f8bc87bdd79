import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    found = {}
    for i in sorted(fps):
        if i in found:
            continue
        todo, found[i] = [i], i
        while todo:
            x = todo.pop()
            for j in fps:
                if j not in found and (fps[x] ^ fps[j]).bit_count() <= 4:
                    found[j] = i
                    todo.append(j)
    return found


def test_query(spark, folder, texts):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(fps)
    got = simhash.op5_simhash(spark, folder)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


@pytest.mark.parametrize("bucket", [8192, 20])
def test_links_of_dense_and_sparse_fingerprints(spark, bucket):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(8)}
    values |= {centres[0] ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(150)} | {r.getrandbits(64) for _ in range(200)}
    fps = dict(enumerate(sorted(values)))
    signed = [(int(np.uint64(v).view(np.int64)),) for v in fps.values()]
    nodes = spark.createDataFrame(signed, "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(nodes, bucket=bucket)).collect()}
    want = brute_components(fps)
    groups = {}
    for i, v in fps.items():
        groups.setdefault(want[i], set()).add(int(np.uint64(v).view(np.int64)))
    for members in groups.values():
        assert {found.get(v, v) for v in members} == {min(members)}


def test_thresholds_fulfil_the_pigeonhole_sum(spark):
    r = random.Random(2)
    nodes = spark.createDataFrame([(r.getrandbits(63),) for _ in range(500)], "fp long")
    parts = simhash.plan(nodes)
    assert sum(t + 1 for _, t in parts) == simhash.LIMIT + 1
    bits = [b for part, _ in parts for b in part]
    assert len(bits) == len(set(bits))


def test_allocation_is_optimal():
    costs = [[0, 5, 9, 30, 99, 200], [0, 1, 2, 3, 50, 60], [0, 7, 8, 9, 10, 11]]
    from itertools import product

    best = min(sum(c[k] for c, k in zip(costs, ks)) for ks in product(range(6), repeat=3) if sum(ks) == 5)
    total, ts = simhash.allocate(costs)
    assert total == best and sum(t + 1 for t in ts) == 5


def test_dedup_keeps_one_of_each_group(docs, texts, no_docs):
    comp = brute_components({i: brute_fingerprint(t) for i, t in enumerate(texts)})
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == sorted(set(comp.values()))
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_dedup(docs.union(docs)).count() == len(set(comp.values()))
    assert simhash.near_dedup(no_docs).count() == 0 and simhash.near_groups(no_docs).count() == 0
