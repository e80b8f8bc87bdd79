import hashlib
import random
import re

import numpy as np

from tessera.llm import exact


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    out = set()
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        out.add((i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_query(spark, folder, texts):
    got = exact.op6_exact(spark, folder)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {tuple(r) for r in got.collect()} == brute(enumerate(texts))


def test_colliding_fingerprints_are_told_apart(docs, texts):
    got = exact.exact_groups(exact._store.keyed_text(docs), primes=(3, 2)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert {tuple(r) for r in got.collect()} == brute(enumerate(texts))


def test_dedup_keeps_columns_and_first_rows(docs, texts):
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _, _, k, _ in brute(enumerate(texts)) if k)


def groups(spark, rows):
    found = exact.exact_groups(exact._store.keyed_text(spark.createDataFrame(rows, "doc_id long, text string")))
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=str)


def test_repeated_rows_null_ids_and_empty(spark, docs, no_docs):
    twice = exact.exact_dedup(docs.union(docs))
    assert twice.count() == exact.exact_dedup(docs).count()
    assert groups(spark, [(None, "a b"), (4, "a  b"), (None, "c")]) == sorted([(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)], key=str)
    assert groups(spark, [(1, "a b"), (1, "a b"), (None, "q"), (None, "q")]) == sorted([(1, 1, 2, True), (1, 1, 2, False), (None, None, 2, True), (None, None, 2, False)], key=str)
    kept = [r[3] for r in groups(spark, [(1, "a b"), (1, "a  b"), (1, "a\tb"), (2, "a b")])]
    assert sum(kept) == 1
    rows = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (1, "a  b", 7), (None, "q", 8), (None, "q", 9), (None, "r", 9)], "doc_id long, text string, size long")
    assert sorted((str(r["doc_id"]), r["text"].replace("  ", " ")) for r in exact.exact_dedup(rows).collect()) == [("1", "a b"), ("None", "q"), ("None", "r")]
    assert exact.exact_dedup(no_docs).count() == 0


def test_texts_of_many_chunks(spark, monkeypatch):
    """Texts beyond a chunk, a piece and a split, white space on their borders, equal but for one byte at the end."""
    r = random.Random(4)
    body = "".join(r.choice("ab \n") for _ in range(3_000_000))
    data = [body, body.replace("\n", "  "), body[:-1] + "x", body[: 1 << 20], "x" * (1 << 20) + "  " + "y" * 70000, "x" * (1 << 20) + "\t" + "y" * 70000]
    rows = [(i, t) for i, t in enumerate(data)]
    monkeypatch.setattr(exact, "SPLIT", 1 << 21)
    got = exact.exact_groups(exact._store.keyed_text(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert {tuple(x) for x in got.collect()} == brute(rows)


def test_pieces_combine_to_the_whole(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("ab  \n") for _ in range(n))) for i, n in enumerate([1 << 20, (1 << 20) + 1, 2_500_000])]
    named = exact._store.keyed_text(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["doc_id"]: (x["f1"], x["f2"], x["n_bytes"]) for x in exact._in_pieces(named, exact.PRIMES).collect()}
    assert got == {i: exact.streamed(np.frombuffer(t.encode(), np.uint8))[:3] for i, t in rows}


def test_fingerprints_combine_in_any_grouping():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(5000))
    whole = exact.fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    for chunk in (1, 7, 64, 999, 4999):
        assert exact.fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]), chunk=chunk)[0].tolist() == whole.tolist()
    parts = [data[:100], data[100:101], data[101:4000], data[4000:]]
    each = [exact.fingerprints(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0].tolist() for p in parts]
    left = exact.combine(exact.combine(each[0], each[1], 1), each[2], len(parts[2]))
    right = exact.combine(each[2], each[3], len(parts[3]))
    assert list(exact.combine(left, each[3], len(parts[3]))) == whole.tolist()
    assert list(exact.combine(exact.combine(each[0], each[1], 1), right, len(parts[2]) + len(parts[3]))) == whole.tolist()
