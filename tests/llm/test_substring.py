import hashlib
import random
import re

from tessera.llm import substring


def brute(rows, width):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_query(spark, folder, texts):
    got = substring.op4_rabin_karp(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == brute(enumerate(texts), 50) and sum(r[2] > 0 for r in rows) > 10


def test_short_windows_over_a_small_vocabulary(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, gram in ((8, 3), (12, 12), (5, 1)):
        assert {tuple(r) for r in substring.digests(docs, width, gram).collect()} == brute(enumerate(texts), width)


def test_null_ids_repeated_rows_and_empty(spark, docs, no_docs):
    assert substring.digests(no_docs).count() == 0
    once = {tuple(r) for r in substring.digests(docs).collect()}
    twice = [tuple(r) for r in substring.digests(docs.union(docs)).collect()]
    assert set(twice) == once and len(twice) == 2 * len(once)
    text = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, text), (8, text), (None, "z " * 55)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.digests(rows).collect()} == {(None, 60, 60), (8, 60, 0), (None, 55, 0)}


def test_words_that_collide_under_a_rolling_hash(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    t = [0]
    while len(t) < 1024:
        t += [1 - x for x in t]
    one, other = ("".join("ab"[x] for x in t), "".join("ba"[x] for x in t))
    rest = " ".join(map(str, range(49)))
    docs = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"{rest} {one}")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring.digests(docs).collect()} == {(1, 0), (2, 0), (3, 50)}


def test_salted_joins(spark, monkeypatch):
    """Where every anchor and window counts as hot, results stay."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(substring._store.spread_join, "__defaults__", (5, 100_000))
    assert {tuple(x) for x in substring.digests(docs, 6, 2).collect()} == brute(enumerate(texts), 6)


def test_cleaned_rows_keep_their_columns(spark, docs, texts):
    got = substring.substring_dedup(docs)
    assert got.columns == [*docs.columns, "removed_spans"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, _, gone, sha in brute(enumerate(texts), 50):
        assert sum(s["end"] - s["start"] for s in rows[i]["removed_spans"]) == gone
        if gone:
            assert hashlib.sha256(rows[i]["text"].encode()).hexdigest() == sha
        else:
            assert rows[i]["text"] == texts[i]


def test_many_null_ids_and_one_huge_text(spark):
    """A third of the rows without a doc_id, and one text of some 20 MB."""
    r = random.Random(2)
    passage = " ".join(str(r.random()) for _ in range(60))
    rows = [(None if i % 3 == 0 else i, f"{i} {passage} {r.random()} end") for i in range(90)]
    huge = " ".join(f"{k:x}" for k in range(3_000_000))
    rows.append((1000, f"{huge} {passage}"))
    got = {(x["doc_id"], x["n_removed"]): x for x in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, 0) in got and (1000, 60) in got and got[1000, 60]["n_words"] == 3_000_060
    assert (None, 60) in got and (2, 60) in got
