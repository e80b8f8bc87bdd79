import hashlib
import random

import numpy as np
import pytest

from tessera.llm import runindex


def brute(rows, width):
    data = {i: (t or "").encode() for i, t in rows}
    first, out = {}, set()
    for i in sorted(data):
        for k in range(len(data[i]) - width + 1):
            first.setdefault(data[i][k : k + width], (i, k))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] != (i, k):
                gone[k : k + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.add((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_query(spark, folder, texts):
    got = runindex.op7_run_index(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == brute(enumerate(texts), 100) and sum(r[2] > 0 for r in rows) > 12


@pytest.mark.parametrize("contents", [2000, 1])
def test_short_strings_over_a_small_alphabet(spark, contents):
    r = random.Random(9)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(40)] + ["a" * 60, "ab" * 40, "é" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, gram in ((12, 4), (9, 9), (16, 1)):
        assert {tuple(x) for x in runindex.digests(docs, width, gram, contents).collect()} == brute(enumerate(texts), width)


def segments_of(r, n=30):
    return [bytes(r.choice(b"abc") for _ in range(r.randint(1, 60))) for _ in range(n)] + [b"abcabcabc" * 8, b"\x00\xff" * 20]


def test_index_runs_and_matching_statistics():
    segments = segments_of(random.Random(3))
    index = runindex.RunIndex(segments, 5)
    text, starts = [], []
    for k, s in enumerate(segments):
        starts.append(len(text))
        text += [(1, x, 0) for x in s] + [(0, k, 0)]
    ends = [a + len(s) for a, s in zip(starts, segments)]
    of = np.repeat(np.arange(len(segments)), [len(s) + 1 for s in segments])
    order = sorted(range(len(text)), key=lambda i: text[i : ends[of[i]] + 1])
    bwt = [text[i - 1][:2] if text[i - 1][0] else (0, i) for i in order]  # a segment's first place is a run of its own
    assert len(index.run_start) == 1 + sum(a != b for a, b in zip(bwt, bwt[1:]))

    def agree(i, j):
        n = 0
        while i + n < ends[of[i]] and j + n < ends[of[j]] and text[i + n] == text[j + n]:
            n += 1
        return n

    row = {place: k for k, place in enumerate(order)}
    for a, up, down in index.matching_statistics(50):
        for i, (u, d) in enumerate(zip(up.tolist(), down.tolist()), a):
            if i in ends:
                continue
            k = row[i]
            assert max(u, 0) == (agree(i, order[k - 1]) if k else 0) and max(d, 0) == (agree(i, order[k + 1]) if k + 1 < len(order) else 0)


@pytest.mark.parametrize("width", [1, 4, 9])
def test_repeated_places(width):
    segments = segments_of(random.Random(8), 60)
    seen, want, at = set(), [], 0
    for s in segments:
        for k in range(len(s) - width + 1):
            if s[k : k + width] in seen:
                want.append(at + k)
            seen.add(s[k : k + width])
        at += len(s) + 1
    assert runindex.RunIndex(segments, width).repeated().tolist() == want


def test_memory_follows_the_runs():
    r = random.Random(1)
    base = bytes(r.choice(b"abcdefgh") for _ in range(4000))
    one = runindex.RunIndex([base])
    copies = runindex.RunIndex([base[: 4000 - k] for k in range(60)])
    assert copies.n > 59 * one.n and copies.nbytes() < 3 * one.nbytes()
    assert len(copies.run_start) < copies.n / 15


def test_null_ids_repeated_rows_and_empty(spark, docs, no_docs):
    assert runindex.digests(no_docs).count() == 0
    once = {tuple(r) for r in runindex.digests(docs).collect()}
    twice = [tuple(r) for r in runindex.digests(docs.union(docs)).collect()]
    assert set(twice) == once and len(twice) == 2 * len(once)
    text = "".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, text), (8, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in runindex.digests(rows).collect()} == {(None, 110), (8, 0)}


def test_periodic_texts_stay_small():
    r = random.Random(6)
    unit = bytes(r.choice(b"abcdef") for _ in range(7))
    batch = runindex.Batch(100)
    texts = {1: unit * 3000, 2: unit * 2000 + b"tail", 3: b"x" + unit * 40}
    for i, t in texts.items():
        batch.add((i, 0), 0, t)
    assert batch.size < 12_000
    gone = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for d, _, a, b in zip(*(x.tolist() for x in batch.finish())):
        gone[d][a:b] = True
    want = {i: n for i, _, n, _, _ in brute([(i, t.decode()) for i, t in texts.items()], 100)}
    assert {i: int(g.sum()) for i, g in gone.items()} == want


def test_rows_with_removed_spans(spark, docs, texts):
    got = runindex.byte_dedup(docs)
    assert got.columns == [*docs.columns, "cleaned", "removed_spans"]
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, n, gone, spans, sha in brute(enumerate(texts), 100):
        assert hashlib.sha256(bytes(rows[i]["cleaned"])).hexdigest() == sha and len(rows[i]["cleaned"]) == n - gone
        assert len(rows[i]["removed_spans"]) == spans and sum(s["end"] - s["start"] for s in rows[i]["removed_spans"]) == gone


def test_many_null_ids_and_one_huge_text(spark):
    """A third of the rows without a doc_id, a passage that most rows share, and one text of some 9 MB that is cut into parts."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(None if i % 3 == 0 else i, f"{i} {passage} {r.random()} end") for i in range(60)]
    block = "".join(r.choice("abcdefgh ") for _ in range(1000))
    huge = "".join(f"{k:x} " for k in range(1_300_000))
    rows += [(1000, f"{huge}{passage}{block}{huge[:500_000]}"), (1001, f"x{block}")]
    got = {(x["doc_id"], x["n_removed"]): x for x in runindex.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, 0) in got
    long = next(x for (i, _), x in got.items() if i == 1000)
    assert 500_300 <= long["n_removed"] <= 500_320 and long["n_spans"] == 2
    assert any(i == 1001 and 1000 <= n <= 1001 for i, n in got)
    assert all(n >= 300 for i, n in got if i is None or i > 1)
