import random
import zlib
from itertools import product

import numpy as np

from tessera.llm import langid

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu", "shi"], "bb": ["sch", "ber", "ung", "ein", "lich"], "cc": ["ção", "que", "nha", "os", "ê"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, sentence(r, lang, r.randint(1, 200)), lang if i % 11 else None, lang))
    return out


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    for lens in ([1], [4, 2, 1], [3, 3, 5, 1]):
        n, size = sum(lens), 3
        em, trans, begin = rng.normal(size=(n, size)) * 2, rng.normal(size=(size, size)), rng.normal(size=size)
        start = np.cumsum([0, *lens[:-1]])
        post, pairs, firsts, log_z = langid.forward_backward(em, start, np.array(lens), trans, begin)
        want_post, want_pairs, want_first, want_z = np.zeros((n, size)), np.zeros((size, size)), np.zeros(size), 0.0
        for s, m in zip(start, lens):
            paths = list(product(range(size), repeat=m))
            score = np.array([begin[p[0]] + sum(em[s + t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
            z = np.logaddexp.reduce(score)
            want_z += z
            for p, w in zip(paths, np.exp(score - z)):
                want_first[p[0]] += w
                for t, y in enumerate(p):
                    want_post[s + t, y] += w
                for a, b in zip(p, p[1:]):
                    want_pairs[a, b] += w
        assert np.allclose(post, want_post) and np.allclose(pairs, want_pairs) and np.allclose(firsts, want_first) and np.isclose(log_z, want_z)


def test_query_held_out_accuracy(spark, tmp_path):
    data = rows()
    docs = spark.createDataFrame([(i, t, lang, "s", 1.0) for i, t, lang, _ in data] + [(1000, None, "aa", "s", 0.0), (1001, " 12 --", "bb", "s", 0.0), (None, "karo", "aa", "s", 0.0)], "doc_id long, text string, lang string, source string, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op10_crf(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(data) + 3
    test = [(i, true) for i, _, _, true in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data)
    assert sum(found[i]["lang_pred"] == true for i, true in test) / len(test) > 0.98
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_code_switched_words():
    r = random.Random(8)
    spans = [(lang, sentence(r, lang, 20)) for lang in SYLLABLES for _ in range(150)]
    model = langid.fit([s for _, s in spans], [x for x, _ in spans])
    assert (np.diag(model.transitions) > model.transitions.max(axis=1) - 1e-9).all()  # staying is likelier than any switch
    text, truth = [], []
    for lang in ("aa", "cc", "bb", "aa"):
        text.append(sentence(r, lang, 12))
        truth += [lang] * 12
    post, first = langid.label_words(model, [None, " ".join(text), ""])
    assert first.tolist() == [0, 0, 48, 48]
    got = [model.langs[k] for k in post.argmax(axis=1)]
    assert sum(a == b for a, b in zip(got, truth)) >= 46


def test_results_do_not_depend_on_neighbours_or_length():
    r = random.Random(8)
    spans = [(lang, sentence(r, lang, 20)) for lang in SYLLABLES for _ in range(40)]
    model = langid.fit([s for _, s in spans], [x for x, _ in spans], rounds=10)
    texts = [sentence(r, "aa", 5000), "", None, sentence(r, "cc", 3), "ß"]
    langs, score = langid.predict(model, texts)
    for t, a, b in zip(texts, langs, score):
        one, s = langid.predict(model, [t])
        assert one == [a] and np.allclose(s, b)
    assert langs[0] == "aa" and langs[1] == langs[2] == "und" and langs[3] == "cc"


def test_pieces_of_a_chain_hand_on_their_vectors():
    """Posteriors of whole chains, however they are cut; weak evidence and strong transitions, so that cuts would show."""
    rng = np.random.default_rng(3)
    first = np.array([0, 256, 256, 257, 300, 513])
    em, begin = rng.normal(size=(513, 3)) * 0.3, rng.normal(size=3)
    trans = np.eye(3) * 4 + rng.normal(size=(3, 3)) * 0.2
    want = langid.forward_backward(em, first[:-1], np.diff(first), trans, begin)[0]
    for limit in (1, 7, 128, 1000):
        assert np.allclose(langid.posteriors(em, first, trans, begin, limit), want, atol=1e-9)


def test_every_language_is_learned(spark):
    """More languages than rows allow in full, one of them rare, ids that repeat."""
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i % 26)}x"] * 30), f"l{i % 26:02d}", "s", 1) for i in range(600) if i % 26 != 25 or i < 60]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string, span string, rank int")
    langid_rows, langid.ALL_ROWS = langid.ALL_ROWS, 50
    try:
        model = langid.train(docs, rounds=5)
    finally:
        langid.ALL_ROWS = langid_rows
    known = {f"l{i % 26:02d}" for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.langs) == known and len(known) > 20


def test_spans_of_switched_text(spark):
    r = random.Random(8)
    spans = [(lang, sentence(r, lang, 20)) for lang in SYLLABLES for _ in range(100)]
    model = langid.fit([s for _, s in spans], [x for x, _ in spans])
    docs = spark.createDataFrame([(1, sentence(r, "aa", 30) + " " + sentence(r, "bb", 30)), (2, None), (None, "")], "doc_id long, text string")
    got = {x["doc_id"]: [(s["lang"], s["start"], s["end"]) for s in x["spans"]] for x in langid.label_spans(docs, model).collect()}
    assert got[2] == got[None] == []
    assert [x for x, *_ in got[1]] == ["aa", "bb"] and abs(got[1][0][2] - 30) <= 1 and got[1][1][2] == 60


def test_no_training_rows_and_empty(spark, docs, no_docs):
    assert langid.train(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, None).count() == 0
