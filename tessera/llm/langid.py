"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language, also where a text switches between languages. A word's
features are its affixes (first and last 1 to 3 bytes), its byte trigrams with the bytes
around the word, and its entry in a lexicon of words seen in training. Transition weights
between neighbours are learned with them, by gradient steps on the conditional likelihood;
forward-backward sums give the expectations in training and the word posteriors after it.

Training chains are spans of labelled texts, some spliced from texts in different languages,
so that switches and their rarity are learned. The sample is bounded: ``TRAIN_ROWS`` rows of
each language (those of least hash of doc_id), fewer where languages are so many that they
would exceed ``ALL_ROWS`` together, and never less than one; of each row ``SPANS`` spans of
``SPAN`` words, spread over the whole text.

A text is one chain, however long. It is worked through in pieces of ``PIECE`` words, all in
step; a product of transition matrices over each piece carries the forward vector to the next
piece and the backward vector to the one before, so the cuts change no posterior. A text's
language is the one with the largest posterior summed over all its words; the score is its
share. ``label_spans`` returns the runs of words of one language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no
training rows every text is ``und``; ties go to the language that sorts first; repeated rows
get equal results; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _text

TRAIN_ROWS = 400
ALL_ROWS = 8000
SPANS = 6
SPAN = 20
PIECE = 128
BUCKETS = 1 << 16
AFFIXES = 1 << 16
ROUNDS = 40
UND = "und"


@dataclass(frozen=True)
class Model:
    """Languages, weight tables (features x languages) and log transitions."""

    langs: tuple[str, ...]
    trigrams: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray  # one row more, of zeros, for words not in it
    transitions: np.ndarray
    start: np.ndarray


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one UTF-8 buffer, a space after each, with offsets."""
    data = [(t.lower() if t else "").encode("utf-8", "replace") + b" " for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def word_features(buf, starts, ends):
    """Trigram slots byte by byte with the first of each word; affix slots (words x 6); word hashes."""
    wide = np.concatenate([[32], buf, [32, 32]]).astype(np.uint32)
    tri = (wide[:-3] * np.uint32(0x01000193) ^ wide[1:-2] * np.uint32(0x85EBCA6B) ^ wide[2:-1] * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.repeat(starts - first, lens) + np.arange(int(lens.sum()))
    values = buf.astype(np.uint32) + np.uint32(1)
    pads = np.concatenate([values, np.zeros(3, np.uint32)])
    code, back, affix = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32), []
    for k in range(3):
        ok = lens > k
        code = np.where(ok, code * np.uint32(257) + pads[starts + k], code)
        back = np.where(ok, back * np.uint32(257) + pads[np.maximum(ends - 1 - k, 0)], back)
        affix += [(code + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(16), (back + np.uint32(k + 101)) * np.uint32(0x85EBCA6B) >> np.uint32(16)]
    return tri[at].astype(np.int64), first, np.stack(affix, axis=1).astype(np.int64), _text.word_hashes(buf, starts, ends, 3)


def lexicon_index(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each word in the lexicon; the last row for words not in it."""
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


def emissions(model: Model, buf, starts, ends) -> np.ndarray:
    """Log potentials of each word (words x languages)."""
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32)
    tri, first, affix, hashes = word_features(buf, starts, ends)
    out = np.add.reduceat(model.trigrams[tri], first, axis=0)
    for k in range(affix.shape[1]):
        out += model.affixes[affix[:, k]]
    return out + model.lexicon_weights[lexicon_index(model.lexicon, hashes)]


def pieces(first: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the pieces of each text's chain, of at most ``limit`` words, and each piece's number in its text."""
    lens = np.diff(first)
    count = -(-lens // limit)
    doc = np.repeat(np.arange(len(lens)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + k * limit
    return start, np.minimum(limit, first[1:][doc] - start), k


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors that sum to 1, along the last axis."""
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def posteriors(em: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray, limit: int = PIECE) -> np.ndarray:
    """Posteriors (words x languages) of whole texts as one chain each, worked through in pieces."""
    n, size = em.shape
    if not n:
        return np.zeros((0, size))
    pot = np.exp((em - em.max(axis=1, keepdims=True)).astype(np.float64))
    moves = np.exp(trans - trans.max())
    start, lens, number = pieces(first, limit)
    head, tail = np.zeros((len(start), size)), np.ones((len(start), size)) / size
    head[number == 0] = _unit(np.exp(begin - begin.max()))
    follow = np.flatnonzero(number > 0)  # pieces with one before them; piece i - 1 is the one
    if len(follow):
        # What a piece does to a forward vector: the product of its steps, for all pieces in step.
        inner = np.flatnonzero(np.append(number[1:] > 0, False) | (number > 0))
        step = np.argsort(-lens[inner], kind="stable")
        at, size_of = start[inner][step], lens[inner][step]
        through = np.broadcast_to(np.eye(size), (len(inner), size, size)).copy()
        for t in range(int(size_of[0])):
            c = int(np.searchsorted(-size_of, -t, side="left"))
            # A text's first piece starts from its own vector, not by a move.
            live = through[:c] @ moves if t else np.where((number[inner][step][:c] > 0)[:, None, None], through[:c] @ moves, through[:c])
            live = live * pot[at[:c] + t][:, None, :]
            through[:c] = live / live.max(axis=(1, 2), keepdims=True)
        matrix = np.empty((len(start), size, size))
        matrix[inner[step]] = through
        # From piece to piece: forward vectors rightwards, backward vectors leftwards, all texts in step.
        last = int(number.max())
        by_number = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[by_number], np.arange(last + 2))
        ahead = np.zeros((len(start), size))
        ahead[number == 0] = head[number == 0]
        for k in range(1, last + 1):
            now = by_number[cuts[k] : cuts[k + 1]]
            ahead[now] = _unit(np.einsum("pi,pij->pj", ahead[now - 1], matrix[now - 1]))
            head[now] = _unit(ahead[now] @ moves)
        for k in range(last, 0, -1):
            now = by_number[cuts[k] : cuts[k + 1]]
            tail[now - 1] = _unit(np.einsum("pij,pj->pi", matrix[now], tail[now]))
    order = np.argsort(-lens, kind="stable")
    start, lens, head, tail = start[order], lens[order], head[order], tail[order]
    active = np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), side="left")  # pieces longer than t
    alphas, post = [], np.zeros((n, size))
    for t, c in enumerate(active):
        before = head if t == 0 else alphas[-1][:c] @ moves
        alphas.append(_unit(pot[start[:c] + t] * before[:c]))
    beta = np.zeros((0, size))
    for t in range(len(active) - 1, -1, -1):
        c, m = active[t], len(beta)
        now = tail[:c].copy()
        now[:m] = _unit((pot[start[:m] + t + 1] * beta) @ moves.T)
        beta = now
        post[start[:c] + t] = _unit(alphas[t] * beta)
    return post


def forward_backward(em: np.ndarray, start: np.ndarray, lens: np.ndarray, trans: np.ndarray, begin: np.ndarray):
    """Posteriors (words x languages), expected transitions, posteriors of the first words summed, log partition summed.

    All chains go in step, longest first, so that those at work are always a leading block.
    """
    n, size = em.shape
    post = np.zeros((n, size))
    order = np.argsort(-lens, kind="stable")
    start, lens = start[order], lens[order]
    top = em.max(axis=1, keepdims=True) if n else em
    pot = np.exp((em - top).astype(np.float64))
    t_max = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(t_max), side="left")  # chains longer than t
    moves, alphas, scales = np.exp(trans), [], []
    log_z = float(top.sum()) if n else 0.0
    for t in range(t_max):
        c = active[t]
        a = pot[start[:c] + t] * (np.exp(begin)[None, :] if t == 0 else alphas[-1][:c] @ moves)
        s = a.sum(axis=1, keepdims=True)
        a /= s
        log_z += float(np.log(s).sum())
        alphas.append(a)
        scales.append(s)
    pairs = np.zeros((size, size))
    beta = np.zeros((0, size))
    for t in range(t_max - 1, -1, -1):
        c = active[t]
        full = np.ones((c, size))
        if len(beta):
            m = len(beta)
            out = pot[start[:m] + t + 1] * beta / scales[t + 1]
            pairs += (alphas[t][:m].T @ out) * moves
            full[:m] = out @ moves.T
        beta = full
        post[start[:c] + t] = alphas[t] * beta
    firsts = post[start[lens > 0]].sum(axis=0) if n else np.zeros(size)
    return post, pairs, firsts, log_z


def fit(spans: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """Train on spans of words, each in one language, spliced into chains; None without spans."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(spans))
    # About half of the chains keep to one language; the others join two to four spans at random.
    by_lang: dict[str, list[int]] = {}
    for i in order:
        by_lang.setdefault(labels[i], []).append(int(i))
    plan, half = [], len(order) // 2
    mixed = [int(i) for i in order[:half]]
    taken = set(mixed)
    for own in by_lang.values():
        rest = [i for i in own if i not in taken]
        plan += [rest[k : k + 3] for k in range(0, len(rest), 3)]
    k = 0
    while k < len(mixed):
        size = int(rng.integers(2, 5))
        plan.append(mixed[k : k + size])
        k += size
    buf, offsets = lowered([spans[i] for chain in plan for i in chain])
    starts, ends, first = _text.words(buf, offsets)
    if not len(starts):
        return None
    gold = np.repeat([langs.index(labels[i]) for chain in plan for i in chain], np.diff(first))
    ends_of = np.cumsum([len(chain) for chain in plan])
    bounds = np.concatenate([[0], first[ends_of]])
    start, lens = bounds[:-1], np.diff(bounds)
    live = lens > 0
    start, lens = start[live], lens[live]
    tri, at, affix, hashes = word_features(buf, starts, ends)
    values, counts = np.unique(hashes, return_counts=True)
    lexicon = values[counts >= 3]
    size, n = len(langs), len(starts)
    index = np.concatenate([tri, BUCKETS + affix.ravel(), BUCKETS + AFFIXES + lexicon_index(lexicon, hashes)])
    owner = np.concatenate([np.repeat(np.arange(n), np.diff(np.append(at, len(tri)))), np.repeat(np.arange(n), affix.shape[1]), np.arange(n)])
    used, index = np.unique(index, return_inverse=True)
    outside = BUCKETS + AFFIXES + len(lexicon)
    w = np.zeros((len(used), size))
    trans, begin = np.zeros((size, size)), np.zeros(size)
    g_w, g_t, g_b = np.full(w.shape, 1e-8), np.full(trans.shape, 1e-8), np.full(size, 1e-8)
    gold_pairs, gold_first = np.zeros((size, size)), np.bincount(gold[start], minlength=size)
    inner = np.ones(n, dtype=bool)
    inner[start] = False
    np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    want = np.eye(size)[gold]
    for _ in range(rounds):
        em = np.stack([np.bincount(owner, w[index, j], minlength=n) for j in range(size)], axis=1)
        post, pairs, firsts, _ = forward_backward(em, start, lens, trans, begin)
        err = want - post
        grad = np.stack([np.bincount(index, err[owner, j], minlength=len(used)) for j in range(size)], axis=1) - 0.05 * w
        grad[used == outside] = 0
        for x, g, acc, rate in ((w, grad, g_w, 0.3), (trans, gold_pairs - pairs - 0.05 * trans, g_t, 0.3), (begin, gold_first - firsts - 0.05 * begin, g_b, 0.1)):
            acc += g * g
            x += rate * g / np.sqrt(acc)
    full = np.zeros((BUCKETS + AFFIXES + len(lexicon) + 1, size), np.float32)
    full[used] = w
    return Model(langs, full[:BUCKETS], full[BUCKETS : BUCKETS + AFFIXES], lexicon, full[BUCKETS + AFFIXES :], trans, begin)


def label_words(model: Model, texts: list[str | None]):
    """For each text, its words' posteriors (words x languages)."""
    buf, offsets = lowered(texts)
    starts, ends, first = _text.words(buf, offsets)
    return posteriors(emissions(model, buf, starts, ends), first, model.transitions, model.start), first


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if model is None:
        return [UND] * len(texts), np.zeros(len(texts))
    post, first = label_words(model, texts)
    sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
    total = sums[first[1:]] - sums[first[:-1]]
    letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    letters &= np.diff(first) > 0
    best = total.argmax(axis=1)
    share = np.where(letters, total.max(axis=1) / np.maximum(total.sum(axis=1), 1e-12), 0.0)
    return [model.langs[b] if ok else UND for b, ok in zip(best, letters, strict=True)], np.clip(share, 0, 1)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spans(batches):
    for batch in batches:
        langs, out = [], []
        for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words = (t or "").split()
            n = len(words) // SPAN
            for k in sorted({(i * max(n, 1)) // SPANS for i in range(SPANS)}):
                if span := words[k * SPAN : (k + 1) * SPAN]:
                    langs.append(lang)
                    out.append(" ".join(span))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], ["lang", "span"])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> Model | None:
    """Learn from text and lang of the rows that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    many = known.select("lang").distinct().count()
    if not many:
        return None
    # Spark cuts each partition to the rows of least rank before it shuffles.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    each = max(1, min(train_rows, ALL_ROWS // many))
    picked = known.select("doc_id", "lang").distinct().withColumn("rank", rank).filter(F.col("rank") <= each).select("doc_id").distinct()
    got = known.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").mapInArrow(_spans, "lang string, span string").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("span").to_pylist(), strict=True))
    return fit([s for _, s in pairs], [x for x, _ in pairs], **options)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            _, offsets = _text.text_buffer(column)
            for i, j in _text.blocks(offsets):
                langs, score = predict(model, column.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return _store.doc_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and spans of every row: runs of words of one language, as (lang, start, end) in words; none without a model."""

    def spans(texts):
        if model is None:
            return [[] for _ in texts]
        post, first = label_words(model, texts)
        best, out = post.argmax(axis=1), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            cuts = np.flatnonzero(np.diff(best[a:b])) + 1
            edges = [0, *cuts.tolist(), b - a] if b > a else []
            out.append([{"lang": model.langs[best[a + x]], "start": x, "end": y} for x, y in zip(edges[:-1], edges[1:], strict=True)])
        return out

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            _, offsets = _text.text_buffer(column)
            for i, j in _text.blocks(offsets):
                kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(spans(column.slice(i, j - i).to_pylist()), kind)], ["doc_id", "spans"])

    return _store.doc_text(docs).mapInArrow(run, "doc_id long, spans array<struct<lang:string,start:int,end:int>>")


def op10_crf(spark, sf_dir: str) -> DataFrame:
    """Language and score of every document, learned from those not held out."""
    docs = _store.table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
