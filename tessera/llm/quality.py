"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are graded: 0 toxic, 1 poor, 2 good. One weight vector over hashed features is shared
by all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score).
The model gives an expected grade and the tail probability P(grade >= k) for selection.

Features of a text, each present or absent: its words (ASCII letters lower-cased, ASCII
punctuation at the ends cut off), their prefixes of 3 to 8 bytes, the sign a raw word ends
with, and for five shares (words that end in two signs, capital words, lone signs, words
equal to the one before, three-word runs seen before) every level that the share reaches.
All are hashed into 2**18 slots.

Training: proximal gradient steps with an L1 penalty, so that words which tell nothing weigh
nothing and long texts gather no noise, on a bounded sample of labelled rows (``TRAIN_ROWS``
rows, those of least hash of doc_id, alike at every size). Feature lists are made in Spark;
one task gets at most ``TRAIN_ROWS`` lists of at most ``TRAIN_SLOTS`` distinct slots (of a
text with more, those of least hash), 200 MB at worst, and the driver the weights that are
not 0. Scoring reads whole texts. Slots in
fewer than ``MIN_DF`` training texts are not used; with few texts that bound is a hundredth of
them, plus one. Training ends after ``ROUNDS`` steps, or when ``PATIENCE`` steps together
lower the loss by less than ``LEAST`` of it.

Defined cases: null and blank texts have no feature and get the model's prior; with no labels
(or labels of one grade) every text gets the prior as well and is kept; labels that repeat for
one doc_id count once, with the lowest grade; of rows that repeat a labelled doc_id one is
learned from; repeated rows get equal results; empty input gives an empty result; other columns
are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

SLOTS = 1 << 18
TRAIN_ROWS = 6000
GRADES = 3
PREFIXES = (3, 4, 5, 6, 7, 8)
L1 = 4e-4
ROUNDS = 400
PATIENCE, LEAST = 20, 1e-4
TRAIN_SLOTS = 8192
#: Features in fewer training texts are not used.
MIN_DF = 6
#: A text stays if P(grade >= KEEP_GRADE) is at least KEEP_TAIL.
KEEP_GRADE, KEEP_TAIL = 2, 0.5

LEVELS = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs of a block of texts, in order, as two arrays."""
    starts, ends, first = _text.words(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = _LOWER[buf]
    punct = _PUNCT[buf]
    last = buf[ends - 1]
    kind = np.where(_PUNCT[last], last, np.uint8(97)).astype(np.uint64)
    shout = ((buf[starts] >= 65) & (buf[starts] <= 90) & (buf[np.minimum(starts + 1, ends - 1)] >= 65) & (buf[np.minimum(starts + 1, ends - 1)] <= 90) & (ends - starts > 2)).astype(np.uint64)
    n = len(first) - 1
    count = np.maximum(np.diff(first), 1)
    wh = _text.word_hashes(buf, starts, ends)
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    runs = _text.window_hashes(wh, 3)
    inside = doc[: len(runs)] == doc[2:] if len(runs) else np.zeros(0, bool)
    runs = (runs[inside] >> np.uint64(24)) | doc[: len(runs)][inside].astype(np.uint64) << np.uint64(40)
    distinct = np.bincount((np.unique(runs) >> np.uint64(40)).astype(np.int64), minlength=n)
    all_runs = np.bincount((runs >> np.uint64(40)).astype(np.int64), minlength=n)
    signs = punct[ends - 1] & punct[np.maximum(ends - 2, starts)] & (ends - starts > 2)
    lone = punct[starts] & (ends - starts == 1)
    shares = [np.bincount(doc, x, minlength=n) / count for x in (signs, shout, lone, same)] + [1 - distinct / np.maximum(all_runs, 1)]
    shares[-1][all_runs == 0] = 0
    s, e = starts.copy(), ends.copy()
    for _ in range(4):  # up to four signs at each end
        cut = (e > s) & punct[np.maximum(e - 1, 0)]
        e = np.where(cut, e - 1, e)
        cut = (e > s) & punct[np.minimum(s, len(buf) - 1)]
        s = np.where(cut, s + 1, s)
    values = low.astype(np.uint64) + np.uint64(1)
    up, down = _text.powers(_text.BASE, len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    base = sums[s]
    back = down[s]
    found = [doc.astype(np.uint64) << np.uint64(32) | _text.mix(kind * np.uint64(2) + shout, 5) >> np.uint64(46)]
    for k, width in enumerate((0, *PREFIXES)):
        ok = e - s >= width if width else e > s
        to = s[ok] + width if width else e[ok]
        h = _text.mix((sums[to] - base[ok]) * back[ok], 20 + k) >> np.uint64(46)
        found.append(doc[ok].astype(np.uint64) << np.uint64(32) | h)
    for k, share in enumerate(shares):
        for level, least in enumerate(LEVELS):
            at = np.flatnonzero(share >= least).astype(np.uint64)
            found.append(at << np.uint64(32) | _text.mix(np.array([k * 64 + level], np.uint64), 99)[0] >> np.uint64(46))
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Shared weights and ordered thresholds."""

    slots: np.ndarray  # of the weights that are not 0
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row a score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, l1: float = L1, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the cumulative-link likelihood.

    ``rows``: distinct slots of each text. A grade that has no label gets a threshold next to its neighbour's.
    """
    n = len(rows)
    counts = np.bincount(grades, minlength=grades_n) + 0.5
    share = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.log(share / (1 - share))
    if n == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), theta)
    slots = np.concatenate(rows).astype(np.int32)
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    df = np.bincount(slots, minlength=int(slots.max()) + 1 if len(slots) else 1)
    good = (df >= min(MIN_DF, 1 + n // 100)) & (df < n)
    used = np.flatnonzero(good)
    keep = good[slots]
    if not keep.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), theta)
    upto = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(lens)
    counts_of = upto[ends] - upto[ends - lens]
    index = (np.cumsum(good, dtype=np.int32) - 1)[slots[keep]]
    del slots, keep, upto
    # The pairs twice, in the order of the texts and in that of the slots, so that both sums run over neighbours.
    live = np.flatnonzero(counts_of)
    heads = (np.cumsum(counts_of) - counts_of)[live]
    by_slot = np.argsort(index, kind="stable").astype(np.int32)
    of = np.repeat(np.arange(n, dtype=np.int32), counts_of)[by_slot]
    slot_heads = np.searchsorted(index[by_slot], np.arange(len(used)))
    del by_slot
    # Grades weigh the same in all, so that few toxic rows count.
    weight = (n / grades_n / counts)[grades]
    weight = weight / weight.sum()
    v, w_prev, t_prev, momentum = np.zeros(len(used)), np.zeros(len(used)), theta.copy(), 1.0
    t = theta.copy()
    scale = 1 / np.sqrt(np.maximum(df[used], 1) / n)  # larger steps for rare features
    step = 4.0

    def gradient(w, t):
        f = np.zeros(n)
        f[live] = np.add.reduceat(w[index], heads)
        upper, lower = np.append(t, np.inf), np.append(-np.inf, t)
        a, b = _sigmoid(upper[grades] - f), _sigmoid(lower[grades] - f)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        g_f = weight * (da - db) / p
        g_t = np.zeros(len(t) + 1)
        np.add.at(g_t, grades, -weight * da / p)
        low = np.zeros(len(t) + 2)
        np.add.at(low, grades, weight * db / p)
        return -(weight * np.log(p)).sum(), np.add.reduceat(g_f[of], slot_heads), g_t[:-1] + low[1 : len(t) + 1]

    seen, first, best, losses = np.inf, None, np.inf, []
    for _ in range(rounds):
        loss, g_w, g_t = gradient(v, t)
        moved = v - step * scale * g_w
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * scale * l1, 0)
        t_new = np.sort(t - step * 0.2 * g_t)
        t_new[1:] = np.maximum(t_new[1:], t_new[:-1] + 1e-3)
        if loss > seen * 1.02:
            step, momentum = step / 2, 1.0
            v, t = w_prev.copy(), t_prev.copy()
            seen = np.inf
            continue
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = w + (momentum - 1) / after * (w - w_prev)
        w_prev, t_prev, t, momentum, seen = w, t, t_new, after, loss
        first = loss if first is None else first
        best = min(best, loss + l1 * np.abs(v).sum())
        losses = [*losses, best] if loss < first else []  # the first steps may lead up
        if len(losses) > PATIENCE and losses[-PATIENCE - 1] - best < LEAST * best:
            break
    found = w_prev != 0
    return Model(used[found], w_prev[found], t)


def _features_of(batches):
    for batch in batches:
        buf, offsets = _text.text_buffer(batch.column("text"))
        for i, j in _text.blocks(offsets):
            doc, slot = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            for k in np.flatnonzero(np.diff(cuts) > TRAIN_SLOTS):
                own = slot[cuts[k] : cuts[k + 1]]
                own[np.argsort(_text.mix(own.astype(np.uint64), 77), kind="stable")[TRAIN_SLOTS:]] = -1
            kept = slot >= 0
            cuts = np.concatenate([[0], np.cumsum(kept)])[cuts].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(slot[kept].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("grade").slice(i, j - i), lists], ["doc_id", "grade", "slots"])


def grade_of(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """The grade of a row of labels: 0 toxic, 1 poor, 2 good; null if neither is known."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2).cast("int")


def _fit_task(options: dict):
    """Fit on the rows of one task: grade and slots, one row a doc_id, in an order that does not depend on how they came."""

    def run(batches):
        ids, grades, rows = [], [], []
        for batch in batches:
            slots = batch.column("slots")
            ids.append(batch.column("doc_id").to_numpy())
            grades.append(batch.column("grade").to_numpy())
            rows += [slots[i].values.to_numpy() for i in range(batch.num_rows)]
        if not rows:
            return
        sums = np.array([_text.mix(r.astype(np.uint64), 78).sum() for r in rows], np.uint64)
        ids = np.concatenate(ids)
        order = np.lexsort((sums, ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        model = fit([rows[int(i)] for i in order], np.concatenate(grades)[order].astype(np.int64), **options)
        parts = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((model.slots, pa.int64()), (model.weights, pa.float64()), (model.thresholds, pa.float64()))]
        yield pa.RecordBatch.from_arrays(parts, ["slots", "weights", "thresholds"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> Model:
    """Fit on the ``train_rows`` labelled rows of least hash of doc_id, in one task; the driver gets the model alone."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of().alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = _store.doc_text(docs).join(F.broadcast(rated), "doc_id")
    found = sample.mapInArrow(_features_of, "doc_id long, grade int, slots array<int>")
    got = found.repartition(1).mapInArrow(_fit_task(options), "slots array<long>, weights array<double>, thresholds array<double>").toArrow()
    if not got.num_rows:
        return fit([], np.zeros(0, np.int64), **options)
    slots, weights, thresholds = (got.column(c).combine_chunks().values.to_numpy() for c in got.column_names)
    return Model(slots, weights, thresholds)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (a struct of all columns), score, expected_grade, tails (P(grade >= 1), ...)."""
    table = np.zeros(SLOTS)
    slots, weights, thresholds = model.slots, model.weights, model.thresholds

    def run(batches):
        table[slots] = weights
        here = Model(slots, weights, thresholds)
        for batch in batches:
            buf, offsets = _text.text_buffer(batch.column("text"))
            total = []
            for i, j in _text.blocks(offsets):
                doc, slot = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total.append(np.bincount(doc, table[slot], minlength=j - i))
            f = np.concatenate(total) if total else np.zeros(0)
            tails = here.tails(f)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(f), pa.array(tails.sum(axis=1)), pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), max(1, tails.shape[1])).cast(pa.list_(pa.float64()))], ["row", "score", "expected_grade", "tails"])

    named = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", named.schema["row"].dataType), T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return named.mapInArrow(run, schema)


def kept(grade: int = KEEP_GRADE, tail: float = KEEP_TAIL) -> F.Column:
    """Whether a scored row is selected by its tail probability."""
    return F.get("tails", F.lit(grade - 1)) >= tail


def select_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = train(docs, labels, **options)
    if not len(model.slots):
        return docs
    return score(docs, model).filter(kept()).select("row.*")


def op1_ordinal(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the decision for every document."""
    docs = _store.table(spark, sf_dir, "documents")
    model = train(docs, _store.table(spark, sf_dir, "labels"))
    decision = kept() if len(model.slots) else F.lit(True)
    return score(docs.select("doc_id", "text"), model).select(
        "row.doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round(F.get("tails", F.lit(0)), 6).alias("p_not_toxic"), F.round(F.get("tails", F.lit(1)), 6).alias("p_good"), decision.alias("kept"),
    )
