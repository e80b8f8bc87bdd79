"""Byte-level substring deduplication with a run-length (r-)index.

Every byte is removed that lies in a 100-byte string which also starts earlier (in a
document with a smaller doc_id, or earlier in the same one).

Splitting the work, exactly: of the 53 48-byte grams in a 100-byte string, the one with the
smallest hash is its anchor, so equal strings have equal anchors and the text falls into
segments, the runs of strings under one anchor. Strings whose anchor occurs once cannot be
repeated. Segments of equal content under an anchor (a 128-bit BLAKE2 digest of their bytes
stands in for comparing them) are counted in Spark; all but the first occurrence of a content
are repeated as a whole. What is left is the first occurrence of each content under anchors
with several contents, or with an anchor that comes twice in a document. Equal strings lie
under one anchor, so whole anchors together are indexed, batch by batch, and no index has to
know another's text.

The index of a batch is its Burrows-Wheeler transform as runs with the text positions of the
run ends. It keeps, for each run end, the place there, the place in the neighbouring row and
how far the two agree. Between these samples a place's neighbour moves along with it and the
match gets one byte shorter a byte, so the matching statistics of all places of the text come
from the samples by one subtraction each, and memory follows the runs. They are streamed in
text order. A place whose match is 100 bytes long follows its neighbours, up and down in
turn, until one of them is an earlier place (it is repeated) or both sides end (it is the
first). Segments are indexed in the order of their places, so earlier means smaller.

Long segments, which only periodic texts have, are cut into pieces; equal pieces are indexed
once. The segments of an anchor with more than ``CONTENTS`` contents (a very common passage in
ever new contexts) are cut again by a second, finer anchor and dealt to indexes by both. What
is still more than ``CONTENTS`` under one pair of anchors, which no one task should hold, is
counted string by string in Spark by a 128-bit digest of the string: the exact way for the rest.

Defined cases: null texts are empty; texts under 100 bytes stay whole; a null doc_id comes
after all others; rows that share a doc_id (or have none) come in the order of a hash of their
text; rows repeated with one doc_id and text do not remove each other; empty input gives an
empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WIDTH = 100
GRAM = 48
FINE = 16  # bytes of a gram of the second anchor
CONTENTS = 2000
BATCH = 1 << 19  # bytes of segments in one index
PIECE = 124  # strings of a segment that are indexed together
STREAM = 1 << 16  # places whose neighbours are followed together
FEW_IDS = 1_000_000  # so many marked documents are sent to every task at most
LAST = (1 << 63) - 1
ROW = ["doc_id", "mark"]


# ---------------------------------------------------------------- the index


def suffix_array(sym: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes, each up to the end of its segment.

    ``sym``: 0 ends a segment, other symbols below 512; ``left``: symbols from a place to its segment's end, end included.
    Suffixes that agree up to their segments' ends come in text order.
    """
    n, k = len(sym), 7
    padded = np.concatenate([sym.astype(np.int64), np.zeros(8, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for t in range(k):
        key = (key << 9) | np.where(left > t, padded[t : t + n] + (t < 7), 0)
    at = np.arange(n)
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if k >= left.max() or rank.max() == n:
            break
        key = rank << 32 | np.where(left > k, rank[np.minimum(at + k, n - 1)], 0)
        k *= 2
    return np.argsort(rank << 32 | at)


def common_length(sym: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b have in common, up to their segments' ends."""
    limit = np.minimum(left[a], left[b]) - 1
    padded = np.concatenate([sym.astype(np.uint16), np.zeros(4, np.uint16)])
    wide = padded[:-3].astype(np.uint64) | padded[1:-2].astype(np.uint64) << np.uint64(16) | padded[2:-1].astype(np.uint64) << np.uint64(32) | padded[3:].astype(np.uint64) << np.uint64(48)
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        live = live[wide[a[live] + out[live]] == wide[b[live] + out[live]]]
        out[live] += 4
        live = live[out[live] < limit[live]]
    out = np.minimum(out, limit)
    for _ in range(3):  # the last word may agree in part
        more = np.flatnonzero(out < limit)
        more = more[padded[a[more] + out[more]] == padded[b[more] + out[more]]]
        out[more] += 1
    return out


class RunIndex:
    """The runs of the Burrows-Wheeler transform of segments, and what is known at the run ends.

    ``above``: places that head a run (sorted), where the row above is, and how far the two agree; ``below`` likewise for
    places that end a run. A segment's first place counts as a run of its own.
    """

    def __init__(self, segments: list[bytes], width: int = WIDTH):
        lens = np.array([len(s) for s in segments], dtype=np.int64)
        self.width = width
        ends = np.cumsum(lens + 1) - 1
        sym = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8).astype(np.int64) + 1
        sym[ends] = 0
        n = self.n = len(sym)
        left = np.repeat(ends + 1, lens + 1) - np.arange(n)
        order = suffix_array(sym, left)
        bwt = sym[order - 1]
        head = np.ones(n, dtype=bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        rows = np.flatnonzero(head)
        self.run_symbol, self.run_start = bwt[rows].astype(np.int16), rows.astype(np.int32)
        rows = rows[rows > 0]
        place, other = order[rows], order[rows - 1]
        agree = common_length(sym, left, place, other)
        self.above, self.below = self._samples(place, other, agree), self._samples(other, place, agree)

    @staticmethod
    def _samples(place, other, agree):
        by = np.argsort(place, kind="stable")
        return tuple(x[by].astype(np.int32) for x in (place, other, agree))

    def nbytes(self) -> int:
        """Memory that the index keeps."""
        return sum(x.nbytes for x in (self.run_symbol, self.run_start, *self.above, *self.below))

    def neighbour(self, samples, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the neighbouring row, and how far each agrees with it, from the nearest sample at or before it."""
        at, other, agree = samples
        k = np.searchsorted(at, places.astype(np.int32), side="right") - 1
        known = k >= 0
        k = np.maximum(k, 0)
        passed = places - at[k]
        return other[k] + passed, np.where(known, agree[k] - passed, 0)

    def matching_statistics(self, block: int = STREAM):
        """(first place, lengths above, lengths below) block by block: the longest match of each place with its neighbours."""
        for a in range(0, self.n, block):
            places = np.arange(a, min(a + block, self.n))
            yield a, self.neighbour(self.above, places)[1], self.neighbour(self.below, places)[1]

    def repeated(self) -> np.ndarray:
        """The places, sorted, whose ``width`` symbols also start at an earlier place."""
        if not len(self.above[0]):
            return np.zeros(0, np.int64)
        found = []
        for a, up, down in self.matching_statistics():
            found.append(self._later(a + np.flatnonzero(np.maximum(up, down) >= self.width)))
        return np.concatenate(found)

    def _later(self, places: np.ndarray) -> np.ndarray:
        """Those of some places that have an equal string earlier in the text: neighbours are followed on both sides in turn."""
        hits, at = [], [places.copy(), places.copy()]
        live = [np.ones(len(places), bool), np.ones(len(places), bool)]
        while len(places):
            done = np.zeros(len(places), bool)
            for side, samples in enumerate((self.above, self.below)):
                k = np.flatnonzero(live[side] & ~done)
                nxt, agree = self.neighbour(samples, at[side][k])
                ok = agree >= self.width
                live[side][k] = ok
                at[side][k] = np.where(ok, nxt, at[side][k])
                done[k] = ok & (nxt < places[k])
            hits.append(places[done])
            stay = ~done & (live[0] | live[1])
            places = places[stay]
            at, live = [x[stay] for x in at], [x[stay] for x in live]
        return np.sort(np.concatenate(hits)) if hits else places


# ---------------------------------------------------------------- segments


def _strings(buf, offsets, width, gram):
    """Of a block, document and start of each string and its anchor; and the anchors' own places."""
    values = buf.astype(np.uint64) + np.uint64(1)
    grams = _text.window_hashes(values, gram, _text.STEP, seed=21)
    anchor = _text.sliding_min(grams, width - gram + 1)
    n = len(anchor)
    lens = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens) + offsets[:-1][doc]
    return doc, at, anchor[at], grams


def _runs(doc, at, anchor):
    """First index of each run of neighbouring strings with one anchor."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(new)


def _twice(doc, at, anchor, grams, width, gram):
    """(document, anchor) pairs whose anchor has two places or more in the document's text."""
    w = width - gram + 1
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A gram is the anchor of some string around it if it equals the largest anchor of those strings.
    top = np.zeros(len(grams) + w, dtype=np.uint64)
    top[at + w - 1] = anchor
    most = ~_text.sliding_min(~top, w)[: len(grams)]
    place = np.flatnonzero(most == grams)
    # ... in the document of the string that starts at most w - 1 before it.
    k = np.minimum(np.searchsorted(at, place, side="right") - 1, len(at) - 1)
    ok = (k >= 0) & (place - at[np.maximum(k, 0)] < w)
    d, v, count = _text.sorted_pairs(doc[k[ok]], grams[place[ok]])
    return d[count > 1], v[count > 1]


def _pair_key(doc, anchor):
    return _text.mix(anchor ^ _text.mix(np.asarray(doc).astype(np.uint64), 5))


def _parts(batch, width):
    """(row of the first text, rows, bytes, offsets, place of the first byte in its text): blocks of texts; a long text in parts that share all but one string's bytes."""
    buf, offsets = _text.text_buffer(batch.column("text"))
    step = 1 << 21
    for i, j in _text.blocks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * step:
            yield i, j, buf[a:b], offsets[i : j + 1] - a, 0
            continue
        for s in range(a, b, step):
            e = min(s + step + width - 1, b)
            if s == a or e - s >= width:
                yield i, j, buf[s:e], np.array([0, e - s], np.int64), s - a


def _scan(width, gram):
    """Row, n_bytes, kept_sha256 (of the whole text) and anchors; a long text has more rows, with anchors only."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for i, j, data, offs, base in _parts(batch, width):
                doc, at, anchor, grams = _strings(data, offs, width, gram)
                start = _runs(doc, at, anchor)
                d, v, _ = _text.sorted_pairs(doc[start], anchor[start])
                d2, v2 = _twice(doc, at, anchor, grams, width, gram)
                d, v = np.concatenate([d, d2]), np.concatenate([v, v2])  # those found twice count twice
                order = np.argsort(d, kind="stable")
                cuts = np.searchsorted(d[order], np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(v[order].view(np.int64)))
                if base:
                    size, sha = [None], [None]
                elif j - i == 1:
                    whole = (column[i].as_py() or "").encode()
                    size, sha = [len(whole)], [hashlib.sha256(whole).hexdigest()]
                else:
                    raw = data.tobytes()
                    size, sha = np.diff(offs), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ROW), pa.array(size, pa.int64()), pa.array(sha, pa.string()), lists], [*ROW, "n_bytes", "kept_sha256", "anchors"])

    return run


def _digests(raw: bytes, starts, ends) -> list[np.ndarray]:
    """128-bit digests of slices, as two longs each."""
    blake = hashlib.blake2b
    both = np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]


def _segments(width, gram):
    """Occurrences of the segments under wanted anchors: place, number of strings, digest of the content."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            for i, j, data, offs, base in _parts(batch, width):
                doc, at, anchor, grams = _strings(data, offs, width, gram)
                wanted = batch.column("anchors").slice(i, j - i)
                keys = _pair_key(np.repeat(np.arange(j - i), np.diff(np.asarray(wanted.offsets))), np.asarray(wanted.flatten()).view(np.uint64))
                first = _runs(doc, at, anchor)
                count = np.diff(np.append(first, len(doc)))
                mine = _pair_key(doc[first], anchor[first])
                ok = np.isin(mine, keys)
                first, count, mine = first[ok], count[ok], mine[ok]
                own = np.isin(mine, _pair_key(*_twice(doc, at, anchor, grams, width, gram)))
                a = at[first]
                c1, c2 = _digests(data.tobytes(), a, a + count + width - 1)
                of = doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor[first].view(np.int64), c1, c2, ids[i:j][of], marks[i:j][of], a - offs[:-1][of] + base, count.astype(np.int64), own)],
                    ["anchor", "c1", "c2", *ROW, "pos", "strings", "own"],
                )

    return run


SEGMENT = "anchor long, doc_id long, mark long, pos long, segment binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
NAMES = ["anchor", *ROW, "pos", "segment"]


def _cut_out(width):
    """The text of the wanted segments of each document."""

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, mark, t, want in zip(*(batch.column(c).to_pylist() for c in ROW), batch.column("text"), batch.column("want"), strict=True):
                data = (t.as_py() or "").encode()
                for w in want.as_py():
                    rows.append((w["anchor"], doc_id, mark, w["pos"], data[w["pos"] : w["pos"] + w["strings"] + width - 1]))
                    size += len(rows[-1][-1])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return run


def _finer(width, fine):
    """Segments cut into runs of strings under a second anchor; the new anchor stands for both."""

    def run(batches):
        for batch in batches:
            rows = []
            for anchor, doc_id, mark, pos, segment in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                values = np.frombuffer(segment, np.uint8).astype(np.uint64) + np.uint64(1)
                second = _text.sliding_min(_text.window_hashes(values, fine, _text.STEP, seed=22), width - fine + 1)
                start = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]]))
                names = _text.mix(second[start] ^ _text.mix(np.array([anchor], np.int64).view(np.uint64), 6)).view(np.int64)
                for a, b, name in zip(start.tolist(), [*start[1:].tolist(), len(second)], names.tolist(), strict=True):
                    rows.append((name, doc_id, mark, pos + a, segment[a : b + width - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return run


class Batch:
    """Segments of whole anchors on their way into one index.

    A long segment is cut into pieces that share all but one string's bytes, so every string
    lies in one piece. Of equal pieces the earliest is indexed and the others are marked as
    they are, which keeps periodic texts small.
    """

    def __init__(self, width: int = WIDTH):
        self.width, self.first, self.marks, self.size = width, {}, [], 0

    def add(self, row: tuple[int, int], pos: int, segment: bytes) -> None:
        for a in range(0, max(len(segment) - self.width + 1, 1), PIECE):
            piece, at = segment[a : a + PIECE + self.width - 1], (*row, pos + a)
            old = self.first.get(piece)
            if old is None:
                self.first[piece] = at
                self.size += len(piece)
            elif old != at:
                self.first[piece], again = min(old, at), max(old, at)
                self.marks.append((*again, again[2] + len(piece)))

    def finish(self) -> list[np.ndarray]:
        """(doc_id, mark, start, end) of the repeated bytes."""
        out = [[np.array([m[k] for m in self.marks], dtype=np.int64)] for k in range(4)]
        if self.first:
            # In the order of their places, so that the earlier of two places of the text is the smaller.
            pieces = sorted(self.first.items(), key=lambda x: x[1])
            places = np.array([p for _, p in pieces], dtype=np.int64)
            starts = np.cumsum([0, *(len(s) + 1 for s, _ in pieces[:-1])])
            hit = RunIndex([s for s, _ in pieces], self.width).repeated()
            if len(hit):
                new = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
                of = np.searchsorted(starts, hit[new], side="right") - 1
                shift = places[of, 2] - starts[of]
                for k, x in enumerate((places[of, 0], places[of, 1], hit[new] + shift, hit[np.append(new[1:], len(hit)) - 1] + shift + self.width)):
                    out[k].append(x)
        return [np.concatenate(x) for x in out]


def _index(width):
    """Marks of the segments of a partition, sorted by anchor, in batches of whole anchors."""

    def out(batch):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in batch.finish()], [*ROW, "a", "b"])

    def run(batches):
        held, last = Batch(width), None
        for batch in batches:
            for anchor, doc_id, mark, pos, segment in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                if held.size >= BATCH and anchor != last:
                    yield out(held)
                    held = Batch(width)
                held.add((doc_id, mark), pos, segment)
                last = anchor
        yield out(held)

    return run


def _counted_strings(width):
    """Every string of each segment, by its digest."""

    def run(batches):
        for batch in batches:
            for doc_id, mark, pos, segment in zip(*(batch.column(c).to_pylist() for c in (*ROW, "pos", "segment")), strict=True):
                at = np.arange(len(segment) - width + 1)
                c1, c2 = _digests(segment, at, at + width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc_id, np.int64)), pa.array(np.full(len(at), mark, np.int64)), pa.array(pos + at), pa.array(c1), pa.array(c2)], [*ROW, "pos", "c1", "c2"])

    return run


def _merged(marks) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a list of (a, b)."""
    a, b = (np.array([m[k] for m in marks], dtype=np.int64) for k in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[new], b[np.append(new[1:], len(a)) - 1]


def _remove(batches):
    """Texts without their marked bytes: counts, digest, spans and the bytes that are left."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for t, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
            data = (t.as_py() or "").encode()
            a, b = _merged(marks.as_py())
            left = b"".join([data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)])
            spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            out.append((len(data), len(data) - len(left), len(a), hashlib.sha256(left).hexdigest(), spans, left))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], [*ROW, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "cleaned"])


SPANS = "array<struct<start:bigint,end:bigint>>"
REMOVED = f"doc_id long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans {SPANS}, cleaned binary"


def repeated_marks(marked: DataFrame, width: int = WIDTH, gram: int = GRAM, contents: int = CONTENTS) -> DataFrame:
    """Row and marks, an array of (a, b): spans of repeated bytes in documents with the anchors to look at."""
    seen = _store.materialise(marked.mapInArrow(_segments(width, gram), "anchor long, c1 long, c2 long, doc_id long, mark long, pos long, strings long, own boolean"), "segments")
    place = F.struct(*ROW, "pos")
    content = ["anchor", "c1", "c2"]
    # Rows repeated with one doc_id and text give the same places; a place counts once.
    kinds = seen.groupBy(*content).agg(F.min(place).alias("first"), F.max("strings").alias("strings"), F.max("own").alias("own"), F.count("*").alias("n"))
    kinds = _store.materialise(kinds, "contents")
    # All but the first occurrence of a content, as a whole.
    many = _store.materialise(kinds.filter("n > 1").select(*content, "first", "n"), "many")
    later = _store.spread_join(seen, many, content, [*ROW, "pos"]).filter(place != F.col("first")).select(*ROW, F.col("pos").alias("a"), (F.col("pos") + F.col("strings") + width - 1).alias("b"))
    # The first occurrences where an anchor has several contents or comes twice in a document.
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 or any_own").select("anchor", "n")
    open_ = _store.materialise(open_, "open")
    lone = kinds.select("anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), F.col("first.pos").alias("pos"), "strings")
    want = _store.spread_join(lone, open_, ["anchor"], [*ROW, "pos"]).groupBy(*ROW).agg(F.collect_list(F.struct("anchor", "pos", "strings")).alias("want"))
    texts = marked.select(*ROW, "text").join(want, ROW)
    if not marked.groupBy(*ROW).count().filter("count > 1").isEmpty():  # repeated rows
        texts = texts.dropDuplicates(ROW)
    made = texts = _store.materialise(texts.mapInArrow(_cut_out(width), SEGMENT), "texts")
    stored = [seen, kinds, many, open_, made]
    marks = later
    hot = _store.materialise(open_.filter(F.col("n") > contents).select("anchor"), "hot")
    if not hot.isEmpty():
        few = F.broadcast(hot) if hot.limit(100_001).count() <= 100_000 else hot
        finer = _store.materialise(texts.join(few, "anchor", "left_semi").mapInArrow(_finer(width, min(FINE, gram)), SEGMENT), "finer")
        full = _store.materialise(finer.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > contents).select("anchor"), "hot")
        few_full = F.broadcast(full) if full.limit(100_001).count() <= 100_000 else full
        texts = texts.join(few, "anchor", "left_anti").unionByName(finer.join(few_full, "anchor", "left_anti"))
        stored.append(finer)
        if not full.isEmpty():
            strings = finer.join(few_full, "anchor", "left_semi").mapInArrow(_counted_strings(width), "doc_id long, mark long, pos long, c1 long, c2 long")
            firsts = _store.materialise(strings.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
            again = _store.spread_join(strings, firsts, ["c1", "c2"], [*ROW, "pos"]).filter(place != F.col("first"))
            marks = marks.unionByName(again.select(*ROW, F.col("pos").alias("a"), (F.col("pos") + width).alias("b")))
            stored.append(firsts)
    indexed = texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index(width), "doc_id long, mark long, a long, b long")
    out = marks.unionByName(indexed).groupBy(*ROW).agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    out = _store.materialise(out, "marks")
    _store.discard(*stored)
    return out


def _named(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return _store.keyed_text(docs, text, id_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))


def removed(named: DataFrame, width: int = WIDTH, gram: int = GRAM, contents: int = CONTENTS) -> tuple[DataFrame, DataFrame]:
    """(row, n_bytes and kept_sha256 of every text as it is; row, counts, digest, spans and bytes left of those that lose some), both written."""
    with _store.small_batches(named.sparkSession):
        scanned = _store.materialise(named.mapInArrow(_scan(width, gram), "doc_id long, mark long, n_bytes long, kept_sha256 string, anchors array<long>"), "anchors")
        stats = _store.materialise(scanned.filter("n_bytes is not null").drop("anchors"), "stats")
        anchors = scanned.select(*ROW, F.explode("anchors").alias("anchor"))
        shared = _store.materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        found = _store.spread_join(anchors, shared, ["anchor"], ROW).groupBy(*ROW).agg(F.collect_set("anchor").alias("anchors"))
        found = _store.materialise(found, "found")
        _store.discard(scanned, shared)
        few = found.limit(FEW_IDS + 1).count() <= FEW_IDS
        some = named.join(F.broadcast(found.select(*ROW)), ROW, "left_semi") if few else named
        marked = _store.materialise(some.join(found, ROW), "marked")
        _store.discard(found)
        marks = repeated_marks(marked, width, gram, contents)
        cut = _store.materialise(marked.select(*ROW, "text").join(marks, ROW).mapInArrow(_remove, REMOVED), "cut")
        _store.discard(marked, marks)
    return stats, cut


def byte_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with ``cleaned``, the bytes that are left (a cut can part a character), and ``removed_spans``."""
    _, cut = removed(_named(docs, text, id_col), width, gram)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("mark"))
    both = whole.join(cut.select(*ROW, "cleaned", "removed_spans").dropDuplicates(ROW), ROW, "left")
    plain = F.encode(F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")), "UTF-8")
    return both.select("row.*", F.coalesce("cleaned", plain).alias("cleaned"), F.coalesce("removed_spans", F.array().cast(SPANS)).alias("removed_spans"))


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, contents: int = CONTENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    stats, cut = removed(_named(docs), width, gram, contents)
    zero = F.lit(0).cast("long")
    whole = stats.select(*ROW, "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256").join(cut.select(*ROW).distinct(), ROW, "left_anti")
    out = whole.unionByName(cut.drop("removed_spans", "cleaned"))
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_run_index(spark, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier in the corpus."""
    return digests(_store.table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, strlen(COALESCE(text, '')) AS n FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hits
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g
), slices AS (
  SELECT doc_id, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id
), kept AS (
  SELECT x.doc_id, string_agg(substr(d.h, 2 * s + 1, 2 * (COALESCE(e, n) - s)), '' ORDER BY s) AS h FROM slices x JOIN d ON d.doc_id = x.doc_id GROUP BY x.doc_id
), gone AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
