"""Substring deduplication: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window is 50 consecutive words of one document. A window is repeated if its words also
start in a document with a smaller doc_id; the words that repeated windows cover are removed,
overlapping windows merging into maximal intervals.

Every window has a Rabin-Karp key, rolled over keys of its words modulo two primes, and a
BLAKE2 digest of its very words, which stands in for comparing them: windows are taken for
equal only if both agree, so no run of words that collides under the rolling hash is removed.
Before windows are shuffled for counting, those that cannot be repeated are set aside,
exactly: of the 35 16-word grams in a window, the one with the smallest hash is its anchor;
equal windows have equal anchors, so a window whose anchor occurs in one document only occurs
in no other. Runs of windows share an anchor, which makes the anchors some 18 times fewer
than the words.

1. scan: words, digest of the unchanged words, distinct anchors of each document
2. anchors found in two documents or more (a partial aggregation before the shuffle)
3. documents with such anchors: keys of the windows under them, counted with their smallest
   doc_id (again pre-aggregated)
4. per document, the places of its repeated windows, merged into intervals and cut out

An anchor or a window with very many rows is salted when rows meet it.

Defined cases: null and blank texts have no words; texts of fewer than 50 words have no
window; a null doc_id comes after all others; rows that share a doc_id (or have none) do not
remove each other, and each is cut by itself; empty input gives an empty result; other
columns are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WINDOW = 50
GRAM = 16
LAST = (1 << 63) - 1
FEW_IDS = 1_000_000  # so many marked documents are sent to every task at most
ROW = ["doc_id", "mark"]
SPANS = "array<struct<start:int,end:int>>"


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans=()) -> bytes:
    """The words of a text joined by one space each, without those in the word intervals ``spans``."""
    keep = ~_text.SPACE[data]
    lead = np.zeros(len(data) + 1, dtype=bool)  # lead[i]: a kept word starts at i
    lead[starts] = True
    for a, b in spans:
        keep[starts[a] : ends[b - 1]] = False
        lead[starts[a] : ends[b - 1]] = False
    first = int(np.argmax(lead)) if lead.any() else 0
    lead[first] = False
    keep[:-1] |= lead[1:-1]  # the sign before every kept word but the first
    return np.where(_text.SPACE[data], np.uint8(32), data)[keep].tobytes()


def _window_table(buf, offsets, width, gram):
    """Word hashes of a block; of each window its document, start and anchor; the words' places and their index by document."""
    starts, ends, first = _text.words(buf, offsets)
    wh = _text.word_hashes(buf, starts, ends)
    anchor = _text.sliding_min(_text.window_hashes(wh, gram, seed=11), width - gram + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    at = np.arange(len(anchor))
    inside = at + width <= first[1:][doc]
    return wh, doc[inside], at[inside], anchor[inside], starts, ends, first


def _scan(width, gram):
    def run(batches):
        for batch in batches:
            buf, offsets = _text.text_buffer(batch.column("text"))
            for i, j in _text.blocks(offsets):
                data, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, doc, _, anchor, starts, ends, first = _window_table(data, offs, width, gram)
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                d, v, _ = _text.sorted_pairs(doc[new], anchor[new])
                cuts = np.searchsorted(d, np.arange(j - i + 1))
                sha = []
                for k in range(j - i):
                    a, b = first[k], first[k + 1]
                    sha.append(hashlib.sha256(joined_words(data[offs[k] : offs[k + 1]], starts[a:b] - offs[k], ends[a:b] - offs[k])).hexdigest())
                anchors = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), pa.array(np.diff(first)), pa.array(sha, pa.string()), anchors], [*ROW, "n_words", "kept_sha256", "anchors"]
                )

    return run


def _windows(width, gram):
    """Row, place, key and digest of the windows under the anchors that each document names."""
    blake = hashlib.blake2b

    def run(batches):
        for batch in batches:
            buf, offsets = _text.text_buffer(batch.column("text"))
            ids, marks, wanted = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy(), batch.column("anchors")
            for i, j in _text.blocks(offsets):
                data, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                wh, doc, at, anchor, starts, ends, first = _window_table(data, offs, width, gram)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                keys = _text.window_keys(wh, width).view(np.int64)
                for k in range(j - i):
                    mine = slice(cuts[k], cuts[k + 1])
                    own = at[mine][np.isin(anchor[mine].view(np.int64), wanted[i + k].values.to_numpy())]
                    if not len(own):
                        continue
                    s, e = starts[first[k] : first[k + 1]] - offs[k], ends[first[k] : first[k + 1]] - offs[k]
                    raw, pos = joined_words(data[offs[k] : offs[k + 1]], s, e), own - first[k]
                    upto = np.cumsum(e - s + 1) - 1  # where each word ends in the joined words
                    digest = [blake(raw[a:b], digest_size=8).digest() for a, b in zip((upto - (e - s))[pos].tolist(), upto[pos + width - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), ids[i + k])), pa.array(np.full(len(own), marks[i + k])), pa.array(pos.astype(np.int32)), pa.array(keys[own]), pa.array(np.frombuffer(b"".join(digest), np.int64))],
                        [*ROW, "pos", "key", "digest"],
                    )

    return run


def _merge(width):
    """Maximal word intervals covered by windows that start at the places of each row."""

    def run(batches):
        for batch in batches:
            out = []
            for places in batch.column("places"):
                p = np.unique(places.values.to_numpy())
                new = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + width]))
                out.append([{"start": int(a), "end": int(b) + width} for a, b in zip(p[new], p[np.append(new[1:], len(p)) - 1], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(out, kind)], [*ROW, "spans"])

    return run


def _cut(batches):
    """The text of each row without its word intervals, with the counts and the digest of what is left."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            starts, ends, _ = _text.words(data, np.array([0, len(data)], np.int64))
            spans = [(s["start"], s["end"]) for s in spans]
            left = joined_words(data, starts, ends, spans)
            out.append((len(starts), sum(b - a for a, b in spans), hashlib.sha256(left).hexdigest(), left.decode()))
        n, gone, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], [*ROW, "n_words", "n_removed", "kept_sha256", "cleaned"]
        )


def scanned(named: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Row, n_words, kept_sha256 (of all words) and anchors of every row of ``keyed_text``."""
    return named.mapInArrow(_scan(width, gram), "doc_id long, mark long, n_words long, kept_sha256 string, anchors array<long>")


def _named(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return _store.keyed_text(docs, text, id_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))


def _only(named: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``named`` that ``rows`` has, picked before the shuffle where their ids are few."""
    few = rows.limit(FEW_IDS + 1).count() <= FEW_IDS
    return named.join(F.broadcast(rows.select(*ROW)), ROW, "left_semi") if few else named


def repeated_spans(named: DataFrame, found: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, spans): the word intervals to remove, of each row that has any; ``found`` as ``scanned``, written."""
    anchors = found.select(*ROW, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("anchor", "n")
    shared = _store.materialise(shared, "shared")
    marked = _store.spread_join(anchors, shared, ["anchor"], ROW).groupBy(*ROW).agg(F.collect_set("anchor").alias("anchors"))
    marked = _store.materialise(marked, "found")
    _store.discard(shared)
    some = _store.materialise(_only(named, marked).join(marked, ROW), "marked")
    _store.discard(marked)
    windows = some.mapInArrow(_windows(width, gram), "doc_id long, mark long, pos int, key long, digest long")
    firsts = windows.groupBy("key", "digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").drop("hi")
    firsts = _store.materialise(firsts, "firsts")
    hits = _store.spread_join(windows, firsts, ["key", "digest"], [*ROW, "pos"]).filter("doc_id > lo")
    spans = hits.groupBy(*ROW).agg(F.collect_list("pos").alias("places")).mapInArrow(_merge(width), f"doc_id long, mark long, spans {SPANS}")
    spans = _store.materialise(spans, "spans")
    _store.discard(firsts, some)
    return spans


def cleaned(named: DataFrame, spans: DataFrame) -> DataFrame:
    """Row, n_words, n_removed, kept_sha256 and cleaned (the text that is left) of the rows with intervals to remove."""
    rows = _only(named, spans).join(spans, ROW)
    return rows.mapInArrow(_cut, "doc_id long, mark long, n_words long, n_removed long, kept_sha256 string, cleaned string")


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``: their text without repeated passages (words joined by one space, unchanged where nothing goes), and ``removed_spans``, the word intervals cut."""
    with _store.small_batches(docs.sparkSession):
        named = _named(docs, text, id_col)
        spans = repeated_spans(named, _store.materialise(scanned(named, width, gram), "anchors"), width, gram)
        cut = _store.materialise(cleaned(named, spans).select(*ROW, "cleaned").dropDuplicates(ROW).join(spans, ROW), "cut")
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("mark"))
    both = whole.join(cut, ROW, "left")
    changed = F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(F.col("cleaned"))
    columns = [changed.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns, F.coalesce("spans", F.array().cast(SPANS)).alias("removed_spans"))


def digests(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words left, joined by one space) of every row."""
    named = _named(docs)
    with _store.small_batches(docs.sparkSession):
        found = _store.materialise(scanned(named, width, gram), "anchors")
        stats = _store.materialise(found.drop("anchors"), "stats")
        spans = repeated_spans(named, found, width, gram)
        cut = _store.materialise(cleaned(named, spans).drop("cleaned"), "cut")
    _store.discard(found)
    whole = stats.select(*ROW, "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").join(spans.select(*ROW), ROW, "left_anti")
    return whole.unionByName(cut).select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_rabin_karp(spark, sf_dir: str) -> DataFrame:
    """All documents without the 50-word passages that occur in an earlier document."""
    return digests(_store.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS words FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS first FROM windows) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM repeated
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM words x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
