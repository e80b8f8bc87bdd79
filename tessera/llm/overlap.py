"""Near-duplicates by SimHash and the Jaccard similarity of their word shingles, without loss.

All pairs with at least ``4 / 5`` of their joint shingles in common are linked. The links of their
SimHash fingerprints (``simhash``, ``LIMIT`` bits) come first; each is verified on whole sets, as a
fingerprint cannot decide Jaccard 0.8. Such pairs differ in 10 bits on average and in up to 20, so
the pairs that the fingerprints keep apart are then searched exactly, by prefixes.

Search: shingles have one global order, those that a sample shows to be common last, else by
hash; any order is exact, this one keeps buckets small. Of n shingles, two sets that similar share
one of the first n // 5 + 1 in that order (prefix filter), and at the first one they share, what
is left of both must still suffice (position filter). Every set has a bitmap of 256 parities of its
hashes; two bitmaps differ in no more bits than the sets in shingles, so pairs whose bitmaps differ in
more than a ninth of both sizes are no candidates (an exact bound; it tells most sets of up to some 500
shingles apart). Candidates meet the same bound on bitmaps of 2,048 parities before their whole sets are
compared, in as many turns as keep what is shipped at a time below half of all sets.

Groups: what the fingerprints link is one component from the start. A prefix shingle's bucket is
searched in rounds. First its members meet one pivot, and what that links leaves the search, so a tight group costs as many pairs as it has members. Then
members that are not connected yet are held against one another, so no link is lost; only those
that pass the size and position filters become candidates. Buckets beyond ``BUCKET`` rows are
dealt into blocks, and every two blocks meet in a task of their own.

Only prefixes are stored. The whole sets of candidates are made again from their texts.

Defined cases: texts are lower-cased (A-Z); with fewer words than a shingle the whole sequence is
the one shingle; null and blank texts equal one another; repeated rows are linked as copies; a
null doc_id comes after all others; rows that share a doc_id (or have none) are judged one by
one; empty input gives an empty result; other columns are untouched. Sets are compared by 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text, simhash
from .components import components
from .exact import keep_rows
from .simhash import early, name_groups

SHINGLE = 5
LIMIT = simhash.LIMIT
ROUNDS = 3
PIVOT_ROWS = 4096
PAIRS = 1 << 18
SAMPLE = 32768
COMMON = 8
BUCKET = 8192
FEW_NODES = 1_000_000  # so many candidates are sent to every task at most


def text_sets(column: pa.Array, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    buf, offsets = _text.text_buffer(column)
    for i, j in _text.blocks(offsets):
        part = buf[offsets[i] : offsets[j]]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, first = _text.words(part, offsets[i : j + 1] - offsets[i])
        hashes = _text.word_hashes(part, starts, ends)
        windows = _text.window_hashes(hashes, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(windows[a : b - shingle + 1])
            else:
                yield _text.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(1, np.uint64)


def common(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles that ``COMMON`` texts or more of a sample of about ``SAMPLE`` have."""
    texts = _store.doc_text(docs)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(docs.count() // SAMPLE + 1)) == 0)

    def run(batches):
        for batch in batches:
            found = list(text_sets(batch.column("text"), shingle))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["hash"])

    found = sample.select("text").mapInArrow(run, "hash long").groupBy("hash").count().filter(F.col("count") >= COMMON).select("hash").toArrow()
    return np.sort(np.asarray(found.column("hash").combine_chunks()).view(np.uint64))


def _node(x: np.ndarray) -> np.uint64:
    """A hash of a set."""
    return _text.mix(x, 3).sum() ^ _text.mix(x[:1], 5)[0]


BITS = ["b0", "b1", "b2", "b3"]


def bitmap(x: np.ndarray, log: int = 8) -> np.ndarray:
    """2**log parities of a set's hashes, as words of 64."""
    odd = np.bincount((_text.mix(x, 9) >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_near(n: np.ndarray, bits: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Which of the sets ``js`` the bitmaps do not keep apart from set i; ``bits``: one row a set."""
    return 9 * np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[js] + n[i]


def prefixes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, node (a hash of the set), n (its size), bitmap, the set's prefix in the global order and fp (the SimHash), of every row."""
    late = common(docs, shingle)

    def prefix(x):
        last = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x if len(late) else np.zeros(len(x), bool)
        return np.concatenate([x[~last], x[last]])[: len(x) // 5 + 1]

    def run(batches):
        for batch in batches:
            nodes, sizes, found, maps = [], [], [], []
            for x in text_sets(batch.column("text"), shingle):
                nodes.append(_node(x))
                maps.append(bitmap(x))
                sizes.append(len(x))
                found.append(prefix(x))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            fps = np.array([simhash.text_fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, *(pa.array(np.array([m[k] for m in maps], np.int64)) for k in range(4)), pa.array(fps.view(np.int64))], ["doc_id", "mark", "node", "n", "prefix", *BITS, "fp"])

    return _store.keyed_text(docs).mapInArrow(run, "doc_id long, mark long, node long, n int, prefix array<long>, b0 long, b1 long, b2 long, b3 long, fp long")


def simhash_pairs(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints are equal or linked, as a spanning set; ``found`` as ``prefixes``, written."""
    marked = _store.materialise(found.select("fp", "node").distinct(), "simhash")
    leads = _store.materialise(marked.groupBy("fp").agg(F.min("node").alias("lead")), "distinct")
    same = marked.join(leads, "fp").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = simhash.links(leads.select("fp"), limit).toDF("x", "y")
    far = near.join(leads.toDF("x", "a"), "x").join(leads.toDF("y", "b"), "y").select("a", "b")
    return same.union(far).filter("a <> b").distinct()


def whole_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, size, wide (2,048 parities) and hashes (the whole set) of rows with node and text."""

    def run(batches):
        for batch in batches:
            found = list(text_sets(batch.column("text"), shingle))
            wide = pa.array([bitmap(x, 11).tolist() for x in found], pa.list_(pa.int64()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in found], pa.int64()), wide, pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["node", "size", "wide", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, wide array<long>, hashes array<long>")


def _buckets(batches, names):
    """Rows of whole buckets as arrays; the rows come sorted by key."""
    held = None
    for batch in batches:
        now = [np.asarray(batch.column(c)) for c in names]
        held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _shared(batches):
    """The distinct rows of buckets with two nodes or more; sorted by key and node."""
    names = ["key", "node", "n", "pos"]
    for key, node, *rest in _buckets(batches, names):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        cols = [x[new] for x in (key, node, *rest)]
        same = cols[0][1:] == cols[0][:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)


def shared_probes(found: DataFrame) -> DataFrame:
    """(key, node, n, pos, bitmap): prefix shingles that two sets or more have, with the set's size and the shingle's place."""
    probes = found.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    spread = probes.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "n", "pos")
    shared = _store.materialise(spread.mapInArrow(_shared, "key long, node long, n int, pos int"), "shared")
    maps = found.groupBy("node").agg(*[F.first(b).alias(b) for b in BITS])  # of one node all are equal
    return shared.join(maps, "node").select("key", "node", "n", "pos", *BITS)


def blocked(named: DataFrame, pivots: bool) -> DataFrame:
    """key, block, node, n, pos and component of buckets that fit a task.

    Small buckets stay as they are. Large ones are dealt into blocks: for a round with pivots each block gets the bucket's
    smallest node, else a bucket is made of every two blocks. Rows of block -1 meet all others, the rest those of other blocks.
    """
    whole = F.struct("node", "n", "pos", "component", *BITS)
    hot = named.groupBy("key").agg(F.count("*").alias("rows"), F.min(whole).alias("pivot")).filter(F.col("rows") > BUCKET)
    hot = _store.materialise(hot.select("key", F.ceil(F.col("rows") / BUCKET).cast("int").alias("blocks"), "pivot"), "hot")
    cols = ["node", "n", "pos", "component", *BITS]
    if hot.isEmpty():
        return named.select("key", F.lit(-1).alias("block"), *cols)
    few = F.broadcast(hot) if hot.limit(100_001).count() <= 100_000 else hot
    both = named.join(few, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    if pivots:
        out = both.select(F.xxhash64("key", "block").alias("key"), F.lit(0).alias("block"), *cols)
        extra = hot.select("key", "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return out.unionByName(extra.select(F.xxhash64("key", "block").alias("key"), F.lit(0).alias("block"), "pivot.*"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    met = both.select("key", "block", *cols, other)
    return met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.when(F.col("other") == F.col("block"), -1).otherwise(F.col("block")).cast("int").alias("block"), *cols)


def _pairs(step: int | None):
    """Candidate pairs of each bucket across components: with one pivot in round ``step``, or all of them (None)."""

    def bucket(node, n, pos, comp, block, bits):
        names, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        if step is not None:
            main = np.flatnonzero(inverse == np.argmax(sizes))
            p = main[np.argmin(_text.mix(node[main].view(np.uint64), step))]
            hit = np.flatnonzero((comp != comp[p]) & (5 * np.minimum(n, n[p]) >= 4 * np.maximum(n, n[p])))
            hit = hit[may_be_near(n, bits, p, hit)]
            yield np.full(len(hit), node[p]), node[hit]
            return
        for i in range(len(node) - 1):
            left = np.minimum(n[i] - pos[i], n[i + 1 :] - pos[i + 1 :])
            apart = (block[i + 1 :] != block[i]) | (block[i] < 0)
            hit = np.flatnonzero((comp[i + 1 :] != comp[i]) & apart & (9 * left >= 4 * (n[i + 1 :] + n[i]))) + i + 1
            hit = hit[may_be_near(n, bits, i, hit)]
            yield np.full(len(hit), node[i]), node[hit]

    def out(a, b):
        x = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["a", "b"])

    def run(batches):
        a, b, held = [], [], 0
        for key, node, n, pos, comp, block, *words in _buckets(batches, ("key", "node", "n", "pos", "component", "block", *BITS)):
            bits = np.stack(words, axis=1).view(np.uint64)
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                for x, y in bucket(node[s:e], n[s:e], pos[s:e], comp[s:e], block[s:e], bits[s:e]):
                    if len(x):
                        a.append(x)
                        b.append(y)
                        held += len(x)
                    if held >= PAIRS:
                        yield out(a, b)
                        a, b, held = [], [], 0
        if held:
            yield out(a, b)

    return run


def verified(pairs: DataFrame, found: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs whose whole sets have Jaccard similarity 0.8 or more. The rows of a pivot with very many pairs are salted."""
    per = _store.materialise(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("k")), "pivots")
    wanted = _store.materialise(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "candidates")
    few = wanted.limit(FEW_NODES + 1).count() <= FEW_NODES
    # One text of each candidate, its set made again.
    leads = found.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").groupBy("node").agg(F.min(early()).alias("lead"))
    leads = _store.materialise(leads.select("node", F.struct("lead.doc_id", "lead.mark").alias("lead")), "leads")
    named = _store.keyed_text(docs).select(F.struct("doc_id", "mark").alias("name"), "text")
    texts = named.join(F.broadcast(leads) if few else leads, F.col("name").eqNullSafe(F.col("lead")))
    whole = _store.materialise(whole_sets(texts, shingle), "wanted")
    # Of a node with several rows one is enough; all are equal.
    once = whole if whole.count() == leads.count() else _store.materialise(whole.dropDuplicates(["node"]), "wanted")
    slim = once.select("node", "size", "wide")
    pivots = slim.toDF("a", "size_a", "wide_a").join(per.select("a", "n"), "a")
    both = _store.spread_join(pairs.join(slim.toDF("b", "size_b", "wide_b"), "b"), pivots, ["a"], ["b"], PIVOT_ROWS)
    differ = F.expr("aggregate(zip_with(wide_a, wide_b, (x, y) -> bit_count(x ^ y)), 0, (s, k) -> s + k)")
    near = _store.materialise(both.filter(9 * differ <= F.col("size_a") + F.col("size_b")).select("a", "b", (F.col("size_a") + F.col("size_b")).alias("shipped")), "near")
    all_sets = found.agg(F.sum("n")).first()[0]
    turns = -(-2 * (near.agg(F.sum("shipped")).first()[0] or 0) // all_sets)
    links = None
    for turn in range(turns):
        now = near.filter(F.pmod(F.xxhash64("a", F.lit(3)), F.lit(turns)) == turn)
        right = now.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).select("a", "b", "salt")
        left = once.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(per, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
        left = left.join(now.select("a").distinct(), "a", "left_semi")
        met = right.join(once.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(left, ["a", "salt"])
        done = _store.materialise(met.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "links")
        links = done if links is None else links.union(done)
    _store.discard(whole, *([] if once is whole else [once]))
    return near.select("a", "b").limit(0) if links is None else links


def links(found: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect all sets of Jaccard similarity 0.8 or more; ``found`` as ``prefixes``, written."""
    probes = _store.materialise(shared_probes(found), "shared")
    known = tried = None
    named, fresh = probes.withColumn("component", F.col("node")), False
    for step in ["simhash", *range(ROUNDS), None]:
        if fresh:
            named = probes.join(components(known).withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left").select("key", probes["node"], "n", "pos", *BITS, F.coalesce("component", "node").alias("component"))
            named, fresh = _store.materialise(named, "buckets"), False
        if step == "simhash":
            found_pairs = simhash_pairs(found)
        else:
            met = blocked(named, step is not None)
            found_pairs = met.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(step), "a long, b long").distinct()
        if tried is not None:
            back = tried.union(tried.select("b", "a"))
            found_pairs = found_pairs.join(back, ["a", "b"], "left_anti")
        pairs = _store.materialise(found_pairs, "pairs")
        if pairs.isEmpty():
            continue
        more = verified(pairs, found, docs, shingle)
        known, fresh = more if known is None else known.union(more), True
        tried = pairs if tried is None else tried.union(pairs)
    return known if known is not None else probes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, node, component_id (smallest doc_id reachable) and kept of every row."""
    with _store.small_batches(docs.sparkSession):
        found = _store.materialise(prefixes(docs, shingle), "prefixes")
        linked = components(links(found, docs, shingle))
        groups = _store.materialise(name_groups(found.select("doc_id", "mark", "node"), linked, "node"), "groups")
    _store.discard(found)
    return groups


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest doc_id of each component (of its repeated rows, one)."""
    return keep_rows(docs, near_groups(_store.doc_text(docs, text, id_col), shingle), text, id_col)
