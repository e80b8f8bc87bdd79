"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprint: texts are lower-cased (A-Z), cut into words and shingles, and a bit is set
where more than half of the shingles' XXH64 values (seed 42) have it set.

Search: the 64 bits are dealt into m parts, bits that agree with one another going to the
same part, so that the other parts tell more. If part i gets a threshold t_i >= -1 with
sum(t_i + 1) = limit + 1, two fingerprints within ``limit`` bits differ in at most t_i bits
in at least one part. A dynamic program gives the parts the thresholds of least estimated
cost; the estimate rests on the agreement rates of all distinct fingerprints and on the
number of pairs equal in each part. m is chosen the same way, so larger inputs get longer
parts. A part with threshold t is probed with every way of leaving t of its bits out, and
fingerprints that share a probe are verified.

Verification runs on distinct fingerprints only. A probe's bucket is searched outwards from
one member at a time: all unreached members within the limit are reached and leave the
search, so a tight cluster costs a few passes and gives a spanning forest, not all pairs.
Buckets beyond ``BUCKET`` rows are dealt into blocks; those outside the largest component
that the blocks give on their own then meet every block, so no link is lost and no task
holds more than two blocks of a bucket.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; with
fewer words than a shingle the whole sequence is the one shingle; repeated rows are linked
as copies; a null doc_id comes after all others; empty input gives an empty result; other
columns are untouched. When rows are dropped, a row is named by its doc_id and text, so rows
that share a doc_id (or have none) are judged one by one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from .components import components
from .exact import keep_rows

BITS = 64
LIMIT = 4
SHINGLE = 4
SEED = 42
BUCKET = 8192
STEP = 1 << 16


def text_fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lens + 1) - 1
    width = min(shingle, len(tokens))
    starts, ends = (ends - lens)[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(starts), STEP):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint(shingle: int):
    def run(batches):
        for batch in batches:
            out = [0 if t is None else text_fingerprint(t.encode(), shingle) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark and fp (the 64 bits as a signed long) of every row."""
    return _store.keyed_text(docs).mapInArrow(_fingerprint(shingle), "doc_id long, mark long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def agreement(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set (64 x 64), over all of them."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for i in range(0, len(fp), STEP):
                x = _bits(fp[i : i + STEP]).astype(np.float32)
                both += x.T @ x
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    parts = distinct.select("fp").mapInArrow(run, "n long, both array<double>")
    rows = parts.select("n", F.posexplode("both").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["k"]] = r["x"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of nearly equal size; each part grows by the bit that agrees most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(sorted(free), key=lambda b: corr[b, part].sum()))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_costs(n: int, p: np.ndarray, equal_pairs: float, part: list[int], limit: int = LIMIT) -> list[float]:
    """Estimated cost of thresholds -1, 0, 1, ... of a part: probes written plus pairs met.

    Pairs that agree outside t chosen bits: those equal in the whole part, over the chance
    that the chosen bits agree, summed over the choices (an elementary symmetric sum).
    """
    ratio = 1 / np.maximum(p[part] ** 2 + (1 - p[part]) ** 2, 0.5)
    e = np.zeros(limit + 1)
    e[0] = 1
    for r in ratio:
        e[1:] = e[1:] + r * e[:-1]
    return [0.0] + [300.0 * n * comb(len(part), t) + equal_pairs * e[t] for t in range(limit + 1)]


def allocate(costs: list[list[float]], limit: int = LIMIT) -> tuple[float, list[int]]:
    """Thresholds (-1: part unused) with sum(t + 1) = limit + 1 of least total cost, by dynamic programming."""
    need = limit + 1
    best = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, x in enumerate(cost):
                if used + k <= need and (used + k not in after or c + x < after[used + k][0]):
                    after[used + k] = (c + x, [*ts, k - 1])
        best = after
    return best[need]


def plan(distinct: DataFrame, limit: int = LIMIT, choices=(2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """Parts of bits with their thresholds, for these fingerprints."""
    n, both = agreement(distinct)
    p = np.diag(both) / max(n, 1)
    tried = []
    options = {m: correlated_parts(n, both, m) for m in choices if m <= limit + 1} or {1: correlated_parts(n, both, 1)}
    keys = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts)]
    # Pairs equal in each part: sums of squares over the buckets, in one pass over all fingerprints.
    rows = _probes(distinct, [(part, 0) for _, _, part in keys]).groupBy("part", "probe").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum((F.col("c") * (F.col("c") - 1)).cast("double")).alias("pairs")).collect()
    pairs = {r["part"]: r["pairs"] / 2 for r in rows}
    for m, parts in options.items():
        costs = [part_costs(n, p, pairs.get(j, 0.0), part, limit) for j, (k, _, part) in enumerate(keys) if k == m]
        total, ts = allocate(costs, limit)
        tried.append((total, m, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(tried, key=lambda x: (x[0], x[1]))[2]


def _probes(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, probe, fp): every fingerprint under each of its probes."""
    masks = []
    for k, (part, t) in enumerate(parts):
        for left_out in combinations(part, t):
            masks.append((k, sum(1 << b for b in part if b not in left_out), sum(1 << b for b in left_out)))
    ks = np.array([k for k, _, _ in masks], dtype=np.int32)
    keep = np.array([m for _, m, _ in masks], dtype=np.uint64)
    # The probe's own number keeps different left-out bits apart.
    tags = _text.mix(np.arange(len(masks), dtype=np.uint64), 7)

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            step = max(1, (1 << 18) // len(keep))
            for i in range(0, len(fp), step):
                x = fp[i : i + step]
                probe = _text.mix((x[:, None] & keep[None, :]) ^ tags[None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(ks, len(x))), pa.array(probe.ravel().view(np.int64)), pa.array(np.repeat(x, len(keep)).view(np.int64))], ["part", "probe", "fp"]
                )

    return distinct.select("fp").mapInArrow(run, "part int, probe long, fp long")


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= limit


def bucket_links(fp: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, searched outwards."""
    left, a, b = fp, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _near(left, x, limit)
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found.tolist())
                todo = [np.uint64(v) for v in todo]
                left = left[~hit]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _verify(limit: int):
    small = 48

    def links(key: np.ndarray, fp: np.ndarray):
        """Links within equal neighbouring keys; the rows are sorted by key."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        a, b = [], []
        for s, n in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
            x, y = bucket_links(np.unique(fp[s : s + n]), limit)
            a.append(x)
            b.append(y)
        rest = np.repeat((size > 1) & (size <= small), size)
        key, fp = key[rest], fp[rest]
        at, k = np.arange(len(key)), 1
        while len(at):
            at = at[at + k < len(key)]
            at = at[key[at] == key[at + k]]
            hit = at[_near(fp[at], fp[at + k], limit)]
            a.append(fp[hit])
            b.append(fp[hit + k])
            k += 1
        empty = np.zeros(0, np.uint64)
        return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)

    def out(a, b):
        x = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(x[:, 1]).view(np.int64))], ["a", "b"])

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column("key"))])
            fps = np.concatenate([fps, np.asarray(batch.column("fp")).view(np.uint64)])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
            if last:
                yield out(*links(keys[:last], fps[:last]))
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield out(*links(keys, fps))

    return run


def links(distinct: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``limit`` bits, as a spanning set.

    A bucket beyond ``bucket`` rows is searched in two passes. First each of its blocks on its
    own, with one member of the bucket added to all; that joins a tight cluster, however large.
    Then only the members outside the bucket's largest component so far meet all blocks.
    """
    probes = _probes(distinct, plan(distinct, limit)).select(F.xxhash64("part", "probe").alias("key"), "fp")
    counts = probes.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot"))
    hot = _store.materialise(counts.filter(F.col("n") > bucket).withColumn("n", F.ceil(F.col("n") / bucket).cast("int")), "hot")
    if hot.isEmpty():
        return _verified(probes, limit)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    large = _store.materialise(probes.join(hot, "key").withColumn("block", block), "large")
    alone = lambda b: F.xxhash64("key", b, F.lit(1)).alias("key")
    first = large.select(alone("block"), "fp").unionByName(hot.withColumn("block", blocks(F.col("n"))).select(alone("block"), F.col("pivot").alias("fp")))
    base = _store.materialise(_verified(probes.join(hot, "key", "left_anti").unionByName(first), limit), "links")
    named = large.join(components(base), F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "block", F.coalesce("component", "fp").alias("component"))
    named = _store.materialise(named, "named")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", "size").alias("main"), (F.sum("size") - F.max("size")).alias("outside")).filter("outside > 0")
    main = _store.materialise(main.withColumn("m", F.ceil(F.col("outside") / bucket).cast("int")), "main")
    if main.isEmpty():
        return base
    both = named.join(main, "key")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int")
    meet = lambda j, i: F.xxhash64("key", j, i, F.lit(2)).alias("key")
    outside = both.filter("component <> main").withColumn("j", mine).withColumn("i", blocks(F.col("n"))).select(meet("j", "i"), "fp")
    all_rows = both.withColumn("j", blocks(F.col("m"))).select(meet("j", "block"), "fp")
    return base.unionByName(_verified(outside.unionByName(all_rows), limit)).distinct()


def _verified(probes: DataFrame, limit: int) -> DataFrame:
    """Links among the fingerprints that share a key."""
    spread = probes.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_verify(limit), "a long, b long").distinct()


def early() -> F.Column:
    """The order in which rows of a group come: the first one stays."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))


def name_groups(rows: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """doc_id, mark, node, component_id (smallest doc_id reachable) and kept of every row.

    ``rows``: doc_id, mark, node, written; ``found``: (node, component) of the nodes with a link.
    """
    nodes = _store.materialise(rows.groupBy(node).agg(F.min(early()).alias("first"), F.count("*").alias("n")), "nodes")
    linked = found.select(F.col("node").alias("linked"), "component")
    joined = nodes.join(linked, F.col(node) == F.col("linked"), "left").select(node, "first", "n", F.coalesce("component", node).alias("component"))
    joined = _store.materialise(joined, "named")
    sizes = joined.groupBy("component").agg(F.min("first").alias("lead"), F.count("*").alias("n"))
    named = _store.spread_join(joined.withColumnRenamed("n", "members"), _store.materialise(sizes, "components"), ["component"], [node]).select(node, "lead", F.col("members").alias("n"))
    out = _store.spread_join(rows, _store.materialise(named, "leads"), [node], ["doc_id", "mark"])
    kept = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("mark") == F.col("lead.mark"))
    return out.select("doc_id", "mark", node, F.col("lead.doc_id").alias("component_id"), kept.alias("kept"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, mark, fp, component_id (smallest doc_id reachable) and kept of every row."""
    rows = _store.materialise(fingerprints(docs, shingle), "simhash")
    distinct = _store.materialise(rows.select("fp").distinct(), "distinct")
    return name_groups(rows, components(links(distinct, limit)), "fp")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest doc_id of each component (of its repeated rows, one)."""
    return keep_rows(docs, near_groups(_store.doc_text(docs, text, id_col), shingle, limit), text, id_col)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, four-word shingles, four differing bits or fewer."""
    groups = near_groups(_store.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
