"""Exact deduplication with composable polynomial fingerprints.

The normalised text (each run of 0x20 and 0x09-0x0D becomes one space) is cut into chunks.
A chunk's fingerprint is a polynomial of its bytes modulo two primes; the fingerprint of two
neighbours is ``left * base**len(right) + right``, so chunks are hashed apart and combined in
any grouping. Documents beyond ``SPLIT`` bytes are dealt in pieces over many tasks, each piece
normalised with a look at the byte before it, and the pieces' fingerprints combine in Spark.
Only their SHA-256, which no one can split, is streamed in one task.

Rows with equal fingerprint and length form a class. Every member of a class is then compared
with the class's first row, chunk by chunk, in a join on (class, chunk number): members are
salted and only the one representative is repeated, so a class with a third of all rows
spreads over many tasks and never meets in one. Members that differ form a class of their own
and are compared again, until none is left.

Defined cases: null text counts as empty, and all empty texts are equal; the row with the
smallest doc_id stays (a null doc_id comes after all others; between equal doc_ids the least
hash of the text as it stands decides); of repeated rows with the same doc_id and text exactly
one stays; empty input gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

CHUNK = 1 << 16
SPLIT = 1 << 22  # longer documents are hashed in pieces of PIECE bytes, each a row
PIECE = 1 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
SALT_ROWS = 2000
LAST = (1 << 63) - 1
#: So many classes are sent to every task at most; beyond, the join shuffles.
BROADCAST_CLASSES = 200_000

_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int) -> np.ndarray:
    """base**i modulo prime for i below CHUNK."""
    if (base, prime) not in _TABLES:
        out = np.empty(CHUNK, dtype=np.uint64)
        out[0], done = 1, 1
        while done < CHUNK:
            m = min(done, CHUNK - done)
            out[done : done + m] = out[:m] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += m
        _TABLES[base, prime] = out
    return _TABLES[base, prime]


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int, primes=PRIMES) -> tuple[int, int]:
    """The fingerprint of two neighbouring pieces from theirs, by length-shifted arithmetic."""
    return tuple((a * pow(b, right_len, p) + c) % p for a, c, b, p in zip(left, right, BASES, primes, strict=True))


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every run of white space replaced by one space."""
    space = _text.SPACE[buf]
    again = np.zeros(len(buf), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    again[first] = False
    keep = ~again
    out = np.where(space, np.uint8(32), buf)[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def fingerprints(buf: np.ndarray, offsets: np.ndarray, primes=PRIMES, chunk: int = CHUNK) -> np.ndarray:
    """One row of two residues for each text, hashed in chunks of ``chunk`` bytes and combined."""
    n = len(offsets) - 1
    out = np.zeros((n, 2), dtype=np.int64)
    lens = np.diff(offsets)
    pieces = -(-lens // chunk)
    if not pieces.sum():
        return out
    doc = np.repeat(np.arange(n), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[doc] + number * chunk
    end = np.minimum(start + chunk, offsets[doc + 1])
    power = np.repeat(end - offsets[0], end - start) - 1 - np.arange(end[-1] - start[0])
    data = buf[start[0] : end[-1]].astype(np.uint64) + np.uint64(1)
    for k, prime in enumerate(primes):
        h = np.add.reduceat(data * _powers(BASES[k], prime)[power], start - start[0]) % np.uint64(prime)
        out[doc[number == 0], k] = h[number == 0]
        for i in np.flatnonzero(number > 0):
            out[doc[i], k] = (int(out[doc[i], k]) * pow(BASES[k], int(end[i] - start[i]), prime) + int(h[i])) % prime
    return out


CLASS = ["f1", "f2", "n_bytes"]
ROW = ["doc_id", "mark"]


def chunk_streams(data: np.ndarray, before_space: bool = False):
    """The normalised chunks of one text, a step at a time; ``before_space``: the byte before the text is white space."""
    rest = np.zeros(0, np.uint8)
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        clean, _ = normalise(part, np.array([0, len(part)], np.int64))
        if before_space and len(clean) and clean[0] == 32:
            clean = clean[1:]
        before_space = bool(_text.SPACE[part[-1]])
        rest = np.concatenate([rest, clean])
        whole = len(rest) // CHUNK * CHUNK
        for k in range(0, whole, CHUNK):
            yield rest[k : k + CHUNK]
        rest = rest[whole:]
    if len(rest):
        yield rest


def streamed(data: np.ndarray, primes=PRIMES, before_space: bool = False, sha: bool = True) -> tuple[int, int, int, str | None]:
    """Fingerprint, length and SHA-256 of one normalised text, never held as a whole."""
    f, n, digest = (0, 0), 0, hashlib.sha256() if sha else None
    for chunk in chunk_streams(data, before_space):
        one = fingerprints(chunk, np.array([0, len(chunk)], np.int64), primes)[0]
        f = combine(f, (int(one[0]), int(one[1])), len(chunk), primes)
        n += len(chunk)
        if sha:
            digest.update(chunk.tobytes())
    return f[0], f[1], n, digest.hexdigest() if sha else None


def _hashed(primes):
    def run(batches):
        for batch in batches:
            buf, offsets = _text.text_buffer(batch.column("text"))
            for i, j in _text.blocks(offsets):
                if offsets[j] - offsets[i] > PIECE:  # one long text
                    found = [[x] for x in streamed(buf[offsets[i] : offsets[j]], primes)]
                else:
                    clean, offs = normalise(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    fp, raw = fingerprints(clean, offs, primes), clean.tobytes()
                    found = [fp[:, 0], fp[:, 1], np.diff(offs), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ROW] + [pa.array(x, t) for x, t in zip(found, kinds, strict=True)], [*ROW, *CLASS, "text_sha256"])

    return run


def _piece_fingerprints(primes):
    """The fingerprint of each piece, and base**length to shift what lies to its left."""

    def run(batches):
        for batch in batches:
            rows = []
            for no, body in zip(batch.column("no").to_pylist(), batch.column("body"), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                f1, f2, n, _ = streamed(data[no > 0 :], primes, bool(no) and bool(_text.SPACE[data[0]]), sha=False)
                rows.append((no, f1, f2, n, pow(BASES[0], n, primes[0]), pow(BASES[1], n, primes[1])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ROW] + [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]], [*ROW, "no", "f1", "f2", "n", "s1", "s2"])

    return run


def _in_pieces(long: DataFrame, primes) -> DataFrame:
    """Row and class of long texts (distinct rows), hashed in pieces spread over the cluster and combined."""
    one = f"transform(sequence(0, cast((octet_length(text) - 1) div {PIECE} as int)), i -> struct(i as no, substring(cast(text as binary), i * {PIECE} + if(i = 0, 1, 0), {PIECE} + if(i = 0, 0, 1)) as body))"
    pieces = long.select(*ROW, F.explode(F.expr(one)).alias("p")).select(*ROW, "p.no", "p.body").repartition(*ROW, "no")
    found = pieces.mapInArrow(_piece_fingerprints(primes), "doc_id long, mark long, no int, f1 long, f2 long, n long, s1 long, s2 long")
    parts = found.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("no", "f1", "f2", "n", "s1", "s2"))).alias("parts"))

    def step(acc, x):
        f = [F.pmod(acc[f"f{k}"] * x[f"s{k}"] + x[f"f{k}"], F.lit(primes[k - 1]).cast("long")).alias(f"f{k}") for k in (1, 2)]
        return F.struct(*f, (acc["n_bytes"] + x["n"]).alias("n_bytes"))

    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in CLASS])
    return parts.select(*ROW, F.aggregate("parts", zero, step).alias("c")).select(*ROW, "c.*")


def _sha_only(batches):
    for batch in batches:
        buf, offsets = _text.text_buffer(batch.column("text"))
        sha = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            digest = hashlib.sha256()
            for chunk in chunk_streams(buf[a:b]):
                digest.update(chunk.tobytes())
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ROW] + [pa.array(sha, pa.string())], [*ROW, "text_sha256"])


def hashed(named: DataFrame, primes=PRIMES) -> DataFrame:
    """Row, f1, f2, n_bytes and text_sha256 of every row of ``keyed_text``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = named.filter(size <= SPLIT).mapInArrow(_hashed(primes), "doc_id long, mark long, f1 long, f2 long, n_bytes long, text_sha256 string")
    long = _store.materialise(named.filter(size > SPLIT), "long-texts")
    if long.isEmpty():
        return out
    named_key = lambda d: d.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    long = named_key(long)
    sha = long.mapInArrow(_sha_only, "doc_id long, mark long, text_sha256 string")
    both = sha.join(_in_pieces(long.dropDuplicates(ROW), primes), ROW).withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
    return out.unionByName(both)


def _pieces(primes):
    """The normalised chunks of each text with its class; an empty text has one empty chunk."""

    def batch_of(batch, rows, cls, no, held):
        named = [batch.column(c).take(pa.array(rows)) for c in ROW]
        return pa.RecordBatch.from_arrays([*named, *(pa.array(x, pa.int64()) for x in cls), pa.array(no, pa.int32()), pa.array(held, pa.binary())], [*ROW, *CLASS, "chunk", "piece"])

    def run(batches):
        for batch in batches:
            buf, offsets = _text.text_buffer(batch.column("text"))
            for i, j in _text.blocks(offsets):
                if offsets[j] - offsets[i] > PIECE:  # one long text, some chunks at a time
                    data = buf[offsets[i] : offsets[j]]
                    f1, f2, n, _ = streamed(data, primes, sha=False)
                    held, no = [], 0
                    for chunk in chunk_streams(data):
                        held.append(chunk.tobytes())
                        if len(held) == 64:
                            yield batch_of(batch, [i] * 64, [[x] * 64 for x in (f1, f2, n)], range(no, no + 64), held)
                            no, held = no + 64, []
                    if held:
                        yield batch_of(batch, [i] * len(held), [[x] * len(held) for x in (f1, f2, n)], range(no, no + len(held)), held)
                    continue
                clean, offs = normalise(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                fp, lens, raw = fingerprints(clean, offs, primes), np.diff(offs), clean.tobytes()
                count = np.maximum(-(-lens // CHUNK), 1)
                of = np.repeat(np.arange(j - i), count)
                no = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                starts = offs[of] + no * CHUNK
                ends = np.minimum(starts + CHUNK, offs[of + 1])
                yield batch_of(batch, of + i, [fp[of, 0], fp[of, 1], lens[of]], no, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    return run


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each class and how many it has."""
    early = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    return rows.groupBy(*CLASS).agg(F.min(early).alias("first"), F.count("*").alias("n"))


def verified(named: DataFrame, classes: DataFrame, primes=PRIMES) -> DataFrame | None:
    """Rows of ``classes`` that differ from their class's first row, with ``sub`` (1, 2, ...); None if there are none.

    ``classes``: f1, f2, n_bytes, first (the class's first row), n (its members), written.
    """
    pieces = named.mapInArrow(_pieces(primes), "doc_id long, mark long, f1 long, f2 long, n_bytes long, chunk int, piece binary")
    if classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        pieces = pieces.join(F.broadcast(classes.select(*CLASS)), CLASS, "left_semi")
    else:
        pieces = _store.spread_join(pieces, classes.select(*CLASS, "n"), CLASS, [*ROW, "chunk"], SALT_ROWS)
    left = members = _store.materialise(pieces, "members")
    apart, sub, first = None, 0, classes
    while True:
        same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
        few = first.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
        reps = left.join(F.broadcast(first) if few else first, CLASS).filter(same).dropDuplicates([*CLASS, "chunk"])
        reps = _store.materialise(reps.select(*CLASS, "chunk", F.col("piece").alias("rep"), "n"), "representatives")
        compared = _store.spread_join(left, reps, [*CLASS, "chunk"], ROW, SALT_ROWS)
        differ = _store.materialise(compared.filter(F.col("piece") != F.col("rep")).select(*CLASS, *ROW).distinct(), "differ")
        _store.discard(reps)
        if differ.isEmpty():
            _store.discard(members)
            return apart
        sub += 1
        now = differ.withColumn("sub", F.lit(sub))
        apart = _store.materialise(now if apart is None else apart.join(differ, [*CLASS, *ROW], "left_anti").unionByName(now), "apart")
        key = F.struct(*CLASS, *ROW)
        left = _store.materialise(left.alias("l").join(differ.select(key.alias("gone")), key.eqNullSafe(F.col("gone")), "left_semi"), "members")
        first = _store.materialise(_first(differ), "classes")


def exact_groups(named: DataFrame, primes=PRIMES) -> DataFrame:
    """doc_id, mark, keep_id, keep_mark, group_size, kept and text_sha256, one row for each row of ``keyed_text``."""
    rows = _store.materialise(hashed(named, primes), "fingerprints")
    classes = _store.materialise(_first(rows).filter("n > 1"), "classes")
    apart = verified(named, classes, primes)
    key = [*CLASS, "sub"]
    rows = rows.withColumn("sub", F.lit(0))
    if apart is not None:
        there = F.struct(*CLASS, *ROW)
        rows = rows.drop("sub").alias("r").join(apart.select(there.alias("there"), "sub"), there.eqNullSafe(F.col("there")), "left")
        rows = _store.materialise(rows.withColumn("sub", F.coalesce("sub", F.lit(0))).drop("there"), "fingerprints")
    early = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"), F.col("text_sha256").alias("text_sha256"))
    groups = _store.materialise(rows.groupBy(*key).agg(F.min(early).alias("first"), F.count("*").alias("n")), "groups")
    alone = groups.filter("n = 1").select(
        "first.doc_id", "first.mark", F.col("first.doc_id").alias("keep_id"), F.col("first.mark").alias("keep_mark"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "first.text_sha256")
    many = groups.filter("n > 1").withColumn("group_size", F.col("n"))
    if many.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        met = rows.join(F.broadcast(many.drop("n")), key)
    else:
        met = _store.spread_join(rows, many, key, ROW)
    # Rows repeated with one doc_id and text are counted, then dealt out again: the first of them can stay.
    met = met.groupBy(*ROW, "text_sha256", "first", "group_size").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("copy") == 1)
    met = met.select("doc_id", "mark", F.col("first.doc_id").alias("keep_id"), F.col("first.mark").alias("keep_mark"), "group_size", stays.alias("kept"), "text_sha256")
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of equal texts."""
    return keep_rows(docs, exact_groups(_store.keyed_text(docs, text, id_col)), text, id_col)


def keep_rows(docs: DataFrame, groups: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id and mark ``groups`` (doc_id, mark, kept) keep; of rows repeated with both, one."""
    rows = _store.materialise(groups.groupBy(*ROW).agg(F.max("kept").alias("kept"), F.count("*").alias("copies")), "decisions")
    gone = rows.filter(~F.col("kept")).select(F.struct(*ROW).alias("gone"))
    named = docs.select(F.struct("*").alias("row"), F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("mark")).alias("name"))
    stays = named.join(gone, F.col("name").eqNullSafe(F.col("gone")), "left_anti")
    twice = rows.filter("kept AND copies > 1").select(F.struct(*ROW).alias("twice"))
    if twice.isEmpty():
        return stays.select("row.*")
    # Of rows repeated with one doc_id and text, the one with the least hash of all its columns.
    again = stays.join(twice, F.col("name").eqNullSafe(F.col("twice")), "left_semi").groupBy("name").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return stays.join(twice, F.col("name").eqNullSafe(F.col("twice")), "left_anti").select("row.*").unionAll(again.select("row.*"))


def op6_exact(spark, sf_dir: str) -> DataFrame:
    """One row a document: which row of its group of equal texts stays, and the group's size."""
    return exact_groups(_store.keyed_text(_store.table(spark, sf_dir, "documents"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
