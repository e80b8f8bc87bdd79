import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_query(spark, folder, texts):
    got = mixing.op9_systematic(spark, folder)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    source = lambda i: [None, "b", "a", "ä"][i % 4]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    per = {}
    for i, n in size.items():
        per[source(i)] = per.get(source(i), 0) + n
    want = brute_targets(per)
    rows = got.collect()
    taken = dict.fromkeys(per, 0)
    for r in rows:
        s = source(r["doc_id"])
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert len(rows) == len(texts)
    for s in per:
        assert abs(taken[s] - want[s]) <= max(size.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_systematic(spark, folder).collect()))


@pytest.mark.parametrize("cell_rows", [100_000, 5, 1])
def test_same_as_sql(spark, folder, monkeypatch, cell_rows):
    """The same draws as the SQL's, however sizes are cut into cells."""
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    duckdb.sql(f"create or replace view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = duckdb.sql(mixing.OP9_SQL).fetchall()
    got = [tuple(r) for r in mixing.op9_systematic(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_ties_null_ids_and_reruns(spark):
    """Rows of one size in one source, ids null or repeated, blanks and nulls: the same texts on every run."""
    rows = [(None if i % 3 == 0 else i % 4, None if i % 7 == 0 else f"t{i % 11} x", "s", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    once = sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert once == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    taken = mixing.copies(docs).agg(F.sum(F.col("n_copies") * F.col("size")), F.max("target")).first()
    assert abs(taken[0] - taken[1]) <= 2


def test_mix_repeats_rows(docs, no_docs):
    drawn = mixing.copies(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == drawn.agg(F.sum("n_copies")).first()[0]
    assert mixing.mix(no_docs).count() == 0
