import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


def cost(used, lengths):
    return sum(packing.cost(packing.fitting(u, lengths)) for u in used)


def optimum(items, lengths):
    """The least cost over all ways to deal a few items into bins."""
    best = float("inf")

    def deal(k, loads):
        nonlocal best
        if k == len(items):
            best = min(best, cost(loads, lengths))
            return
        for i in range(len(loads)):
            if loads[i] + items[k] <= lengths[-1]:
                deal(k + 1, [*loads[:i], loads[i] + items[k], *loads[i + 1 :]])
        deal(k + 1, [*loads, items[k]])

    deal(0, [])
    return best


def smallest_fit(items, lengths):
    """Best fit by falling size, a new bin always of the shortest length that holds the item; bin by bin."""
    rooms, used = [], []
    for s in items:
        fit = [r for r in rooms if r >= s]
        if fit:
            k = rooms.index(min(fit))
        else:
            rooms.append(packing.fitting(s, lengths))
            used.append(0)
            k = len(rooms) - 1
        rooms[k] -= s
        used[k] += s
    return used


def well_formed(items, lengths, packed):
    bins, places, used, size = packed
    for k, u in enumerate(used):
        inside = sorted((p, s) for b, p, s in zip(bins, places, items) if b == k)
        assert sum(s for _, s in inside) == u <= size[k] == min(c for c in lengths if c >= u)
        assert [p for p, _ in inside] == [sum(s for _, s in inside[:i]) for i in range(len(inside))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=60))
def test_never_dearer_than_smallest_fit(items):
    items = sorted(items, reverse=True)
    packed = packing.pack(items)
    well_formed(items, packing.LENGTHS, packed)
    assert cost(packed[2], packing.LENGTHS) <= cost(smallest_fit(items, packing.LENGTHS), packing.LENGTHS) + 1e-6


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=7))
def test_near_the_optimum(items):
    items = sorted(items, reverse=True)
    best, ours = optimum(items, packing.LENGTHS), cost(packing.pack(items)[2], packing.LENGTHS)
    assert best - 1e-6 <= ours <= 1.5 * best


def test_longer_bins_open_and_are_cut_down():
    """Short items open longer bins than they need, as these can be filled; what stays short is cut down."""
    r = random.Random(4)
    items = sorted((r.randint(1, 400) for _ in range(2000)), reverse=True)
    opened = []

    def choose(s, left):
        opened.append((s, packing.jointly(packing.LENGTHS)(s, left)))
        return opened[-1][1]

    _, _, used = packing.pack_one(items, packing.LENGTHS, choose)
    assert all(s <= 400 and c > 512 for s, c in opened[:100])
    few = [700, 300, 20]
    made = []
    _, _, held = packing.pack_one(few, packing.LENGTHS, lambda s, left: made.append(2048) or 2048)
    assert held == [1020] and packing.fitting(held[0], packing.LENGTHS) == 1024  # cut down
    _, _, used, size = packing.pack(items)
    assert cost(used, packing.LENGTHS) < 0.9 * cost(smallest_fit(items, packing.LENGTHS), packing.LENGTHS) and len(set(size)) > 1


def test_query(spark, folder, texts):
    rows = packing.op3_best_fit(spark, folder).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, t in enumerate(texts):
        total = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["size"] for r in own) == total and [r["word_start"] for r in own] == [4096 * k for k in range(len(own))]
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for inside in bins.values():
        assert sum(r["size"] for r in inside) == inside[0]["bin_used"] <= inside[0]["bin_length"]
        assert inside[0]["bin_length"] == min(c for c in packing.LENGTHS if c >= inside[0]["bin_used"])


def test_groups_empty_and_null_ids(spark, docs, no_docs):
    assert packing.best_fit(no_docs).count() == 0
    assert packing.best_fit(docs, group_rows=10).count() == packing.best_fit(docs).count()
    rows = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["size"]) for r in packing.best_fit(rows).collect()) == [(0, 1), (1, 3), (1, 3)]


def test_fill_is_high():
    r = random.Random(4)
    items = sorted((min(4096, int(r.lognormvariate(5.6, 1)) + 1) for _ in range(20000)), reverse=True)
    _, _, used, size = packing.pack(items)
    assert sum(used) / sum(size) > 0.98
