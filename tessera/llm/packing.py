"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

A sequence costs its tokens, a share that grows with the square of its length (attention) and
a fixed part, so neither the shortest nor the longest length is always the cheapest per token.
Items come by falling size. An item goes to the open bin with the least room that holds it. If
there is none, a bin is opened, and its length is chosen over all permitted ones together: each
is filled on trial with the items that are still to come, largest first, cut down to what it
then holds, and the length that costs least per token so filled is opened. At the end every bin
is cut down to the shortest permitted length that holds its contents. The whole group is also
packed with each single length, and with the shortest that holds the item, as the length to
open; the packing of least total cost stays, so choosing jointly never costs more than a plain
rule. Room is an integer up to the largest length, so the fullest fitting bin, and the largest
item that still fits, are one operation on a bit mask each.

Items are dealt by a hash of doc_id, text and piece into packing groups of about ``GROUP_ROWS``
rows, packed apart from one another; a group leaves at most a few bins part filled. Which items
share a bin depends on the group, as it does on all other items. Documents longer than the
largest length are split into pieces, never cut off.

Size: the words of the text plus one separator. Defined cases: null and blank texts have
size 1; ties go by doc_id and piece; repeated rows are packed as rows of their own; empty
input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import sizes

LENGTHS = (512, 1024, 2048, 4096)
GROUP_ROWS = 50_000
FIXED = 384  # of a sequence's cost


def cost(length: int) -> float:
    """The cost of one sequence: tokens, attention and a fixed part."""
    return length * (1 + length / 8192) + FIXED


class Remaining:
    """How many items of each size are still to come."""

    def __init__(self, items: list[int]):
        self.count, self.mask = Counter(items), 0
        for s in self.count:
            self.mask |= 1 << s

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.mask &= ~(1 << s)

    def fill(self, room: int) -> int:
        """What a bin with that room takes if it gets the largest item that fits, again and again."""
        mask, total = self.mask, 0
        while fits := mask & ((1 << room + 1) - 1):
            s = fits.bit_length() - 1
            n = min(self.count[s], room // s)
            total += n * s
            room -= n * s
            mask &= (1 << s) - 1
        return total


def fitting(size: int, lengths) -> int:
    """The shortest length that holds a size."""
    return next(c for c in lengths if c >= size)


def pack_one(items: list[int], lengths, choose) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (by falling size), and the bins' contents; ``choose`` gives a new bin's length."""
    left, mask = Remaining(items), 0
    by_room: dict[int, list[int]] = {}
    bins, places, used = [], [], []
    for s in items:
        left.take(s)
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            k, room = len(used), choose(s, left)
            used.append(0)
        bins.append(k)
        places.append(used[k])
        used[k] += s
        room -= s
        if room:
            by_room.setdefault(room, []).append(k)
            mask |= 1 << room
    return bins, places, used


def jointly(lengths):
    """The choice of length by trial fills of all lengths that hold the item."""

    def choose(s: int, left: Remaining) -> int:
        def per_token(c):
            held = s + left.fill(c - s)
            return cost(fitting(held, lengths)) / held, c

        return min((c for c in lengths if c >= s), key=per_token)

    return choose


def at_least(length: int, lengths):
    """Always the one length, or the shortest that holds the item."""
    return lambda s, left: max(length, fitting(s, lengths))


def pack(items: list[int], lengths=LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each item (by falling size); contents and final length of each bin. Of all ways to open bins, the one of least total cost."""
    ways = [pack_one(items, lengths, choose) for choose in (jointly(lengths), *(at_least(c, lengths) for c in lengths))]
    bins, places, used = min(ways, key=lambda way: sum(cost(fitting(u, lengths)) for u in way[2]))
    return bins, places, used, [fitting(u, lengths) for u in used]


def best_fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lengths=LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece of each document: its words, its bin, the bin's final length and its place there."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    groups = docs.count() // group_rows + 1
    items = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (sizes(F.col(f"`{text}`")) + 1).alias("total"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    items = items.withColumn("n_pieces", F.ceil(F.col("total") / most).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    items = items.select("doc_id", "mark", "piece", "n_pieces", (F.col("piece").cast("long") * most).alias("word_start"), F.least(F.lit(most), F.col("total") - F.col("piece").cast("long") * most).cast("int").alias("size"))
    items = items.withColumn("pack", F.pmod(F.xxhash64("doc_id", "mark", "piece"), F.lit(groups)).cast("int")).drop("mark")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, places, used, size = pack(rows["size"].tolist(), lengths)
        base = int(rows["pack"].iloc[0]) << 32
        return rows.assign(bin_id=[base + b for b in bins], bin_offset=places, bin_used=[used[b] for b in bins], bin_length=[size[b] for b in bins]).drop(columns="pack").astype({"doc_id": "Int64"})

    return items.groupBy("pack").applyInPandas(run, "doc_id long, piece int, n_pieces int, word_start long, size int, bin_id long, bin_offset int, bin_used int, bin_length int")


def op3_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512, 1,024, 2,048 and 4,096 tokens."""
    from ._store import table

    return best_fit(table(spark, sf_dir, "documents"))
