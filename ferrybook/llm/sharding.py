"""Contiguous shards whose largest is as small as possible.

Groups of equal texts stay together. They are ordered by a hash of the text, and
the ordered group sizes are cut into contiguous shards: a binary search finds the
smallest capacity with which a greedy pass needs no more than the wanted shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrybook.llm.common import cut_lineage

KEY_BITS = 64
#: Most rows of a histogram that the driver sees at once: 2**16 at first, and as
#: many again at most for each finer look at the ranges that hold a cut.
HISTOGRAM_BITS = 16
#: Cells that number the rows of a shard side by side.
CELLS = 4096


@dataclass
class Range:
    """A range of keys: where it starts, its bits, its bytes, how many groups."""

    low: int
    bits: int
    bytes: int
    groups: int


class Cuts:
    """Sizes in key order at a resolution that is refined where a cut may fall."""

    def __init__(self, groups: DataFrame, shards: int):
        self.groups, self.shards = groups, shards
        bits = KEY_BITS - HISTOGRAM_BITS
        self.coarse = bits  # bits of the ranges that are looked at more closely
        self.ranges = self._histogram(None, bits)
        self._index()
        self.largest = groups.agg(F.max("bytes")).first()[0] or 0

    def _histogram(self, where: DataFrame | None, bits: int) -> list[Range]:
        groups = self.groups
        if where is not None:  # 2**17 numbers of ranges at most
            number = F.shiftright("key", self.coarse)
            groups = groups.join(F.broadcast(where), number == F.col("picked"), "left_semi")
        rows = (
            groups.groupBy(F.shiftright("key", bits).alias("part"))
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))
            .collect()
        )
        return sorted((Range(r[0] << bits, bits, r[1], r[2]) for r in rows), key=lambda r: r.low)

    def _where(self, spans: list[list[int]]) -> DataFrame:
        """The numbers of the ranges in the spans, as a table made from one constant."""
        numbers = (n for low, high in spans for n in range(low >> self.coarse, (high >> self.coarse) + 1))
        listed = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")
        return self.groups.sparkSession.range(1).select(F.explode(listed).alias("picked"))

    def _index(self) -> None:
        self.ends = [0, *accumulate(r.bytes for r in self.ranges)]

    def _at(self, position: int) -> int:
        """The last boundary at or before a position."""
        return bisect_right(self.ends, position) - 1

    def _splits(self, position: int) -> bool:
        """Whether a position lies inside a range of several groups."""
        i = self._at(position)
        return i < len(self.ranges) and self.ends[i] < position and self.ranges[i].groups > 1

    def _down(self, position: int, fluid: bool) -> int:
        return position if fluid and self._splits(position) else self.ends[self._at(position)]

    def _greedy(self, capacity: int, fluid: bool) -> list[int]:
        """Cuts of a greedy pass; ``fluid``: ranges of several groups may be cut anywhere."""
        cuts = [0]
        for _ in range(self.shards):
            cuts.append(max(cuts[-1], self._down(min(cuts[-1] + capacity, self.ends[-1]), fluid)))
        return cuts

    def _smallest(self, low: int, high: int, fluid: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self._greedy(middle, fluid)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def _refine(self, picked: set[int]) -> None:
        """Look closer at the picked ranges; neighbours are read as one key range."""
        picked = {i for i in picked if i < len(self.ranges) and self.ranges[i].groups > 1}
        if not picked:
            return
        # The coarsest first, so that no range becomes coarser again.
        coarsest = max(self.ranges[i].bits for i in picked)
        picked = {i for i in picked if self.ranges[i].bits == coarsest}
        bits = max(0, coarsest - max(1, HISTOGRAM_BITS - len(picked).bit_length()))
        spans: list[list[int]] = []
        for i in sorted(picked):
            low = self.ranges[i].low
            high = low + (1 << self.ranges[i].bits) - 1
            if spans and spans[-1][1] + 1 == low:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        self.coarse = coarsest
        where = self._where(spans)
        kept = [r for i, r in enumerate(self.ranges) if i not in picked]
        self.ranges = sorted(kept + self._histogram(where, bits), key=lambda r: r.low)
        self._index()

    def capacity(self) -> int:
        """The smallest capacity that the shards can do with, exactly.

        With cuts anywhere in a range it is too low, with none inside a range too
        high. The true cuts lie between those of the two; only ranges there are
        refined, until both agree.
        """
        total = self.ends[-1]
        low, high = max(self.largest, -(-total // self.shards)), total
        while True:
            low = self._smallest(low, high, fluid=True)
            high = self._smallest(low, high, fluid=False)
            if low >= high:
                return high
            near, far = self._greedy(low, fluid=False), self._greedy(high, fluid=True)
            self._refine({i for a, b in zip(near, far) for i in range(self._at(a), self._at(b) + 1)})

    def keys(self) -> list[int]:
        """First keys of the shards after the first (fewer if groups run out).

        Each shard is closed at the last group that fits an even part of what is
        left, but not before what is left then fits the smallest capacity. So no
        shard is over it, and one group above all others leaves none empty.
        """
        if not self.ranges:
            return []
        capacity = self.capacity()
        while True:
            split: set[int] = set()

            def boundary(position: int, up: bool) -> int:
                if self._splits(position):
                    split.add(self._at(position))
                i = bisect_left(self.ends, position) if up else self._at(position)
                return self.ends[i]

            total = self.ends[-1]
            least = [total]
            for _ in range(self.shards - 1):
                least.append(boundary(max(0, least[-1] - capacity), up=True))
            cuts, at = [], 0
            for left in range(self.shards, 1, -1):
                even = boundary(at + (total - at) // left, up=False)
                if even <= at:  # the next group alone is larger
                    i = self._at(at)
                    if i < len(self.ranges):
                        split |= {i} if self.ranges[i].groups > 1 else set()
                        even = self.ends[i + 1]
                at = max(even, least[left - 1])
                cuts.append(at)
            if not split:
                inside = [c for c in cuts if c < total]
                return [self.ranges[self._at(c)].low for c in inside]
            self._refine(split)


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows with size, text_crc32, shard and slot; equal texts share a shard.

    ``size`` is the UTF-8 bytes of the text plus 1. A null text has none: size 1,
    checksum 0, and it goes with the empty texts. ``slot`` numbers the rows of a
    shard from 0 without gaps. Repeated rows are all kept; an empty table gives an
    empty result; shards stay empty where there are fewer groups. Other columns
    are not read. Equal texts are those of an equal 64-bit hash.

    The driver sees histograms of the group sizes, at most 2**17 rows each, whatever
    the number of documents. Groups are summed before they are shuffled. Slots are
    numbered in cells of rows that are dealt by a hash of the row, so neither a
    shard nor a group of copies is sorted in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    first_keys = Cuts(groups, shards).keys()
    shard = F.lit(0)
    for key in first_keys:
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    cell = F.pmod(F.xxhash64("id", "key"), F.lit(CELLS)).cast("int")
    rows = rows.withColumns({"shard": shard.cast("int"), "cell": cell})
    sizes = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most shards * CELLS rows.
    offsets = sizes.select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "cell").orderBy("key", "id", "size")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("offset") + F.col("inside")).alias("slot"),
    )
