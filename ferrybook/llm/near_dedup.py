"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set are its distinct five-word shingles. Of each of ``BANDS * ROWS``
minima over the set, only the low ``BITS`` bits are kept, packed into eight longs.
Documents that agree on all minima of a band are candidates. The share of equal
b-bit values, counted on the packed longs and corrected for chance agreement,
estimates the similarity; what is clearly below the threshold goes no further. The
rest is confirmed on the whole sets, and confirmed links are joined to components.

In a family of texts that are alike but below the threshold (pages of one template)
all members share bands, and no estimate tells them apart. Large bands of that kind are
thinned by rare shingles first: two linked sets share one of their rarest shingles, at
places that the threshold bounds, so members that share none need not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrybook.llm.common import cut_lineage, quoted, write_stage
from ferrybook.llm.words import (
    as_long,
    chunks,
    mix,
    space_table,
    split_words,
    windows,
)

SHINGLE = 5
#: Two documents of similarity s share a band with probability 1 - (1 - s**5)**25:
#: all but 4 in 10 million at 0.85, all but 5 in 100,000 at 0.8.
BANDS, ROWS = 25, 5
BITS = 4
LONGS = 8
#: Candidates go on down to this many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Buckets of up to this many members are compared in full at once, larger ones with
#: their center.
SMALL_BUCKET = 8
#: Buckets beyond this many members are thinned by rare shingles before their members
#: are compared; in smaller ones a member meets so many others at most.
LARGE_BUCKET = 256
#: So many most similar partners of a document are confirmed first.
NEAREST = 2
#: Members of a bucket are compared in blocks of this weight on average; a member
#: weighs its number of shingles and ``MEMBER`` more.
BLOCK, MEMBER = 1 << 18, 512
#: Shingles whose owners are multiplied at a time.
COLUMNS = 2048


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[: BANDS * ROWS] | np.uint32(1), low[BANDS * ROWS :]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets of a batch: first row, all sets in one array, and where each starts.

    With fewer than five words the whole sequence is the one shingle; without words
    the set is empty.
    """
    separators = space_table()
    for chunk in chunks(texts):
        words = split_words(chunk, separators)
        hashes = windows(words.hashes, SHINGLE)
        sets = []
        for i in range(len(chunk)):
            begin, end = words.offsets[i], words.offsets[i + 1]
            if end - begin >= SHINGLE:
                sets.append(np.unique(hashes[begin : end - SHINGLE + 1]))
            elif end > begin:
                sets.append(windows(words.hashes[begin:end], int(end - begin)))
            else:
                sets.append(hashes[:0])
        offsets = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum([len(s) for s in sets], out=offsets[1:])
        yield chunk.first, np.concatenate(sets), offsets


def _signatures(members: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Fingerprint, packed signature and band keys of each (non-empty) set."""
    starts = offsets[:-1]
    n, size = len(starts), BANDS * ROWS
    small = (members >> np.uint64(32)).astype(np.uint32) ^ members.astype(np.uint32)
    minima = np.empty((size, n), dtype=np.uint32)
    for j, (times, plus) in enumerate(zip(*_multipliers())):
        np.minimum.reduceat(small * times + plus, starts, out=minima[j])
    packed = np.zeros((LONGS, n), dtype=np.uint64)
    per_long = 64 // BITS
    for j in range(size):
        low = minima[j].astype(np.uint64) & np.uint64((1 << BITS) - 1)
        packed[j // per_long] |= low << np.uint64(BITS * (j % per_long))
    keys = np.empty((n, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(n, band + 1, dtype=np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[j])
        keys[:, band] = key
    one = np.add.reduceat(mix(members ^ np.uint64(0x5851F42D4C957F2D)), starts)
    two = np.add.reduceat(mix(members ^ np.uint64(0x14057B7EF767814F)), starts)
    return {"one": one, "two": two, "packed": packed.T, "keys": keys}


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    flat = pa.array(as_long(np.ascontiguousarray(values)).ravel(), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), flat)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, members, offsets in shingle_sets(batch.column(1)):
            sizes = np.diff(offsets)
            filled = np.flatnonzero(sizes)
            found = _signatures(members, np.append(offsets[filled], len(members)))
            n = len(sizes)

            def spread(values: np.ndarray) -> np.ndarray:
                out = np.zeros((n, *values.shape[1:]), dtype=np.uint64)
                out[filled] = values
                return out

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    pa.array(sizes, pa.int64()),
                    pa.array(as_long(spread(found["one"])), pa.int64()),
                    pa.array(as_long(spread(found["two"])), pa.int64()),
                    _lists(spread(found["packed"])),
                    _lists(spread(found["keys"])),
                ],
                names=["id", "n_shingles", "one", "two", "signature", "bands"],
            )


def _mismatches(a: str, b: str) -> Column:
    """How many of the packed b-bit values differ."""
    total = F.lit(0)
    ones = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    for i in range(LONGS):
        differ = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = reduce(
            lambda x, y: x.bitwiseOR(y), [F.shiftrightunsigned(differ, s) for s in range(BITS)]
        )
        total = total + F.bit_count(any_bit.bitwiseAND(ones))
    return total


def estimated_similarity(a: str, b: str) -> Column:
    """Share of equal b-bit values, less the share that agrees by chance."""
    chance = 2.0**-BITS
    equal = 1 - _mismatches(a, b) / F.lit(float(BANDS * ROWS))
    return (equal - chance) / (1 - chance)


def _least_estimate(percent: int) -> float:
    """The estimate below which a pair cannot reach the threshold (but by chance)."""
    t = percent / 100
    return t - DEVIATIONS * (t * (1 - t) / (BANDS * ROWS)) ** 0.5 - 2.0**-BITS / 2


def _likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule out the threshold, with the estimate."""
    left = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    estimated = joined.select("a", "b", estimated_similarity("sa", "sb").alias("estimate"))
    return estimated.filter(F.col("estimate") >= _least_estimate(percent))


def _confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of which 100 * shared shingles >= percent * all shingles.

    Both texts of a pair meet by the pair, so a document in many pairs is spread
    over them. Texts are compared in the task that receives the pair.
    """
    ends = pairs.select(
        "a", "b", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in "ab")))
    )
    texts = ends.join(docs, "id").groupBy("a", "b").agg(
        *(F.max(F.when(F.col("side") == s, F.col("text"))).alias(f"text_{s}") for s in "ab")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            sides = (shingle_sets(batch.column(2)), shingle_sets(batch.column(3)))
            left, right = (
                [m[o[i] : o[i + 1]] for _, m, o in side for i in range(len(o) - 1)] for side in sides
            )
            for i, (x, y) in enumerate(zip(left, right)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                both = len(x) + len(y) - shared
                linked[i] = both > 0 and 100 * shared >= percent * both
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                pa.array(linked)
            )

    return texts.mapInArrow(run, pairs.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable for every id of the edges (a, b): ``id``, ``label``.

    Labels spread to neighbours as minima, which are combined before the shuffle, and
    then jump to the label of the label, so the rounds grow with the logarithm of the
    longest path. Each round is written to the checkpoint folder.
    """
    ends = [("a", "b"), ("b", "a")]
    both = cut_lineage(
        reduce(
            DataFrame.unionByName,
            [edges.select(F.col(x).alias("id"), F.col(y).alias("to")) for x, y in ends],
        ).distinct()
    )
    labels = both.groupBy("id").agg(F.min("to").alias("to")).select(
        "id", F.least("id", "to").alias("label")
    )
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "label"), "to").select("id", "label")
        own = labels.withColumn("old", F.col("label"))
        spread = (
            near.unionByName(own, allowMissingColumns=True)
            .groupBy("id")
            .agg(F.min("label").alias("step"), F.max("old").alias("old"))
        )
        jump = labels.select(F.col("id").alias("step"), F.col("label").alias("jump"))
        moved = cut_lineage(
            spread.join(jump, "step").select("id", "old", F.least("step", "jump").alias("label"))
        )
        labels = moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    kept = common[code]
    code, owner = (np.cumsum(common) - 1)[code[kept]], owner[kept]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for first in range(0, int(common.sum()), COLUMNS):
        low, high = np.searchsorted(code, (first, first + COLUMNS))
        dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        dense[owner[low:high], code[low:high] - first] = 1
        out += (dense @ dense.T).astype(np.int32)
    return out


def _compare_blocks(percent: int):
    """Pairs (a, b) of labels of which two texts of the group are linked."""

    def run(group: pa.Table) -> pa.Table:
        found = shingle_sets(group.column("text"))
        sets = [m[o[i] : o[i + 1]] for _, m, o in found for i in range(len(o) - 1)]
        labels = pa.concat_arrays(group.column("label").chunks).dictionary_encode()
        label = np.asarray(labels.indices, dtype=np.int64)
        size = np.array([len(x) for x in sets], dtype=np.int64)
        found = [np.zeros(0, dtype=np.int64)]
        for i, row in enumerate(_shared(sets)):  # row by row, to keep memory low
            shared = row.astype(np.int64)
            linked = (shared > 0) & (100 * shared >= percent * (size[i] + size - shared))
            found.append(label[i] * len(sets) + np.unique(label[linked & (label > label[i])]))
        pairs = np.unique(np.concatenate(found))
        ends = (pairs // len(sets), pairs % len(sets))
        return pa.table({s: labels.dictionary.take(pa.array(e)) for s, e in zip("ab", ends)})

    return run


def _rare_shingles(named: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each text in ``named`` that another text may share.

    Shingles are ordered by how many of the texts have them, then by hash. If two
    texts of ``n`` and ``m`` shingles are linked, and the first shingle in this order
    that both have is at place i of the one and j of the other (from 0), then at most
    the smaller of n - i and m - j are shared, and that must reach the threshold. So
    the first of them lies within the first hundredths of each set that the threshold
    leaves over, and nearer still to the start in the smaller set, which is marked
    ``early``. Only shingles that lie early in some text and are found in different
    components are returned: shingle, rep, label, n, place, early, owners.
    """
    kind = named.schema["rep"].dataType.simpleString()
    wanted = named.select("rep", "label").distinct()
    row = ["rep", "label", "version"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, members, offsets in shingle_sets(batch.column(3)):
                sizes = np.diff(offsets)
                owner = pa.array(first + np.repeat(np.arange(len(sizes)), sizes))
                columns = [batch.column(c).take(owner) for c in range(3)]
                columns += [pa.array(np.repeat(sizes, sizes), pa.int64())]
                columns += [pa.array(as_long(members), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*row, "n", "shingle"])

    found = texts.withColumnRenamed("id", "rep").join(wanted, "rep")
    found = found.withColumn("version", F.xxhash64("text")).select(*row, "text")
    items = found.mapInArrow(run, f"rep {kind}, label {kind}, version long, n long, shingle long")
    often = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")
    # Repeated rows of one document give each shingle again, hence the dense rank.
    order = Window.partitionBy("rep", "version").orderBy(F.coalesce("owners", F.lit(1)), "shingle")
    placed = items.join(often, "shingle", "left").withColumn("place", F.dense_rank().over(order) - 1)
    left = F.col("n") - F.col("place")
    placed = placed.filter("owners > 1").filter(100 * left >= percent * F.col("n"))
    placed = cut_lineage(
        placed.withColumn("early", (100 + percent) * left >= 2 * percent * F.col("n")).drop("owners")
    )
    live = (
        placed.groupBy("shingle")
        .agg(
            F.count(F.lit(1)).alias("owners"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.max("early").alias("some_early"),
        )
        .filter("low <> high and some_early")
        .select("shingle", "owners")
    )
    return cut_lineage(placed.join(live, "shingle"))


def _rare_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a shingle of few texts."""
    few = rare.filter(F.col("owners") <= SMALL_BUCKET).select("shingle", "rep", "label", "n", "place")
    other = few.select("shingle", *(F.col(c).alias(f"other_{c}") for c in few.columns[1:]))
    shared = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    met = few.join(other, "shingle").filter(
        (F.col("rep") < F.col("other_rep"))
        & (F.col("label") != F.col("other_label"))
        & ((100 + percent) * shared >= percent * (F.col("n") + F.col("other_n")))
    )
    return met.select(F.col("rep").alias("a"), F.col("other_rep").alias("b")).distinct()


def _links_across(
    members: DataFrame, labels: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int
) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    Members of large buckets meet by their rare shingles: in pairs where few texts
    have the shingle, which are confirmed at once. Those that have a rare shingle of
    more texts stay in their buckets; the others leave them, as no link is left that
    they could have. Small buckets are compared as they are.
    """
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.withColumn("label", F.coalesce("label", "rep"))
    open_keys = (
        named.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high")
        .select("key")
    )
    named = cut_lineage(named.join(open_keys, "key").select("key", "rep", "members", "label"))
    large = named.filter(F.col("members") > LARGE_BUCKET)
    small = named.filter(F.col("members") <= LARGE_BUCKET)
    if large.isEmpty():
        return _links_in_buckets(small, signatures, texts, percent)
    rare = _rare_shingles(large, texts, percent)
    likely = _likely(_rare_pairs(rare, percent), signatures.select("rep", "signature"), percent)
    confirmed = _confirm(likely.select("a", "b"), texts, percent)
    common = rare.filter(F.col("owners") > SMALL_BUCKET).select("rep").distinct()
    left = small.unionByName(large.join(common, "rep").select(*large.columns))
    return confirmed.unionByName(_links_in_buckets(left, signatures, texts, percent))


def _links_in_buckets(
    named: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int
) -> DataFrame:
    """Links (a, b) between the labels of different components within buckets.

    A member takes part if its estimate with some member of another component does
    not rule out a link. Those of a bucket are dealt into blocks by a hash; all texts
    of two blocks meet in one task, which compares their full sets and returns pairs
    of labels only. So no pair of texts is ever a row, and no task gets a whole
    bucket that is large.
    """
    named = cut_lineage(named.select("key", "rep", "label").join(signatures, "rep"))
    partners = named.select(
        *(F.col(c).alias(f"other_{c}") for c in ("key", "label", "n_shingles", "signature"))
    )
    least, most = (f("n_shingles", "other_n_shingles") for f in (F.least, F.greatest))
    active = named.join(
        partners,
        (F.col("key") == F.col("other_key"))
        & (F.col("label") != F.col("other_label"))
        & (100 * least >= percent * most)
        & (estimated_similarity("signature", "other_signature") >= _least_estimate(percent)),
        "left_semi",
    )
    active = cut_lineage(active.select("key", "rep", "label", "n_shingles"))
    weight = F.sum(F.col("n_shingles") + MEMBER)
    blocks = active.groupBy("key").agg(F.ceil(weight / BLOCK).cast("int").alias("blocks"))
    dealt = active.join(blocks, "key").select(
        "key",
        "label",
        F.col("rep").alias("id"),
        F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    dealt = dealt.select(
        "key", "label", "id", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    kind = active.schema["rep"].dataType.simpleString()
    return (
        dealt.join(texts, "id")
        .groupBy("key", "one", "two")
        .applyInArrow(_compare_blocks(percent), f"a {kind}, b {kind}")
    )


def _links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Component label of every representative that has a link: ``id``, ``label``.

    First the members of small buckets are compared with each other, and those of
    larger ones with the bucket's center, by their estimates; the most promising pairs
    of each document are confirmed. In a family of copies they join nearly all of it.
    After that only buckets with members in different components are looked at, but
    those in full. No pair of candidates is left out unless its two ends are already
    in one component.
    """
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    members = cut_lineage(banded.join(shared.filter("members > 1"), "key"))
    # Texts of documents in some bucket, so that the others are read once only.
    texts = write_stage(docs.join(members.select(F.col("rep").alias("id")).distinct(), "id"))

    small = members.filter(F.col("members") <= SMALL_BUCKET).select("key", "rep")
    others = small.withColumnRenamed("rep", "other")
    in_small = small.join(others, "key").filter("rep < other")
    # The center of a bucket is the member that shares most bands with others: in a
    # family of copies that is the text they come from, or the one nearest to it.
    degrees = members.groupBy("rep").agg(F.sum("members").alias("degree"))
    centers = (
        members.filter(F.col("members") > SMALL_BUCKET)
        .join(degrees, "rep")
        .groupBy("key")
        .agg(F.max(F.struct("degree", "rep")).alias("most"))
        .select("key", F.col("most.rep").alias("center"))
    )
    stars = members.join(centers, "key").filter("rep <> center")
    pairs = in_small.select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(
        stars.select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b"))
    )
    likely = _likely(pairs.distinct(), reps.select("rep", "signature"), percent)
    ends = likely.select(
        F.inline(F.array(*(F.struct(F.col(x).alias("end"), "a", "b", "estimate") for x in "ab")))
    )
    best = Window.partitionBy("end").orderBy(F.desc("estimate"), "a", "b")
    first = ends.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= NEAREST)
    edges = cut_lineage(_confirm(first.select("a", "b").distinct(), texts, percent))
    labels = components(edges)

    signatures = reps.select("rep", "n_shingles", "signature")
    found = cut_lineage(_links_across(members, labels, signatures, texts, percent))
    return labels if found.isEmpty() else components(edges.unionByName(found))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """Shingle count and component of every row: ``id_col``, n_shingles, component_id, kept.

    Documents are linked with 100 * shared >= ``percent`` * all of their shingles;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks it.
    Words are lower-cased (A-Z). With fewer than five words the whole sequence is the
    one shingle. A null or empty text, or one of white space, has none and is linked
    with nothing. Rows of one id are one document. A row without an id gets a null
    component and is not kept. Repeated rows are all returned; an empty table gives
    an empty result; other columns are not read.

    Documents with equal sets are one class, found by a 128-bit fingerprint; only one
    of each is compared. Words and shingles are told apart by 64-bit hashes. A link
    is missed only if no band agrees or the estimate is five deviations low.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    prepared = cut_lineage(
        docs.mapInArrow(
            _prepare,
            f"id {kind}, n_shingles long, one long, two long, signature array<long>, bands array<long>",
        )
    )
    same = ["n_shingles", "one", "two"]
    reps = (
        prepared.filter("n_shingles > 0 and id is not null")
        .groupBy(*same)
        .agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    )
    reps = cut_lineage(reps)
    labels = _links(docs.filter("id is not null"), reps, percent)
    classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, F.coalesce("label", "rep").alias("component")
    )
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), "id")
    return (
        prepared.select("id", *same)
        .join(classes, same, "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80
) -> DataFrame:
    """One document of each component, with all its columns.

    Rows without an id are kept. Of repeated rows of one id, one is kept.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    removed = found.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    kept = docs.join(removed, id_col, "left_anti").select(*map(quoted, docs.columns))
    ids = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count()
    if ids.filter("count > 1").isEmpty():
        return kept
    nameless = kept.filter(F.col(id_col).isNull())
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(nameless)
