"""Trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; conversations that begin with it are its
members. Sums over subtrees come from the forest of edges to parents. It is split at
centroids into components, and each component again, until nothing is left. The total
of a centroid's subtree inside its component is added to the centroid and to the nodes
on the path from it to the component's top.

The first splits are made by Spark, many centroids at once: nodes at which the weight
below passes a multiple of ``WIDTH`` are cut out, which leaves components of at most
that weight. A node weighs as much as it has members, so the weight below it is the
number of turns there, known from the grouping of turns into nodes. Cut nodes are a
forest of their own, at most three for each ``WIDTH`` turns; it is split in the same
way, with the next power of ``WIDTH``. Components are small then, and tasks split them
further, one centroid at a time, down to single nodes.

Long conversations are worked on in slices. What a slice hands on to the next is
gathered per slice first, so no conversation lies in one task as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrybook.llm.common import write_stage

#: Most weight of a component that a task splits further.
WIDTH = 4096
#: Turns of a conversation that are worked on together.
SLICE = 1024
#: Turns that a rebuilt conversation may take from its base, and bases' distance.
HEADS, GROUP = 5, 100
#: Conversation ids that are written as one piece of text.
ENDS = 4096
KEY = ["k1", "k2"]


def ordered_turns(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id``, ``place`` (from 1 by turn), ``a`` and ``b`` (hashes of role and text), ``chars``.

    A null turn comes first; rows of the same turn are ordered by their hashes. A null
    role or text counts as empty. Rows without a conversation id belong to none and are
    left out. Rows are dealt by ranges of (conversation, turn, hashes), equal rows too,
    and numbered in each range; ranges of the same conversation then add up.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("tie"),
    ).filter("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    dealt = rows.repartitionByRange(F.col("conv_id"), *order, F.col("tie"))
    dealt = write_stage(dealt.drop("tie").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    numbered = dealt.withColumn("place", F.row_number().over(inside).cast("long"))
    parts = Window.partitionBy("conv_id").orderBy("part")
    offsets = (
        dealt.groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("offset is not null")
        .select("conv_id", "part", "offset")
    )
    # A range has at most one conversation that began in an earlier one, so this has no
    # more rows than there are ranges.
    return numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("place"), "a", "b", "chars"
    )


def _with_roots(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    root = [F.lit(0).cast("long").alias(c) for c in ("place", "a", "b", "chars")]
    return lengths.select("conv_id", "length", *root).unionByName(turns)


def plain_steps(turns: DataFrame) -> DataFrame:
    """The steps of conversations as they are: their turns, and place 0 for the root."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    return _with_roots(lengths, turns.join(lengths, "conv_id"))


def rebuilt_steps(turns: DataFrame) -> DataFrame:
    """Steps of rebuilt conversations.

    Conversation c gets the first h turns of its base c - c % 100 (all if it has fewer,
    none if there is no such conversation), then its own turns after its first h, where
    h is the CRC-32 of the decimal c, modulo 6. It may end up without turns.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = (
        turns.filter((F.col("place") <= HEADS) & (F.col("conv_id") == base))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "chars"))).alias("head"))
    )
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({"h": taken, "base": base})
    head = F.coalesce("head", F.array().cast("array<struct<place:bigint,a:bigint,b:bigint,chars:bigint>>"))
    lengths = lengths.join(heads, "base", "left").select(
        "conv_id", "h", "n", F.slice(head, F.lit(1), F.col("h").cast("int")).alias("head")
    )
    lengths = lengths.withColumn("got", F.size("head").cast("long")).withColumn(
        "length", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    )
    first = lengths.select("conv_id", "length", F.inline("head"))
    own = turns.join(lengths.select("conv_id", "length", "h", "got"), "conv_id").filter("place > h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("got")).drop("h", "got")
    return _with_roots(lengths, first.unionByName(own))


def _scan(steps: DataFrame, names: dict[str, Column], kind: str, upto: int = 0) -> DataFrame:
    """Adds running values along each conversation: ``kind`` xor, or the last that is not null.

    ``upto`` 0 takes in the row itself, -1 only earlier ones. Slices are worked on alone;
    what all earlier slices of a conversation hand on comes by a join, for those
    conversations that have more than one.
    """
    xor = kind == "xor"
    inside = Window.partitionBy("conv_id", "slice").orderBy("place")
    inside = inside.rowsBetween(Window.unboundedPreceding, upto)
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def along(column: Column, window) -> Column:
        return (F.bit_xor(column) if xor else F.last(column, ignorenulls=True)).over(window)

    def of_slice(column: Column) -> Column:
        return F.bit_xor(column) if xor else F.max_by(column, F.when(column.isNotNull(), F.col("place")))

    steps = steps.withColumns(names)
    carried = (
        steps.filter(F.col("length") >= SLICE)
        .groupBy("conv_id", "slice")
        .agg(*(of_slice(F.col(n)).alias(n) for n in names))
        .select("conv_id", "slice", *(along(F.col(n), earlier).alias(f"_{n}") for n in names))
        .filter("slice > 0")
    )

    def both(name: str) -> Column:
        here, before = along(F.col(name), inside), F.col(f"_{name}")
        if xor:
            return F.coalesce(here, F.lit(0)).bitwiseXOR(F.coalesce(before, F.lit(0)))
        return F.coalesce(here, before)

    steps = steps.join(carried, ["conv_id", "slice"], "left")
    return steps.withColumns({n: both(n) for n in names}).drop(*(f"_{n}" for n in names))


def _paths(steps: DataFrame) -> DataFrame:
    """Steps with the key of the node that they lead to, and of its parent.

    The key of a sequence is the exclusive or of two 64-bit hashes of (place, turn).
    """
    steps = steps.withColumn("slice", F.floor(F.col("place") / SLICE).cast("long"))
    own = {n: F.when(F.col("place") > 0, F.xxhash64("place", F.lit(n), h)).otherwise(F.lit(0)) for n, h in zip("xy", "ab")}
    steps = steps.withColumns(own).drop("a", "b")
    steps = _scan(steps, {"k1": F.col("x"), "k2": F.col("y")}, "xor")
    parent = {"p1": F.col("k1").bitwiseXOR(F.col("x")), "p2": F.col("k2").bitwiseXOR(F.col("y"))}
    return steps.withColumns(parent).drop("x", "y")


def _nodes(paths: DataFrame, width: int) -> tuple[DataFrame, int]:
    """One row per node, and the number of levels at which nodes are cut out.

    A node is cut at level k if the weight below it passes a multiple of width**k that
    that below its heaviest child does not reach. A node cut at a level is also cut at
    those below, as a multiple of width**k is one of the smaller powers too.
    """
    nodes = paths.groupBy(*KEY).agg(
        F.min("place").alias("place"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("place") + 1).alias("weight"),
        F.max("chars").alias("chars"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = write_stage(nodes)
    children = (
        nodes.filter("place > 0")
        .groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.max("weight").alias("heavy"))
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.agg(F.max("weight")).first()[0] or 0
    levels = 0
    while width ** (levels + 1) <= whole:
        levels += 1
    powers = [F.lit(width**k).cast("long") for k in range(1, levels + 1)]
    heavy = F.coalesce("heavy", F.lit(0))
    passes = ((F.col("weight") - F.col("weight") % p) > (heavy - heavy % p) for p in powers)
    level = sum((p.cast("int") for p in passes), F.lit(0))
    nodes = nodes.join(children, KEY, "left").withColumn("level", level).na.fill(0, ["n_children"])
    nodes = nodes.join(parents, ["p1", "p2"], "left")
    root = F.col("place") == 0
    nodes = nodes.withColumn("parent_conv_id", F.when(~root, F.col("parent_conv_id")))
    return write_stage(nodes.drop("heavy", "weight", "p1", "p2")), levels


def _places(paths: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Where the nodes of level k and more lie in the forest of these nodes.

    Returns their key, level, ``par`` (the nearest node of the forest above), ``cut``
    (the nearest above that is cut at the next level) and, for nodes of level k itself,
    ``top``: the highest node of their component.
    """
    forest = paths.filter(F.col("level") >= k)
    key = F.struct(*KEY)
    forest = _scan(forest, {"par": key, "cut": F.when(F.col("level") > k, key)}, "last", upto=-1)
    begins = (F.col("level") == k) & F.col("par").eqNullSafe(F.col("cut"))
    forest = _scan(forest, {"top": F.when(begins, key)}, "last")
    owners = nodes.select("conv_id", "place")  # each node's smallest member tells
    return forest.join(owners, ["conv_id", "place"]).select(*KEY, "place", "level", "par", "cut", "top")


def centroid_sums(parents: list[int], own: list[tuple]) -> list[list[int]]:
    """Sums of ``own`` over the subtrees of a tree; parents come first, the top has -1."""
    kinds = range(len(own[0]))
    sums = [[0 for _ in kinds] for _ in own]
    size = [0] * len(own)
    piece = [0] * len(own)
    stack = [list(range(len(own)))]
    while stack:
        part = stack.pop()
        top = part[0]
        for v in part:
            size[v] = 1
        for v in reversed(part):
            if v != top:
                size[parents[v]] += size[v]
        centroid = next(v for v in reversed(part) if 2 * size[v] >= len(part))
        upper: list[int] = []
        pieces: list[list[int]] = []
        total = list(own[centroid])
        for v in part:
            piece[v] = -1  # not below the centroid
            if v == centroid:
                piece[v] = -2
                continue
            above = piece[parents[v]] if v != top else -1
            if above == -1:
                upper.append(v)
                continue
            if above == -2:
                above = len(pieces)
                pieces.append([])
            piece[v] = above
            pieces[above].append(v)
            for i in kinds:
                total[i] += own[v][i]
        v = centroid
        while True:  # from the centroid to the top
            for i in kinds:
                sums[v][i] += total[i]
            if v == top:
                break
            v = parents[v]
        stack.extend(pieces)
        if upper:
            stack.append(upper)
    return sums


def _component_sums(values: list[str]):
    names = [*KEY, *values]

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        data = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in rows.schema.names}
        change = np.flatnonzero((np.diff(data["t1"]) != 0) | (np.diff(data["t2"]) != 0)) + 1
        limits = np.concatenate(([0], change, [rows.num_rows]))
        out = [data[v].copy() for v in values]
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
            if b - a > 1:
                keys = list(zip(data["k1"][a:b].tolist(), data["k2"][a:b].tolist()))
                at = {key: i for i, key in enumerate(keys)}
                above = zip(data["p1"][a:b].tolist(), data["p2"][a:b].tolist())
                parents = [at[key] if i else -1 for i, key in enumerate(above)]
                sums = centroid_sums(parents, list(zip(*(data[v][a:b].tolist() for v in values))))
                for column, found in zip(out, zip(*sums)):
                    column[a:b] = found
        columns = [data["k1"], data["k2"], *out]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            t1, t2 = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("t1", "t2"))
            last = np.flatnonzero((t1 != t1[-1]) | (t2 != t2[-1]))
            begin = int(last[-1]) + 1 if len(last) else 0
            if begin:
                yield whole(rows.slice(0, begin))
            held = rows.slice(begin)  # its component may go on
        if held is not None:
            yield whole(held)

    return run


def _rollup(paths: DataFrame, nodes: DataFrame, own: DataFrame, values: list[str], k: int, levels: int) -> DataFrame:
    """Key and subtree sums of the nodes of level k and more; ``own`` has what they add.

    What hangs below cut nodes is known from the forest of these, and is added where
    they hang; the rest is summed inside components.
    """
    places = write_stage(_places(paths, nodes, k).join(own, KEY))
    here = places.filter(F.col("level") == k)
    totals = None
    if k < levels:
        cuts = places.filter(F.col("level") > k)
        below = (
            here.filter("cut is not null")
            .groupBy(F.col("cut.k1").alias("k1"), F.col("cut.k2").alias("k2"))
            .agg(*(F.sum(v).alias(f"_{v}") for v in values))
        )
        base = cuts.join(below, KEY, "left").select(
            *KEY, *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)
        )
        totals = write_stage(_rollup(paths, nodes, base, values, k + 1, levels))
        hanging = (
            cuts.select(*KEY, "par")
            .filter("par is not null")
            .join(totals, KEY)
            .groupBy(F.col("par.k1").alias("k1"), F.col("par.k2").alias("k2"))
            .agg(*(F.sum(v).alias(f"_{v}") for v in values))
        )
        here = here.join(hanging, KEY, "left").withColumns(
            {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
        )
    above = F.when(F.struct(*KEY) != F.col("top"), F.col("par"))
    components = here.select(
        F.col("top.k1").alias("t1"),
        F.col("top.k2").alias("t2"),
        "place",
        *KEY,
        F.coalesce(above["k1"], F.lit(0)).alias("p1"),
        F.coalesce(above["k2"], F.lit(0)).alias("p2"),
        *values,
    )
    schema = ", ".join(f"{n} long" for n in [*KEY, *values])
    components = components.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "place")
    sums = components.mapInArrow(_component_sums(values), schema)
    return sums if totals is None else sums.unionByName(totals)


def _ends(paths: DataFrame) -> DataFrame:
    """Key and SHA-256 of the ids of the conversations that end at a node.

    Ids become pieces of text in parallel, by ranges of ``ENDS`` ids. A digest is a
    chain over its pieces in order, so those of a node pass through one task, one after
    the other, and nothing is held there but the digest's state.
    """
    pieces = (
        paths.filter(F.col("place") == F.col("length"))
        .groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("piece"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, names=[*KEY, "ends_sha256"])

        for batch in batches:
            found = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (k1, k2):
                    if key is not None:
                        found.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield out(found)
        if key is not None:
            yield out([(*key, digest.hexdigest())])

    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return pieces.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(steps: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations given as steps: one row per node.

    ``steps`` come from ``plain_steps`` or ``rebuilt_steps``: each conversation has
    places 0 (the root) to its length. Returns conv_id (the smallest member), depth,
    parent_conv_id (that of the parent; null for the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    (n_convs - 1) times the code points of a node's last text) and ends_sha256 (of the
    decimal ids of the members that end here, ascending, with commas between). A node's
    last turn is that of conversation ``conv_id`` at place ``depth``.

    Equal conversations share all nodes; a conversation without turns is a member of
    the root only. An empty table has no node, not even a root. Sequences are compared
    by 128 bits of hashes.
    """
    paths = write_stage(_paths(steps))
    nodes, levels = _nodes(paths, width)
    own = nodes.select(
        *KEY,
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    cuts = nodes.filter("level > 0").select(*KEY, "level")
    marked = paths.select("conv_id", "place", "slice", "length", *KEY).join(cuts, KEY, "left")
    marked = write_stage(marked.na.fill(0, ["level"]))
    sums = _rollup(marked, nodes, own, ["n_leaves", "saved_tokens"], 0, levels)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(sums, KEY).join(_ends(paths), KEY, "left")
    return found.select(
        "conv_id",
        F.col("place").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
