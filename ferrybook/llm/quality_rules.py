"""Document quality: counting rules and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets
are compared: that of trusted documents and that of the whole corpus. The mean log
ratio over a document's n-grams says how much more it is like the trusted ones;
below a fixed threshold a document is not kept.

A text is cut into passages of some words, at places that depend on the words alone.
Each distinct passage counts once, however many documents have it, so copies of a text
do not make it look common; of near copies only passages that differ count anew. Those of
near copies of trusted documents (most characters in trusted passages) count on the
trusted side too, so that a family of them does not outweigh the text it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrybook.llm.common import words

SYMBOL = "[#*$%&|<>]"
#: What a line with a word has.
NOT_SPACE = r"[^\x20\x09-\x0D]"
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: At most so many trusted documents teach the target multinomial: those with the
#: smallest hashes of their ids. The corpus multinomial is over all documents.
TRUSTED_ROWS = 20_000
#: A passage ends at white space after one of these letters, or at the end of a line.
PASSAGE_END = r"(?<=[dl048йхν])[\x20\x09-\x0D]+|\n"
#: Bits of the filter that holds the hashes of trusted passages.
FILTER_BITS = 1 << 21
#: A text is a near copy of trusted ones with this share of its characters in passages
#: that the filter holds, beyond the share that it seems to hold by chance.
NEAR_COPY = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Mean log ratio per n-gram under which a document is not kept. README has the scores of
#: labelled documents that were not used for learning.
THRESHOLD = -0.12


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns of a document), counts, and a 64-bit hash of each word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Patterns, as translate looks up each character of a text in a table of strings.
    df = docs.select(
        F.struct("*").alias("row"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
        words(text).alias("words"),
    )
    df = df.select(
        "row",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "lines",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    df = df.select(
        "row",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("hashes").cast("long").alias("n_words"),
        "hashes",
        _windows().alias("windows"),
    )
    # Windows with their places, sorted, only where some window occurs twice.
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.when(
        twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    df = df.withColumn("placed", placed).drop("windows")

    def repeated(x, i):
        left, right = F.get("placed", i - 1)["h"], F.get("placed", i + 1)["h"]
        same = x["h"].eqNullSafe(left) | x["h"].eqNullSafe(right)
        return F.when(same, x["i"])

    starts = F.sort_array(F.array_compact(F.transform("placed", repeated)))
    df = df.withColumn("starts", starts).drop("placed")
    # A start covers three words, or those up to the next start.
    covered = F.transform(
        "starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - s, F.lit(3)))
    )
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0))
    return df.withColumn("n_repeat_words", total.cast("long")).drop("starts")


def _windows():
    """Hashes of all runs of three words."""
    heads = F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0)))
    return F.transform(
        heads, lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))
    )


def _features():
    """Hashes of all words and word pairs, from the column ``hashes``."""
    heads = F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0)))
    pairs = F.transform(heads, lambda h, i: F.xxhash64(h, F.get("hashes", i + 1)))
    return F.concat("hashes", pairs)


def _bucket(feature: Column) -> Column:
    return feature.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _with_near_copy(texts: DataFrame, trusted_passages: DataFrame) -> DataFrame:
    """``texts``, each cut into the array ``passages``, with ``near``: is it a near copy?

    The filter has ``FILTER_BITS`` bits whatever the corpus. The fuller it is, the more of
    a text must be in it. It is the result of a subquery: as a literal it would be printed
    into every plan description that the driver keeps and logs. It is used once, and all
    else here are columns of ``texts``, so no row carries it.
    """
    slot = F.xxhash64("passage").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (
        trusted_passages.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .collect()
    )
    longs = [0] * (FILTER_BITS // 64)
    for at, bits in rows:
        longs[at] = bits
    full = sum((x & (2**64 - 1)).bit_count() for x in longs) / FILTER_BITS
    bits = texts.sparkSession.createDataFrame([(longs,)], "bits array<long>").scalar()

    def held(passage):
        own = F.xxhash64(passage).bitwiseAND(F.lit(FILTER_BITS - 1))
        word = F.get("filter", F.shiftright(own, 6).cast("int"))
        return F.getbit(word, own.bitwiseAND(F.lit(63)).cast("int")) == 1

    characters = lambda passages: F.length(F.array_join(passages, ""))
    least = NEAR_COPY + (1 - NEAR_COPY) * full
    near = characters(F.filter("passages", held)) >= F.lit(least) * characters(F.col("passages"))
    return texts.select("*", bits.alias("filter")).select(*texts.columns, near.alias("near"))


def bucket_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """Log ratio of trusted to corpus probability per bucket: ``bucket``, ``ratio``.

    Words and word pairs of all distinct passages of all documents are counted; a
    passage is trusted if any trusted document or near copy of trusted ones has it.
    ``trusted`` has the ids of trusted documents in ``id_col``. At most ``trusted_rows``
    of them are used, so that list can be broadcast. Without any trusted document all
    ratios are 0.
    """
    chosen = (
        trusted.select(F.col(id_col).alias("id"))
        .filter("id is not null")
        .distinct()
        .orderBy(F.xxhash64("id"), "id")
        .limit(trusted_rows)
        .withColumn("is_trusted", F.lit(1))
    )
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.split(F.coalesce(text_col, F.lit("")), PASSAGE_END).alias("passages"),
    ).join(F.broadcast(chosen), "id", "left")
    # explode_outer, as for explode Spark adds a filter that makes all arrays once more.
    learned = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "id")
        .select(F.explode_outer(F.split("text", PASSAGE_END)).alias("passage"))
    )
    passages = (
        _with_near_copy(cut.select("is_trusted", "passages"), learned.filter("passage != ''"))
        .select((F.col("is_trusted").isNotNull() | F.col("near")).cast("int").alias("t"), "passages")
        .select("t", F.explode_outer("passages").alias("passage"))
        .filter("passage != ''")
        .groupBy("passage")
        .agg(F.max("t").alias("t"))
    )
    hashes = F.transform(words(F.col("passage")), lambda w: F.xxhash64(w))
    counts = (
        passages.select("t", hashes.alias("hashes"))
        .select("t", F.explode_outer(_features()).alias("feature"))
        .groupBy(_bucket(F.col("feature")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    )
    all_buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = all_buckets.join(counts, "bucket", "left").na.fill(0, ["n", "t"])
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.sum("t").alias("t"))).scalar()

    def log_p(n: str):
        mass = F.lit(SMOOTHING * BUCKETS)
        return F.log((F.col(n) + F.lit(SMOOTHING)) / (whole[n] + mass))

    # Buckets without any count, such as those of pairs across passages, say nothing.
    known = (whole["t"] > 0) & (F.col("n") > 0)
    ratio = F.when(known, log_p("t") - log_p("n")).otherwise(F.lit(0.0))
    return counts.select("bucket", ratio.alias("ratio"))


def with_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """Every document as ``row``, a struct of its columns, with its counts and verdict.

    The table of ratios has exactly ``BUCKETS`` numbers whatever the corpus. It is put
    into the expression as a constant, so that documents are rated where they are
    read, without a shuffle.
    """
    ratios = sorted(bucket_ratios(docs, trusted, id_col, text_col, trusted_rows).collect())
    constant = ",".join(f"{ratio:.6f}" for _, ratio in ratios)
    by_bucket = F.split(F.lit(constant), ",").cast("array<double>")
    df = _counted(docs, text_col).withColumn("features", _features())
    total = F.aggregate(
        "features", F.lit(0.0), lambda sum_, feature: sum_ + F.get(by_bucket, _bucket(feature))
    )
    score = F.round(F.coalesce(total / F.nullif(F.size("features"), F.lit(0)), F.lit(0.0)), 9)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": base_failed, "score": score}).drop("features", "hashes")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def rate_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Counts, mean log ratio and verdict of every document.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score and kept. ``score`` is the mean log ratio of the document's
    words and word pairs; without words it is 0. ``options`` are those of
    ``with_quality``.

    A null or empty text has no words and fails the base rules. Repeated rows are all
    rated, each on its own. An empty table gives an empty result. Other columns are
    not read. Every count is over the whole text; arrays are per document.
    """
    text_col = options.get("text_col", "text")
    rated = with_quality(docs.select(id_col, text_col), trusted, id_col, **options)
    return rated.select(F.col("row")[id_col].alias(id_col), *COUNTS, "base_failed", "score", "kept")


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The kept rows with all their columns.

    A filter would be pushed below the steps that prepare the counts, and these be
    evaluated anew for each word; a generator that gives one row or none is not.
    """
    rated = with_quality(docs, trusted, id_col, **options)
    return rated.select(F.inline(F.when(F.col("kept"), F.array("row"))))
