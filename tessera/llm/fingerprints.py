"""Document fingerprints: bottom-k sketches of shingle hashes (operator 3).

DataFrame functions only. A text's words are its runs of characters other than
``\\x20 \\x09-\\x0D``, its shingles ``SHINGLE_WORDS`` consecutive words joined by a
space (fewer words: the whole sequence; none: no shingle). A shingle hashes to
the first ``DIGITS`` hex digits of its MD5; the sketch is the sorted array of the
``K`` smallest distinct hashes, the fingerprint their concatenation.

Sketches of parts merge into the sketch of the union (``merge``, ``merge_parts``).
From two sketches follow resemblance and containment, from one the number of
distinct shingles; all are exact while the sets have fewer than ``K`` elements.

Cost: one shuffle of the texts for ``with_next`` and none for the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

K = 128
SHINGLE_WORDS = 5
DIGITS = 12
SPACE = r"[\x20\x09-\x0D]+"
BUCKET_ROWS = 2000      # neighbouring documents sorted together
MOST_BUCKETS = 1 << 16  # bounds that the plan holds; beyond 130 million documents buckets grow instead


# ---------------------------------------------------------------- sketches

def shingle_hashes(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles, repeats included; null counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def of(w: Column) -> Column:
        digest = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)
        many = F.transform(F.sequence(F.lit(0), F.size(w) - shingle_words),
                           lambda i: digest(F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle_words)])))
        return (F.when(F.size(w) >= shingle_words, many).when(F.size(w) > 0, F.array(digest(F.array_join(w, " "))))
                .otherwise(F.array().cast("array<string>")))
    # a one-element array binds the words once
    return F.flatten(F.transform(F.array(words), of))


def sketch(text: Column, k: int = K, shingle_words: int = SHINGLE_WORDS) -> Column:
    return bottom(shingle_hashes(text, shingle_words), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes are made distinct before they meet, and only the ``k`` smallest of
    each task travel, so a key may have any number of parts. A key whose parts
    are all empty has an empty sketch.
    """
    h, rank = fresh(parts, "h"), fresh(parts, "rank")
    hashes = parts.select(*keys, F.explode_outer(sketch_col).alias(h)).groupBy(*keys, h).agg(F.lit(1).alias(rank))
    least = hashes.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(h).asc_nulls_last()))).where(F.col(rank) <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have (both empty: 1)."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    largest = F.conv(F.element_at(s, k), 16, 10).cast("double") + 1
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * (16.0 ** DIGITS / largest))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has (``a`` empty: 1)."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(common / distinct_shingles(a, k), F.lit(1.0)))


# ---------------------------------------------------------------- neighbours

def _search(bounds: list[int], key: Column) -> Column:
    """Number of ``bounds`` (descending) above ``key``, by way of every ``step``-th bound."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    above = lambda b: b > key
    coarse = F.size(F.filter(F.lit([*bounds[step - 1::step]]), above)) if len(bounds) >= step else F.lit(0)
    return coarse * step + F.size(F.filter(F.slice(F.lit([*bounds]), coarse * step + 1, step), above))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """``docs`` in buckets of neighbouring ids, plus the text of the next document in descending order.

    After the last document follows the first; null ids come last, rows of equal
    id in the order of a text hash. Ids are cut at approximate quantiles. Each
    bucket also gets a copy of the next bucket's first document, so that one
    window per bucket sees every successor. Returns the frame with the columns
    ``bucket``, ``copy`` and ``next_text`` (copies are still in it) and its window.
    """
    least = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    n = docs.count()
    parts = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    bounds = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("b")).first().b if parts > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    rows = docs.withColumn("bucket", _search(bounds, key)).withColumn("key", key)
    # a row for each bucket: len(bounds) + 1 at most
    firsts = rows.groupBy("bucket").agg(F.max("key").alias("first")).orderBy("bucket").collect()
    before = {r.bucket: firsts[i - 1].bucket for i, r in enumerate(firsts)}      # the first bucket follows the last
    table = docs.sparkSession.createDataFrame([(r.bucket, r.first, before[r.bucket]) for r in firsts], "bucket int, first long, goes_to int")
    dealt = rows.join(F.broadcast(table), "bucket")
    targets = F.when(F.col("key") == F.col("first"), F.array("bucket", "goes_to")).otherwise(F.array("bucket"))
    placed = (dealt.select(*docs.columns, "key", F.posexplode(targets).alias("copy", "bucket")))
    window = Window.partitionBy("bucket").orderBy("copy", F.col("key").desc(), F.xxhash64(text_col))
    return placed.withColumn("next_text", F.lead(text_col).over(window)), window


# ---------------------------------------------------------------- operator

def edited(text: Column, following: Column) -> Column:
    """The last third (floor) of the code points replaced by as many first ones of ``following``."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                          shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, distinct_shingles``.

    A null text is empty; two empty texts are alike (1), an empty and another not (0). Repeated rows follow
    each other; a single document is its own successor. An empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed, window = with_next(rows)
    made = placed.withColumn("sketch", sketch(F.col("text"), k, shingle_words)).withColumn("next_sketch", F.lead("sketch").over(window))
    made = made.where("copy = 0").withColumn("edit", edited(F.col("text"), F.col("next_text")))
    made = made.withColumn("edit_sketch", sketch(F.col("edit"), k, shingle_words))
    a, b, c = F.col("sketch"), F.col("edit_sketch"), F.col("next_sketch")
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), resemblance(a, b, k).alias("near_edited"),
                       resemblance(a, c, k).alias("near_next"), containment(a, b, k).alias("contained_edited"),
                       distinct_shingles(a, k).alias("distinct_shingles"))
