"""Document fingerprints: every shingle hash below a fixed fraction, by built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Share of the shingle hashes that a sketch retains.
FRACTION = 1 / 8
#: Hexadecimal digits of a hash in a fingerprint.
DIGITS = 16

#: Rows of a stretch of neighbouring ids, on average; stretches at least per shuffle partition, and at most.
STRETCH_ROWS = 10_000
STRETCHES = 4
MOST_STRETCHES = 1 << 16
#: Stretch borders that are compared in one step of the search for a row's stretch.
_FAN = 256

_BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """MD5 of every run of ``size`` words, repeats included; fewer words are one shingle, none are none."""

    def hashes(words: Column) -> Column:
        last = F.greatest(F.size(words) - size, F.lit(0))
        each = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.md5(F.array_join(F.slice(words, i, size), " ")))
        return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<string>"))

    return _let(F.filter(F.split(text, _BLANKS), lambda w: w != ""), hashes)


def _retained(hashes: Column, fraction: float) -> Column:
    """Those below the fraction; where there is none, the smallest."""
    limit = f"{min(int(fraction * 16**8), 16**8 - 1):08x}"
    low = F.filter(hashes, lambda h: h < limit)
    return _let(low, lambda x: F.when(F.size(x) > 0, x).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(x))


def sketch(text: Column, size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes that are retained, as hexadecimal text.

    Hashes below ``fraction`` of their range are retained, so the sketch grows with the text and the
    sketch of a union is the union of the sketches. A text whose hashes are all above is stood for by
    its smallest hash. NULL counts as empty, and an empty sketch belongs to texts without words.
    """
    kept = _let(shingle_hashes(F.coalesce(text, F.lit("")), size), lambda hashes: _retained(hashes, fraction))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda h: F.substring(h, 1, DIGITS))))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together, from their sketches of this fraction."""
    return F.sort_array(_let(F.array_union(a, b), lambda both: _retained(both, fraction)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one has; 1 for two empty ones, 0 if only one is."""
    least = F.least(F.size(a), F.size(b))
    both_empty = F.greatest(F.size(a), F.size(b)) == 0
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(both_empty.cast("double"))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text; each ``DIGITS`` characters are a hash."""
    return F.array_join(sketch, "")


def _rank(id_: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are not above an id, in two steps; -1 for NULL."""
    if not borders:
        return F.when(id_.isNull(), -1).otherwise(0)
    parts = [borders[k : k + _FAN] for k in range(0, len(borders), _FAN)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= id_))
    literal = lambda values: F.array(*map(F.lit, values))
    if len(parts) == 1:
        return F.when(id_.isNull(), -1).otherwise(below(literal(borders)))
    part = below(literal([p[0] for p in parts]))
    inside = _let(part, lambda k: (k - 1) * _FAN + below(F.get(F.array(*map(literal, parts)), k - 1)))
    return F.when(id_.isNull(), -1).when(id_ < borders[0], 0).otherwise(inside)


def with_next_text(docs: DataFrame) -> DataFrame:
    """Each row of (id, text) with ``next_text``, that of the next smaller id, after the last the first.

    Rows are dealt out by stretches of neighbouring ids and the text moves once. The first row of a
    stretch goes to the stretch before as well, marked ``guest`` there, so that no row lacks its
    neighbour; guests are in the result, for a caller that wants to look at a neighbour once more.
    ``stretch`` and ``guest`` say where a row is, and rows are in order within ``in_order()``.
    """
    ids = docs.select("id")
    rows = ids.count()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_STRETCHES, max(rows // STRETCH_ROWS, STRETCHES * partitions))
    cuts = [k / n for k in range(1, n)]
    found = ids.agg(F.percentile_approx("id", cuts, max(10_000, 4 * n))).first()[0] or []
    rank = _rank(F.col("id"), sorted(set(found)))
    # One number for each stretch, at most MOST_STRETCHES.
    first = {r.rank: r.first for r in ids.groupBy(rank.alias("rank")).agg(F.max("id").alias("first")).collect()}
    order = sorted(first, reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    highest = max(first, default=-1)
    at = lambda values: F.array(*[F.lit(values.get(k)).cast("long") for k in range(-1, highest + 1)])
    place = F.struct(F.col("rank").cast("long").alias("stretch"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(at(before), F.col("rank") + 1).alias("stretch"), F.lit(True).alias("guest"))
    is_first = F.col("id").eqNullSafe(F.get(at(first), F.col("rank") + 1))
    dealt = docs.withColumn("rank", rank).select(
        "id", "text", F.explode(F.when(is_first, F.array(place, guest)).otherwise(F.array(place))).alias("at")
    )
    return dealt.select("id", "text", "at.*").withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    """Rows of a stretch by descending id, NULL last, then by text; guests behind them."""
    return Window.partitionBy("stretch").orderBy("guest", F.col("id").desc_nulls_last(), "text")


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    fraction: float = FRACTION,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited``, ``sketch``, ``edited_sketch``, ``near_edited``, ``near_next``.

    ``edited`` is the text with the last half of its code points (rounded down) replaced by as many
    of the beginning of the next document's, in descending order of ids and after the last the first.
    A sketch has the hashes of a text's word shingles that lie below ``fraction``; ``near_edited`` and
    ``near_next`` are the containment of the smaller sketch in the larger one, which stays meaningful
    for texts of very unequal length.

    A NULL text counts as empty; texts without words have an empty sketch, which is like another empty
    one (1) and unlike any other (0). Ids are whole numbers; rows without one come last, and rows with
    the same id follow each other by text, in one task. Repeated rows are documents of their own. A
    single document is its own next one. An empty table gives an empty result. Other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_chars, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", n_chars - half), F.left(F.coalesce("next_text", F.lit("")), half))
    sketched = with_next_text(rows).select(
        "id", "stretch", "guest", "text", n_chars.cast("long").alias("n_chars"), edited.alias("edited"),
        sketch(F.col("text"), shingle_words, fraction).alias("sketch"),
        F.when(~F.col("guest"), sketch(edited, shingle_words, fraction)).alias("edited_sketch"),
    )
    both = sketched.withColumn("next_sketch", F.lead("sketch").over(in_order())).where("NOT guest")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
