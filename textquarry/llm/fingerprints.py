"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Every shingle of five words is hashed once.  The top bits of a hash name its bin, and a
bin keeps its smallest hash: with one sentinel per bin among them, the hashes are
sorted, and the first one of every bin is its minimum (the sentinel, if it is empty).
Optimal densification fills an empty bin from the first occupied one of its own
pseudo-random sequence of bins, the same in all documents; a sequence is a permutation
of the bins, so it ends.  Of every bin the low-order bits are kept, packed as hex.
Two fingerprints agree in a bin at similarity J with probability J + (1 - J) / 2^bits;
``likeness`` takes that share of chance agreements off.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256  # a power of two; the top bits of a signed hash
BITS = 4  # one hex digit a bin
WIDTH = 5
FEW = 16  # occupied bins, below which working out is less than asking
BLOCK_BYTES = 64 << 20
MOST_BLOCKS = 1 << 16
GROUP = 256

_SHIFT = 64 - (BINS.bit_length() - 1)
_EMPTY = (1 << _SHIFT) - 1  # what follows the bin in a sentinel


def _constant(values: Iterable, kind: str) -> Column:
    """An array of numbers, however many, as one constant."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def _hashes(width: int) -> Column:
    """Hashes of the shingles of the word hashes ``_h``; a shorter text is one shingle."""
    words = ", ".join(f"_h[i + {k}]" for k in range(width))
    return F.expr(
        f"case when size(_h) >= {width} then transform(sequence(0, size(_h) - {width}), i -> xxhash64({words})) "
        "when size(_h) > 0 then array(xxhash64(_h)) else array() end"
    ).cast("array<bigint>")


def _mixed(x: int) -> int:
    """64 well spread bits of a number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return x


def _digits() -> Column:
    """One digit a bin, in the order of bins: of its own hash, else of the bin that fills it.

    ``_bins`` has the low-order bits of each bin, null for an empty one, ``_own`` bin
    and digit of the occupied ones in one number.  The t-th bin that an empty bin i asks,
    t from 1, is ``first[i] + t * step[i]``, with odd steps, so that each asks every bin.
    Where many bins are occupied, those still empty go on asking; where few are, each
    empty bin works out which of them it would ask first.
    """
    seeds = [_mixed((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(BINS)]
    firsts, steps = [x % BINS for x in seeds], [x >> 32 & (BINS - 1) | 1 for x in seeds]
    table = lambda values: f"cast(split('{','.join(map(str, values))}', ',') as array<int>)"
    first, step = table(firsts), table(steps)
    asked = f"get(_bins, (get({first}, i) + t * get({step}, i)) & {BINS - 1})"
    # Filled ones as bin and digit in one number, the others below zero.
    asking = f"transform(s.rest, i -> coalesce(i * {1 << BITS} + {asked}, -1 - i))"
    empty = "filter(transform(_bins, (x, i) -> if(x is null, i, -1)), i -> i >= 0)"
    by_turns = (
        f"aggregate(sequence(1, {BINS}), struct(cast(array() as array<int>) as found, {empty} as rest), "
        f"(s, t) -> if(size(s.rest) = 0, s, transform(array({asking}), h -> struct("
        "concat(s.found, filter(h, x -> x >= 0)) as found, "
        "transform(filter(h, x -> x < 0), x -> -1 - x) as rest))[0]), s -> s.found)"
    )
    inverse = table(pow(x, -1, BINS) for x in steps)
    turn = f"(((c >> {BITS}) - get({first}, i)) * get({inverse}, i) - 1) & {BINS - 1}"
    soonest = f"array_min(transform(_own, c -> ({turn}) * {1 << BITS} + (c & {(1 << BITS) - 1})))"
    by_distance = f"transform({empty}, i -> i * {1 << BITS} + ({soonest} & {(1 << BITS) - 1}))"
    filled = F.expr(f"if(size(_own) < {FEW}, {by_distance}, {by_turns})")
    return F.sort_array(F.concat("_own", filled))


def with_fingerprint(rows: DataFrame, text: str, name: str, *, width: int = WIDTH) -> DataFrame:
    """Add the fingerprint of a text column: one hex digit for each of 256 bins.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, lower-cased.  A text without words,
    null and empty ones included, has the fingerprint ``''``.
    """
    keep = rows.columns
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+")
    sentinels = _constant(((b << _SHIFT) | _EMPTY for b in range(-(BINS // 2), BINS // 2)), "bigint")
    bin_of = f"shiftright({{}}, {_SHIFT})"
    bins = (
        f"transform(filter(_sorted, (x, i) -> i = 0 or {bin_of.format('x')} <> {bin_of.format('_sorted[i - 1]')}), "
        f"x -> if(x & {_EMPTY}L = {_EMPTY}L, null, cast(x & {(1 << BITS) - 1} as int)))"
    )
    hashed = rows.select(*keep, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_h"))
    shingled = hashed.select(*keep, _hashes(width).alias("_s"))
    ordered = shingled.select(
        *keep, (F.size("_s") > 0).alias("_some"), F.sort_array(F.concat("_s", sentinels)).alias("_sorted")
    )
    binned = ordered.select(*keep, "_some", F.expr(bins).alias("_bins"))
    own = F.expr(f"filter(transform(_bins, (x, i) -> i * {1 << BITS} + x), x -> x is not null)")
    owned = binned.select(*keep, "_some", "_bins", own.alias("_own"))
    filled = owned.select(*keep, F.when(F.col("_some"), _digits()).alias("_digits"))
    digits = F.transform("_digits", lambda x: F.hex(x.bitwiseAND((1 << BITS) - 1)))
    return filled.select(*keep, F.coalesce(F.lower(F.array_join(digits, "")), F.lit("")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (0 to 1) of the shingle sets behind two fingerprints.

    Equal fingerprints have 1, also two of texts without words; one of those with
    any other has 0.
    """
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    share = F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(BINS)
    chance = 1.0 / (1 << BITS)
    corrected = (share - chance) / (1 - chance)
    found = F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(corrected, F.lit(0.0)))
    return F.when(a == b, 1.0).otherwise(found)


def _block(bounds: list[int]) -> Column:
    """How many of the sorted bounds an ``_id`` has reached, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    reached = lambda some: F.size(F.filter(some, lambda b: b <= F.col("_id")))
    before = (reached(_constant(bounds[::GROUP], "bigint")) - 1) * GROUP
    group = F.slice(_constant(bounds, "bigint"), before + 1, F.lit(GROUP))
    return F.when(before < 0, 0).otherwise(before + reached(group))


def _bounds(rows: DataFrame) -> list[int]:
    """Ids that cut the rows into blocks of about equal numbers of rows."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES)
    parts = min(parts, MOST_BLOCKS)
    shares = _constant((k / parts for k in range(1, parts)), "double")
    found = rows.agg(F.percentile_approx("_id", shares, F.lit(max(10_000, 10 * parts)))).first()[0]
    return sorted(set(found or []))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows ``_id, _text, _print`` with the text and fingerprint of the next row by id.

    After the last row comes the first.  Rows are cut into blocks by ranges of ids.
    The first row of every block also goes to the block before as its last, so that a
    window in each block sees all neighbours, and texts are dealt once.
    """
    plain = rows.select("_id", "_text").withColumn("_block", _block(_bounds(rows)))
    heads = plain.groupBy("_block").agg(F.min(F.struct("_id")).alias("_head"))
    in_order = Window.orderBy("_block")  # one narrow row a block
    last = F.max("_block").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(
        F.col("_head._id").alias("_first"), F.coalesce(F.lag("_block").over(in_order), last).alias("_to")
    )
    extra = plain.drop("_block").join(F.broadcast(heads), F.col("_id").eqNullSafe(F.col("_first")))
    extra = extra.select("_id", "_text", F.col("_to").alias("_block"), F.lit(True).alias("_extra"))
    everything = plain.withColumn("_extra", F.lit(False)).unionByName(extra)
    printed = with_fingerprint(everything, "_text", "_print")
    order = Window.partitionBy("_block").orderBy("_extra", "_id", "_text")
    return printed.select(
        "_id", "_text", "_print", "_extra", F.lead("_text").over(order).alias("_next_text"),
        F.lead("_print").over(order).alias("_next_print"),
    ).where("not _extra")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    (id, text, n_chars, fingerprint, edited, edited_fingerprint, near_edited,
    near_next).  A text is edited by putting, for the last half of its code points
    (rounded down), as many from the head of the next document by id, or all it has;
    after the last document comes the first.

    Null texts count as empty ones; texts of any length are taken whole.  Rows
    without an id come first; rows that share an id are documents of their own, in
    the order of their texts.  A single row is its own next one; an empty table gives
    an empty result.  Columns besides id and text are not read.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")
    )
    size = F.char_length("_text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), size - half), F.substring("_next_text", F.lit(1), half))
    found = with_next(rows).select("_id", "_text", "_print", "_next_print", edited.alias("_edited"))
    found = with_fingerprint(found, "_edited", "_edited_print")
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_text").alias("text"),
        size.cast("long").alias("n_chars"),
        F.col("_print").alias("fingerprint"),
        F.col("_edited").alias("edited"),
        F.col("_edited_print").alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
