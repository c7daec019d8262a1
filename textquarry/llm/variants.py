"""Spelling variants: words of a corpus one edit apart, and the form each belongs to.

Counting.  Runs of letters are cut out of the texts in numpy, counted by Arrow
within a slice, and summed by Spark.

Near words.  The vocabulary is sorted twice, by its words and by its words read
backwards: a pair one edit apart, of ``MIN_CHARS`` code points or more, shares its
first three or its last three.  Each list is cut into leaves, runs of words with one
common prefix, and a leaf is scanned once: the banded edit rows (diagonals -1, 0, 1)
of all later words are kept per depth, the next word takes over the rows of the
prefix it shares with the one before (their LCP), and once no row holds a value below
two, all words sharing that prefix are skipped.

Hot prefixes.  A prefix of more than ``leaf`` words is split by its next code point,
again and again, in both lists.  A pair is then in no leaf only where its first
difference lies above the leaves of both lists; such words, and no others, meet in an
equi-join on what is left of them without the code point at that place.  No group of
that join has more members than there are letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.plans.joins import cut_lineage, lookup_join, spread

MIN_CHARS = 6
MIN_COUNT = 5
FACTOR = 5
DROP_MODULUS = 199
LEAF = 500
TASK_WORDS = 20_000
SLICE = 4 << 20
SCALAR_BYTES = 64
SHARED = 3  # code points that a near pair shares at one end


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of ASCII and lower-casing by byte, and the table of crc32."""
    kept = kernels.process_store()
    if "variants" not in kept:
        byte = np.arange(256, dtype=np.uint8)
        upper = (byte >= 65) & (byte <= 90)
        lower = np.where(upper, byte + 32, byte).astype(np.uint8)
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
        kept["variants"] = (upper | ((byte >= 97) & (byte <= 122)), lower, crc)
    return kept["variants"]


def letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of UTF-8 bytes.

    In UTF-8 the second range is the byte C3 with any byte that follows it.
    """
    inside = np.zeros(len(data) + 2, dtype=bool)
    lead = data == 0xC3
    inside[1:-1] = _tables()[0][data] | lead
    inside[2:-1] |= lead[:-1]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of ``data[start:end]`` carried on from the crc32 ``before`` of each span."""
    table = _tables()[2]
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, size = starts[order], size[order]
    long = int(np.searchsorted(-size, -SCALAR_BYTES))
    for i in range(long):
        crc = zlib.crc32(data[at[i] : at[i] + size[i]], int(state[i]) ^ 0xFFFFFFFF)
        state[i] = crc ^ 0xFFFFFFFF
    for k in range(int(size[long]) if long < len(size) else 0):
        stop = int(np.searchsorted(-size, -k))  # spans of more than k bytes
        part = state[long:stop]
        state[long:stop] = table[(part ^ data[at[long:stop] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words_of(ids: list, blobs: list[bytes], min_chars: int, modulus: int | None):
    """Arrow array of the words of some texts, one entry an occurrence."""
    import pyarrow as pa

    data = _tables()[1][np.frombuffer(b"\n".join([*blobs, b""]), dtype=np.uint8)]
    starts, ends = letter_runs(data)
    leads = np.concatenate([[0], np.cumsum(data == 0xC3, dtype=np.int64)])
    chars = ends - starts - (leads[ends] - leads[starts])
    full = chars >= min_chars
    starts, ends, chars = starts[full], ends[full], chars[full]
    odd = []
    if modulus and len(starts):
        sizes = np.array([len(b) + 1 for b in blobs], dtype=np.int64)
        owner = np.searchsorted(np.cumsum(sizes), starts, "right")
        named = [b"" if i is None else b"%d" % i for i in ids]
        heads = np.array([zlib.crc32(n + b":") for n in named], dtype=np.uint32)
        crc = span_crcs(data, starts, ends, heads[owner])
        cut = crc % np.uint32(modulus) == 0
        for i in np.flatnonzero(cut):
            word = data[starts[i] : ends[i]].tobytes().decode()
            place = int(crc[i]) % len(word)
            if len(word) > min_chars:
                odd.append(word[:place] + word[place + 1 :])
        starts, ends = starts[~cut], ends[~cut]
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return pa.concat_arrays([words, pa.array(odd, pa.string())]) if odd else words


def _counts(min_chars: int, modulus: int | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches, 4 * kernels.BATCH_ROWS):
            ids, blobs = batch.column(0).to_pylist(), kernels.blobs_of(batch.column(1))
            for begin, part in kernels.slices(blobs, SLICE):
                found = _words_of(ids[begin : begin + len(part)], part, min_chars, modulus).value_counts()
                yield pa.RecordBatch.from_arrays(
                    [found.field("values"), found.field("counts")], names=["word", "n"]
                )

    return run


def word_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    drop_modulus: int | None = None,
) -> DataFrame:
    """(word, n) of the words of all texts: runs of Latin letters, A-Z lower-cased.

    With ``drop_modulus`` m, an occurrence whose crc32 of ``<id>:<word>`` m divides
    loses the code point at crc32 modulo its length (a corpus with planted slips).
    Words of fewer than ``min_chars`` code points or ``min_count`` occurrences are out.
    Null and empty texts and empty tables have no words; rows without an id count
    with an empty id, repeated rows once each, and texts are read to their end.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    found = rows.mapInArrow(_counts(min_chars, drop_modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def near_in_list(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs i < j of a sorted list of distinct words that are one edit apart.

    ``rows[d]`` holds, for the first d code points of the word at hand, the later
    words still within one edit and their three banded cells.
    """
    n = len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    top = len(codes) - 1

    def letters(of: np.ndarray, place: int) -> np.ndarray:
        got = codes[np.minimum(start[of] + place, top)]
        return np.where(place < size[of], got, 0)

    everyone = np.arange(n)
    two = np.full(n, 2, dtype=np.int8)
    rows = [(everyone, two, np.zeros(n, dtype=np.int8), np.ones(n, dtype=np.int8))]
    dead = n and max(int(size.max()), 1) + 1  # depth at which no row is left
    for i, word in enumerate(words):
        if i:
            shared, before = 0, words[i - 1]
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            if shared >= dead:
                continue  # the range below a prefix that nothing is near to
            dead = len(word) + 1
            del rows[shared + 1 :]
        for depth in range(len(rows) - 1, len(word)):
            of, low, mid, high = rows[depth]
            first = int(np.searchsorted(of, i, "right"))
            of, low, mid, high = of[first:], low[first:], mid[first:], high[first:]
            c = ord(word[depth])
            left = mid + 1
            if depth:
                left = np.minimum(left, low + (letters(of, depth - 1) != c))
            same = np.minimum(np.minimum(mid + (letters(of, depth) != c), high + 1), left + 1)
            right = np.minimum(high + (letters(of, depth + 1) != c), same + 1)
            near = np.minimum(np.minimum(left, same), right) <= 1
            if not near.any():
                dead = depth + 1
                break
            rows.append((of[near], left[near], same[near], right[near]))
        else:
            of, low, mid, high = rows[len(word)]
            first = int(np.searchsorted(of, i, "right"))
            off = size[of[first:]] - len(word)
            value = np.where(off == 0, mid[first:], np.where(off < 0, low[first:], high[first:]))
            for j in of[first:][(np.abs(off) <= 1) & (value == 1)]:
                yield i, int(j)


def _scan(batches: Iterator) -> Iterator:
    """Near pairs of the leaves of a sorted partition (list, leaf, spelt, n)."""
    import pyarrow as pa

    kernels.forget_vocabulary()

    def flush(key, words: list[str], counts: list[int]):
        if len(words) < 2:
            return []
        turn = -1 if key[0] else 1  # words of the second list are spelt backwards
        pairs = near_in_list(words)
        return [(words[i][::turn], counts[i], words[j][::turn], counts[j]) for i, j in pairs]

    def shaped(rows: list) -> pa.RecordBatch:
        parts = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names=["a", "a_n", "b", "b_n"]
        )

    key, words, counts, out = None, [], [], []
    for batch in batches:
        for side, leaf, spelt, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (side, leaf) != key:
                out += flush(key, words, counts)
                key, words, counts = (side, leaf), [], []
                if len(out) > 10_000:
                    yield shaped(out)
                    out = []
            words.append(spelt)
            counts.append(n)
    out += flush(key, words, counts)
    if out:
        yield shaped(out)


def _depths(words: DataFrame, leaf: int) -> DataFrame:
    """Words with, per list, the depth of their leaf: one below the last prefix too common.

    A word that itself is too common a prefix has the depth of its length plus one,
    and is in no leaf.
    """
    out = words
    for name, spelt in (("ahead", F.col("word")), ("back", F.reverse("word"))):
        prefixes = out.select(
            "word", spelt.alias("s"), F.explode(F.sequence(F.lit(SHARED), F.length("word"))).alias("d")
        ).select("word", "d", F.expr("left(s, d)").alias("prefix"))
        open_ones = cut_lineage(
            prefixes.groupBy("prefix").agg(F.count("*").alias("m")).where(F.col("m") > leaf).select("prefix"),
            "prefixes",
        )
        deep = lookup_join(prefixes, open_ones, ["prefix"], "left_semi")
        deep = deep.groupBy("word").agg((F.max("d") + 1).alias(name))
        out = lookup_join(out, deep, ["word"], "left", measure=False).withColumn(
            name, F.coalesce(name, F.lit(SHARED))
        )
    return out


def _without(word: str, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.expr(f"substring({word}, place + 2)"))


def _unlisted(words: DataFrame) -> DataFrame:
    """Near pairs whose first difference lies above the leaves of both lists."""
    size = F.length("word")
    whole = words.where(F.col("ahead") + F.col("back") > size).select(
        "word", "n", "ahead", "back", F.explode(F.sequence(F.lit(0), size)).alias("place")
    ).where(F.col("place") < F.col("ahead"))
    cut = whole.where((F.col("place") < size) & (size - 1 - F.col("place") < F.col("back")))
    cut = cut.select("place", _without("word", F.col("place")).alias("rest"), "word", "n")
    own = whole.where(size - F.col("place") < F.col("back")).select("place", F.col("word").alias("rest"), "word", "n")
    left = cut.select("place", "rest", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = cut.unionByName(own).select("place", "rest", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, ["place", "rest"]).where("a <> b")
    return met.select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, *, leaf: int = LEAF) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart.

    ``words`` has distinct ``word`` of six code points or more and ``n``; null and
    shorter words take no part, an empty table has no pairs.
    """
    words = words.select("word", "n").where(F.length("word") >= 2 * SHARED)
    placed = cut_lineage(_depths(cut_lineage(words, "words"), leaf), "placed")
    ahead = placed.where(F.col("ahead") <= F.length("word")).select(
        F.lit(False).alias("back"), F.expr("left(word, ahead)").alias("leaf"), F.col("word").alias("spelt"), "n"
    )
    back = placed.where(F.col("back") <= F.length("word")).select(
        F.lit(True).alias("back"), F.expr("left(reverse(word), back)").alias("leaf"),
        F.reverse("word").alias("spelt"), "n",
    )
    # So many tasks by words, not by bytes: a scan computes far longer than it reads.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // TASK_WORDS)
    listed = ahead.unionByName(back).repartition(tasks, "back", "leaf").sortWithinPartitions("back", "leaf", "spelt")
    pairs = listed.mapInArrow(_scan, "a string, a_n long, b string, b_n long")
    pairs = cut_lineage(pairs.unionByName(_unlisted(placed)), "pairs")
    turned = pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    forward = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    return forward.unionByName(turned).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer doubling.

    Along a chain n grows by ``FACTOR`` a step, so the rounds are few at any size.
    """
    links = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = lookup_join(links, onward, ["root"], "left")
        jumped = cut_lineage(
            moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
            "roots",
        )
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, *, factor: int = FACTOR, leaf: int = LEAF) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words(word, n)``.

    The form of a word is the near word of largest n (ties: first in code-point
    order) if that is at least ``factor`` times its own n, else null; the root is
    what following forms ends at, itself where there is none.  Words without near
    words have n_near 0.  An empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its variants")
    words = cut_lineage(words.select("word", "n"), "words")
    best = near_pairs(words, leaf=leaf).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    rated = words.join(best, "word", "left").withColumn(
        "is_form", F.coalesce(-F.col("best.m") >= factor * F.col("n"), F.lit(False))
    )
    rated = cut_lineage(
        rated.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is_form"), F.col("best.near")).alias("form"),
            F.when(F.col("is_form"), -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rated.where("form is not null"))
    out = rated.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """Word counts of a corpus (options as of ``word_counts``), grouped into variants."""
    return group_variants(word_counts(spread(docs), **options))
