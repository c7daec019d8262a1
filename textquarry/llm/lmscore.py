"""Document scores by masked pseudo-likelihood under a network trained on the corpus.

Every word is predicted from the words on both sides of it, itself masked; the
sum of the log-probabilities is the document's score.

Vocabulary.  Words of all documents are counted; the ``words`` most frequent
have ids of their own, all others share ``spare`` ids by hash.  The network gives
the probability of a shared id; a word's part of it is its exact share of the
counts behind that id, so every word has a probability of its own and those of
all words sum to one.  These shares come by a join on the word.

Network.  Each of the ``2 * reach`` context places has its own embedding table;
their sum goes through tanh to a hidden layer.  An id is two digits (high, low):
P(high | h) and P(low | h, high) are softmax layers, the second with a bias table
per high digit, so probabilities are proper and cost two short layers.  The
biases start at the corpus' own word frequencies.

Training.  Each round, every task takes one in ``every`` of the positions of its
documents, counted through the whole task, goes over them by Adagrad from the
common parameters, and passes on its own; the parameters of all tasks are
averaged, weighted by positions, in a tree of groups of bounded size.  A round
starts one position after the one before, so with as many rounds as ``every`` (as
by default) each position of the corpus is a target once; with fewer rounds the
others are never one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.plans.joins import cut_lineage

DIGIT = 64
FAN_IN = 16
BATCH = 2048
FIXED = float(1 << 32)
JOIN_WORDS = 500_000
CLIP = 40.0


@dataclass(frozen=True)
class Settings:
    """Sizes of the vocabulary and network, and how they are trained."""

    words: int = 4064
    spare: int = 32
    reach: int = 2
    hidden: int = 32
    rounds: int = 2
    every: int = 2
    rate: float = 0.1
    seed: int = 7

    @property
    def ids(self) -> int:
        return self.words + self.spare

    @property
    def highs(self) -> int:
        return -(-self.ids // DIGIT)


def _count(batches: Iterator) -> Iterator:
    """Word hashes with their counts, folded per batch."""
    import pyarrow as pa

    for batch in batches:
        parts = [
            kernels.Texts(part).word_hashes()
            for _, part in kernels.slices(kernels.blobs_of(batch.column(0)))
        ]
        if parts:
            words, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"]
            )


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; words by hash, A-Z lower-cased."""
    counted = texts.select("text").mapInArrow(_count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _encode(vocabulary, settings: Settings):
    """Word ids of texts as unsigned 16-bit integers, and the hashes of the words with shared ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, ids = vocabulary.value
        for batch in batches:
            blobs = kernels.blobs_of(batch.column(1))
            for begin, part in kernels.slices(blobs):
                texts = kernels.Texts(part)
                words = texts.word_hashes()
                out = (words % np.uint64(settings.spare)).astype(np.uint16) + settings.words
                hit = np.zeros(len(words), dtype=bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    hit = known[at] == words
                    out[hit] = ids[at[hit]]
                out = out.astype("<u2")
                rest = words[~hit].astype("<u8")
                ends = texts.first
                rest_ends = np.concatenate([[0], np.cumsum(~hit)])[ends]
                columns = [
                    [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    for x, cut in ((out, ends), (rest, rest_ends))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(part)), *[pa.array(c, pa.binary()) for c in columns]],
                    names=["node", "ids", "rest"],
                )

    return run


def _postings(batches: Iterator) -> Iterator:
    """(row, word, times) of the words with shared ids."""
    import pyarrow as pa

    for batch in batches:
        held = [np.frombuffer(blob or b"", "<u8") for blob in batch.column(1).to_pylist()]
        if not held:
            continue
        rows = np.repeat(batch.column(0).to_numpy(), [len(h) for h in held])
        words = np.concatenate(held)
        order = np.lexsort((words, rows))
        rows, words = rows[order], words[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1]))[: len(words)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[first]), pa.array(words[first].view(np.int64)),
                pa.array(np.diff(np.append(first, len(words)))),
            ],
            names=["row", "word", "times"],
        )


def shared_parts(encoded: DataFrame, rare: DataFrame) -> DataFrame:
    """(row, part): the sum of log n over a row's words with shared ids.

    ``rare`` is (word, n) of these words.  Sums are of whole numbers, so they do
    not depend on the order of rows.  The join hashes parts of ``JOIN_WORDS`` words
    of ``rare``, which has one row a word, so a part's size does not grow.
    """
    asked = encoded.select("row", "rest").mapInArrow(_postings, "row long, word long, times long")
    # A word that stands once has log n = 0.
    known = rare.where("n > 1").select("word", F.round(F.log("n") * FIXED).cast("long").alias("log_n"))
    known = cut_lineage(known, "rare")
    shuffles = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, -(-known.count() // JOIN_WORDS))
    found = asked.repartition(parts, "word").join(known.repartition(parts, "word").hint("shuffle_hash"), "word")
    return found.groupBy("row").agg((F.sum(F.col("times") * F.col("log_n")) / FIXED).alias("part"))


# -- network

NAMES = ("context", "bias", "high", "high_bias", "low", "low_bias")


def start(counts: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """Parameters before training: random context, biases from the counts of ids."""
    random = np.random.default_rng(settings.seed)
    size = settings.highs * DIGIT
    grid = np.zeros(size)
    grid[: len(counts)] = counts
    grid = (grid + 0.5).reshape(settings.highs, DIGIT)
    grid.reshape(-1)[settings.ids :] = 1e-3
    places = 2 * settings.reach
    scale = 1 / np.sqrt(settings.hidden)
    p = {
        # One row more, for places outside the document.
        "context": random.normal(0, 0.1, (places, size + 1, settings.hidden)),
        "bias": np.zeros(settings.hidden),
        "high": random.normal(0, scale, (settings.hidden, settings.highs)) * 0.1,
        "high_bias": np.log(grid.sum(1) / grid.sum()),
        "low": random.normal(0, scale, (settings.hidden, DIGIT)) * 0.1,
        "low_bias": np.log(grid / grid.sum(1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _exponentials(x: np.ndarray) -> np.ndarray:
    """exp of logits, in place, and their sums per row as a column.

    Logits end at +-CLIP, so no row overflows or vanishes and no maximum is needed.
    """
    np.clip(x, -CLIP, CLIP, out=x)
    np.exp(x, out=x)
    return (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]


def _log_chance(x: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Of each row of logits, the logarithm of the picked entry of its softmax."""
    chosen = np.clip(x[rows, pick], -CLIP, CLIP)
    return chosen - np.log(_exponentials(x)[:, 0])


def _errors(x: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Softmax of logits less the picked entries, over the number of rows, in place."""
    share = np.float32(1 / len(rows))
    x *= share / _exponentials(x)
    x[rows, pick] -= share
    return x


def _hidden(p: dict, around: np.ndarray) -> np.ndarray:
    h = p["context"][0].take(around[:, 0], axis=0)
    h += p["bias"]
    for k in range(1, around.shape[1]):
        h += p["context"][k].take(around[:, k], axis=0)
    return np.tanh(h, out=h)


def _logits(p: dict, h: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = h @ p["high"], h @ p["low"]
    x += p["high_bias"]
    y += p["low_bias"].take(high, axis=0)
    return x, y


def log_probabilities(p: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target id in its context."""
    high, low = target // DIGIT, target % DIGIT
    rows = np.arange(len(target))
    x, y = _logits(p, _hidden(p, around), high)
    return _log_chance(x, rows, high) + _log_chance(y, rows, low)


def _step(p: dict, sums: dict, around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch."""
    h = _hidden(p, around)
    high, low = target // DIGIT, target % DIGIT
    rows = np.arange(len(target))
    x, y = _logits(p, h, high)
    g1, g2 = _errors(x, rows, high), _errors(y, rows, low)
    back = g1 @ p["high"].T
    back += g2 @ p["low"].T
    back *= 1 - h * h
    # One row a high digit: few enough for a product with the positions of each.
    at_high = np.zeros((p["low_bias"].shape[0], len(target)), dtype=np.float32)
    at_high[high, rows] = 1
    grads = {
        "bias": back.sum(0), "high": h.T @ g1, "high_bias": g1.sum(0), "low": h.T @ g2, "low_bias": at_high @ g2,
    }
    for name, grad in grads.items():
        sums[name] += grad * grad
        p[name] -= rate * grad / (np.sqrt(sums[name]) + 1e-6)
    for k in range(around.shape[1]):
        _sparse(p["context"][k], sums["context"][k], around[:, k], back, rate)


def _sparse(value, total, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adagrad on the rows of a table that a batch touches."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # ids fit; sorted by digits
    rows = rows.take(order)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    which = rows.take(first)
    grad = np.add.reduceat(grad.take(order, axis=0), first, axis=0)
    now = total.take(which, axis=0)
    now += grad * grad
    total[which] = now
    np.sqrt(now, out=now)
    now += 1e-6
    grad *= rate
    grad /= now
    value[which] -= grad


def contexts(ids: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(targets, context ids) of all positions of some documents."""
    reach, pad = settings.reach, settings.highs * DIGIT
    gap = np.full(reach, pad, dtype=np.int64)
    parts = [gap]
    for doc in ids:
        parts += [doc.astype(np.int64), gap]
    line = np.concatenate(parts)
    at = np.flatnonzero(line != pad)
    around = np.stack([line[at + d] for d in range(-reach, reach + 1) if d], axis=1)
    return line[at], around


def _documents(batch, limit: int = 1 << 16) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of documents of about ``limit`` words."""
    held: list[np.ndarray] = []
    begin = size = 0
    for i, blob in enumerate(batch.column(1).to_pylist()):
        doc = np.frombuffer(blob, dtype="<u2")
        if size and size + len(doc) > limit:
            yield begin, held
            held, begin, size = [], i, 0
        held.append(doc)
        size += len(doc)
    if held:
        yield begin, held


def _train(sent, settings: Settings, turn: int):
    """This task's parameters after its positions of a round."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        p = {k: v.copy() for k, v in sent.value.items()}
        sums = {k: np.zeros_like(v) for k, v in p.items()}
        seen = 0
        kept_t: list[np.ndarray] = []
        kept_a: list[np.ndarray] = []
        waiting = 0

        def go() -> None:
            nonlocal waiting
            target, around = np.concatenate(kept_t), np.concatenate(kept_a)
            order = np.random.default_rng(seen).permutation(len(target))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                _step(p, sums, around[some], target[some], settings.rate)
            kept_t.clear()
            kept_a.clear()
            waiting = 0

        place = 0
        for batch in batches:
            for _, docs in _documents(batch):
                target, around = contexts(docs, settings)
                first = (turn - place) % settings.every
                place += len(target)
                kept_t.append(target[first :: settings.every])
                kept_a.append(around[first :: settings.every])
                seen += len(kept_t[-1])
                waiting += len(kept_t[-1])
                if waiting >= 16 * BATCH:
                    go()
        if waiting:
            go()
        if seen:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "task": pa.array([task] * len(NAMES), pa.int64()),
                    "name": list(NAMES),
                    "seen": pa.array([seen] * len(NAMES), pa.int64()),
                    "value": pa.array([p[n].astype("<f4").tobytes() for n in NAMES], pa.binary()),
                }
            )

    return run


def _average(table):
    """Mean of parameters by the positions behind them, in the order of tasks."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["task"])
    seen = sum(r["seen"] for r in rows)
    mean = sum(np.frombuffer(r["value"], "<f4").astype(np.float64) * (r["seen"] / seen) for r in rows)
    return pa.table(
        {
            "task": pa.array([rows[0]["task"] // FAN_IN], pa.int64()),
            "name": [rows[0]["name"]],
            "seen": pa.array([seen], pa.int64()),
            "value": pa.array([mean.astype("<f4").tobytes()], pa.binary()),
        }
    )


def train(encoded: DataFrame, counts: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """Parameters of the network after all rounds; their size does not depend on the corpus."""
    spark = encoded.sparkSession
    p = start(counts, settings)
    shape = "task long, name string, seen long, value binary"
    tasks = max(1, encoded.rdd.getNumPartitions())
    for turn in range(settings.rounds):
        sent = spark.sparkContext.broadcast(p)
        made = cut_lineage(encoded.mapInArrow(_train(sent, settings, turn), shape), "parameters")
        left = tasks
        while left > 1:  # groups of FAN_IN tasks, then of FAN_IN groups, ...
            group = F.floor(F.col("task") / F.lit(FAN_IN)).alias("group")
            made = cut_lineage(made.groupBy("name", group).applyInArrow(_average, shape), "parameters")
            left = -(-left // FAN_IN)
        found = {r["name"]: r["value"] for r in made.collect()}  # one row a name
        p = {k: np.frombuffer(found[k], "<f4").reshape(v.shape).copy() if k in found else v for k, v in p.items()}
    return p


def _score(sent, behind: np.ndarray, settings: Settings):
    """Sums of log-probabilities; a word with a shared id counts as one of ``behind[id]`` words."""
    less = np.zeros(settings.ids)
    less[settings.words :] = np.log(np.maximum(behind[settings.words :], 1))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = sent.value
        for batch in batches:
            for begin, docs in _documents(batch):
                target, around = contexts(docs, settings)
                parts = [
                    log_probabilities(p, around[a : a + BATCH], target[a : a + BATCH]) - less[target[a : a + BATCH]]
                    for a in range(0, len(target), BATCH)
                ]
                size = np.array([len(d) for d in docs], dtype=np.int64)
                begins = (np.cumsum(size) - size)[size > 0]
                total = np.zeros(len(docs))
                if len(begins):  # every text is summed on its own
                    total[size > 0] = np.add.reduceat(np.concatenate(parts).astype(np.float64), begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(docs)),
                        pa.array(size),
                        pa.array(total),
                        batch.column(2).slice(begin, len(docs)),
                    ],
                    names=["node", "n_words", "total", "row"],
                )

    return run


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """(id, n_words, pseudo_log_likelihood, per_word) of every row, trained on the same rows.

    pseudo_log_likelihood is the sum over the words of a text of their natural
    log-probability given up to ``reach`` words on either side; per_word is its
    mean, null for a text without words (null and empty ones too), whose sum is 0.
    Rows are scored on their own: a null id stays null, repeated rows count
    as often as they stand.  An empty table gives no rows.  Other columns are not read.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text_col}`").alias("text"))
    counted = cut_lineage(count_words(texts), "words")
    top = (
        counted.orderBy(F.col("n").desc(), "word")
        .limit(settings.words)  # the words with ids of their own
        .collect()
    )
    known = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    ids = np.arange(len(known), dtype=np.uint16)[order]
    vocabulary = spark.sparkContext.broadcast((known[order], ids))
    kind = texts.schema[0].dataType.simpleString()
    encoded = texts.mapInArrow(_encode(vocabulary, settings), f"node {kind}, ids binary, rest binary")
    encoded = cut_lineage(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    # Words after the last one of the vocabulary, in its order.
    last = (F.lit(top[-1]["n"]), F.lit(top[-1]["word"])) if top else (F.lit(0), F.lit(0))
    rare = counted.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    # The remainder of the hash as an unsigned number.
    wrap = F.when(F.col("word") < 0, 2**64 % settings.spare).otherwise(0)
    spare = F.pmod(F.pmod("word", F.lit(settings.spare)) + wrap, F.lit(settings.spare))
    counts = np.zeros(settings.ids)
    counts[: len(top)] = [r["n"] for r in top]
    for r in rare.groupBy(spare.alias("spare")).agg(F.sum("n").alias("n")).collect():  # one row a shared id
        counts[settings.words + r["spare"]] = r["n"]
    sent = spark.sparkContext.broadcast(train(encoded.select("node", "ids"), counts, settings))
    scored = encoded.select("node", "ids", "row").mapInArrow(
        _score(sent, counts, settings), f"node {kind}, n_words long, total double, row long"
    )
    scored = scored.join(shared_parts(encoded, rare), "row", "left").withColumn(
        "pseudo_log_likelihood", F.col("total") + F.coalesce("part", F.lit(0.0))
    )
    return scored.select(
        F.col("node").alias(id_col),
        "n_words",
        "pseudo_log_likelihood",
        (F.col("pseudo_log_likelihood") / F.nullif(F.col("n_words"), F.lit(0))).alias("per_word"),
    )
