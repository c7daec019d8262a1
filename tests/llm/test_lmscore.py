from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
from helpers import ODD_ROWS, no_docs, odd_docs, words

from textquarry.llm import kernels, lmscore, queries
from textquarry.llm.lmscore import Settings

FOLDER = "/root/testdata/sf0.001"
TINY = Settings(words=100, spare=8, hidden=8, rounds=1, every=1)


def parameters(seed=0, settings=TINY):
    random = np.random.default_rng(seed)
    p = lmscore.start(random.integers(1, 50, settings.ids).astype(float), settings)
    return {k: v.astype(np.float64) + random.normal(0, 0.3, v.shape) for k, v in p.items()}


def test_probabilities_sum_to_one():
    p = parameters()
    size = TINY.highs * lmscore.DIGIT
    around = np.tile(np.array([[3, size, 7, 9]]), (size, 1))
    total = np.exp(lmscore.log_probabilities(p, around, np.arange(size))).sum()
    assert abs(total - 1) < 1e-9


def test_a_step_follows_the_gradient():
    random = np.random.default_rng(2)
    around, target = random.integers(0, TINY.ids, (50, 4)), random.integers(0, TINY.ids, 50)
    p = parameters()
    loss = lambda q: -lmscore.log_probabilities(q, around, target).mean()
    moved = {k: v.copy() for k, v in p.items()}
    sums = {k: np.zeros_like(v) for k, v in p.items()}
    lmscore._step(moved, sums, around, target, 1e-9)
    for name in lmscore.NAMES:  # after one step sums hold the squared gradient
        for at in random.integers(0, p[name].size, 12):
            q = {k: v.copy() for k, v in p.items()}
            q[name].reshape(-1)[at] += 1e-5
            slope = (loss(q) - loss(p)) / 1e-5
            assert abs(abs(slope) - np.sqrt(sums[name].reshape(-1)[at])) < 1e-4


def test_contexts_stay_inside_documents():
    target, around = lmscore.contexts([np.array([1, 2, 3]), np.array([], dtype=int), np.array([4])], TINY)
    pad = TINY.highs * lmscore.DIGIT
    assert target.tolist() == [1, 2, 3, 4]
    assert around.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad] * 4]


def test_scores_equal_a_plain_sum(spark):
    """The distributed score against one word at a time, with the parameters at their start."""
    settings = Settings(words=50, spare=8, hidden=8, rounds=0)
    rows = [(i, t) for i, t, _ in ODD_ROWS[:12]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lmscore.score(docs, settings=settings).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(words(t)) for _, t in rows)
    for r in got:
        assert (r["per_word"] is None) == (r["n_words"] == 0)
        assert (r["pseudo_log_likelihood"] < 0) == (r["n_words"] > 0)


def test_training_generalises(spark):
    """A language with rules: trained scores beat the start, shuffled words score worse."""
    random = np.random.default_rng(4)
    def sentence():
        return " ".join(f"{k}a {k}b {k}c" for k in random.integers(0, 30, 40))
    rows = [(i, sentence()) for i in range(300)]
    held = sentence().split()
    rows += [(1000, " ".join(held)), (1001, " ".join(random.permutation(held)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = Settings(words=120, spare=8, hidden=16, rounds=3, every=2, rate=0.3)
    after = {r["doc_id"]: r["per_word"] for r in lmscore.score(docs, settings=made).collect()}
    before = lmscore.score(docs, settings=Settings(words=120, spare=8, hidden=16, rounds=0)).collect()
    start = np.mean([r["per_word"] for r in before])
    assert np.mean([after[i] for i in range(300)]) > start + 1
    assert after[1000] > after[1001] + 1


def test_query_and_empty_table(spark):
    got = queries.QUERIES["op10_masked_pseudo_likelihood"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == {r["doc_id"]: len(words(r["text"])) for r in docs}
    assert lmscore.score(no_docs(spark), settings=TINY).count() == 0
    assert lmscore.score(odd_docs(spark), settings=TINY).count() == len(ODD_ROWS)


def test_averages_in_a_tree(spark, monkeypatch):
    """Groups of two tasks give the mean of all tasks."""
    monkeypatch.setattr(lmscore, "FAN_IN", 2)
    docs = spark.createDataFrame([(i, f"a b c d {i % 3}") for i in range(64)], "doc_id long, text string")
    assert lmscore.score(docs.repartition(7), settings=TINY).count() == 64


def test_words_outside_the_vocabulary_have_their_own_probability(spark):
    """One-word documents: words that share an id differ by their counts, and all sum to one."""
    times = {"common": 60, "seldom": 30, "scarce": 9, "once": 1}
    rows = [(w, w) for w, n in times.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    for spare in (1, 7):
        settings = Settings(words=1, spare=spare, hidden=8, rounds=0)
        got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in lmscore.score(docs, settings=settings).collect()}
        if spare == 1:
            assert abs(got["seldom"] - got["scarce"] - np.log(30 / 9)) < 1e-6
            assert abs(got["scarce"] - got["once"] - np.log(9)) < 1e-6
        assert got["seldom"] > got["scarce"] > got["once"]
        assert abs(sum(np.exp(v) for v in got.values()) - 1) < 0.1  # ids without a word take the rest


def test_rounds_train_on_every_position(monkeypatch):
    """By default each position is a target once, in documents of one word too."""
    seen: list[int] = []
    monkeypatch.setattr(lmscore, "_step", lambda p, sums, around, target, rate: seen.extend(target.tolist()))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    settings = Settings()
    ids = np.arange(1500, dtype="<u2")
    docs = np.split(ids, np.unique(np.random.default_rng(3).integers(1, 1500, 300)))
    batches = [
        pa.RecordBatch.from_pydict({"node": list(range(len(some))), "ids": [d.tobytes() for d in some]})
        for some in (docs[:100], docs[100:])
    ]
    sent = SimpleNamespace(value=lmscore.start(np.ones(settings.ids), settings))
    for turn in range(settings.rounds):
        list(lmscore._train(sent, settings, turn)(iter(batches)))
    assert sorted(seen) == ids.tolist()


def plain_trained_scores(texts, settings):
    """One task, one round, one batch: everything position by position in doubles."""
    lists = [words(t) for t in texts]
    counts: dict = {}
    for w in (w for ws in lists for w in ws):
        counts[w] = counts.get(w, 0) + 1
    number = {w: int(kernels.Texts([w.encode()]).word_hashes()[0]) for w in counts}
    signed = {w: h - (1 << 64 if h >> 63 else 0) for w, h in number.items()}
    own = sorted(counts, key=lambda w: (-counts[w], signed[w]))[: settings.words]
    place = {w: own.index(w) if w in own else settings.words + number[w] % settings.spare for w in counts}
    behind = np.zeros(settings.ids)
    for w, n in counts.items():
        behind[place[w]] += n
    p = {k: v.astype(np.float64) for k, v in lmscore.start(behind, settings).items()}
    pad, reach = settings.highs * lmscore.DIGIT, settings.reach
    spots = []
    for ws in lists:
        ids = [pad] * reach + [place[w] for w in ws] + [pad] * reach
        spots.append([(ids[k], [ids[k + d] for d in range(-reach, reach + 1) if d]) for k in range(reach, len(ids) - reach)])

    def forward(target, around):
        h = np.tanh(p["bias"] + sum(p["context"][k][c] for k, c in enumerate(around)))
        shares = []
        for logits in (h @ p["high"] + p["high_bias"], h @ p["low"] + p["low_bias"][target // lmscore.DIGIT]):
            e = np.exp(logits)
            shares.append(e / e.sum())
        return h, *shares

    every = [x for doc in spots for x in doc]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    for target, around in every:
        high, low = divmod(target, lmscore.DIGIT)
        h, a, b = forward(target, around)
        a[high] -= 1
        b[low] -= 1
        back = (p["high"] @ a + p["low"] @ b) * (1 - h * h)
        for name, part in (("high", np.outer(h, a)), ("high_bias", a), ("low", np.outer(h, b)), ("bias", back)):
            grad[name] += part / len(every)
        grad["low_bias"][high] += b / len(every)
        for k, c in enumerate(around):
            grad["context"][k][c] += back / len(every)
    for name, g in grad.items():
        p[name] -= settings.rate * g / (np.abs(g) + 1e-6)
    out = []
    for ws, doc in zip(lists, spots, strict=True):
        total = 0.0
        for w, (target, around) in zip(ws, doc, strict=True):
            _, a, b = forward(target, around)
            total += np.log(a[target // lmscore.DIGIT]) + np.log(b[target % lmscore.DIGIT])
            if target >= settings.words:
                total += np.log(counts[w]) - np.log(behind[target])
        out.append(total)
    return out


def test_trained_scores_equal_brute_force(spark):
    random = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in np.minimum(random.geometric(0.12, n), 40)) for n in (60, 1, 25, 90, 3, 60)]
    texts += [texts[0], "W1 w2\nw3", "only here", None, ""]
    settings = Settings(words=80, spare=3, hidden=8, rounds=1, every=1, rate=0.3)
    few = Settings(words=9, spare=3, hidden=8, rounds=1, every=1, rate=0.3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for made in (settings, few):
        got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in lmscore.score(docs, settings=made).collect()}
        want = plain_trained_scores(texts, made)
        start = plain_trained_scores(texts, Settings(**{**made.__dict__, "rate": 0.0}))
        assert all(abs(got[i] - w) < 2e-4 * max(1, abs(w)) for i, w in enumerate(want))
        assert abs(sum(want) - sum(start)) > 5  # far more than the tolerance
        assert abs(got[0] - got[6]) < 1e-4
