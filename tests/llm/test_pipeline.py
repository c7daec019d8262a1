import numpy as np
from helpers import clean_lines, near_components, no_docs, odd_docs, words
from test_decontam import plain_tiles
from test_quality import plain
from test_tokens import check_layout, whole

import __spark_entry__ as entry
import corpus_pipeline
from textquarry.llm import quality

FOLDER = "/root/testdata/sf0.001"


def brute_force(docs, items):
    """doc_id -> text that reaches the packing, stage by stage in plain Python."""
    kept = {}
    for i, (text, lang) in docs.items():
        row = plain(text) | {"script": "latin", "token_entropy": plain(text)["token_entropy"].expected}
        if quality._verdict(row, lang, quality.BANDS)[1]:
            kept[i] = text
    kept = {i: t for i, _, _, t in clean_lines(list(kept.items()))}
    root = near_components(list(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    for i, text in list(kept.items()):
        w = words(text)
        for item in items:
            x = words(item)
            # Only pairs with five words in a row in common can have a tile.
            if len(x) >= 5 and {tuple(w[k : k + 5]) for k in range(len(w) - 4)} & {tuple(x[k : k + 5]) for k in range(len(x) - 4)}:
                if 100 * sum(n for *_, n in plain_tiles(w, x, 5)) >= 50 * len(x):
                    kept.pop(i, None)
    return kept


def test_stages_equal_brute_force(spark):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute_force(docs, items)
    rows = entry.queries()["pipeline"](spark, FOLDER).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    ids = whole("word_bpe_49k.json", list(want.values()))
    assert got == {i: [*x, 1] for i, x in zip(want, ids, strict=True)}
    check_layout(rows, 4096)


def test_stages_take_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert stage(spark, no_docs(spark), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_entry_has_all_operators():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
