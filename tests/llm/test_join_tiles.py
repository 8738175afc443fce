"""Operator 8 counts links once, also if tiles are empty."""

import numpy as np

from spanforge.llm import ngramjoin

from .test_operators import brute_join


def test_few_long_texts_with_empty_tiles(spark, monkeypatch):
    """Pairs and triples of near-equal texts longer than a tile, and buckets of more tiles than classes."""
    monkeypatch.setattr(ngramjoin, "TILE", 1)
    monkeypatch.setattr(ngramjoin, "TILE_CHARS", 3_000)
    rng = np.random.default_rng(8)
    docs = []
    for group in range(12):
        base = rng.integers(5000, size=900)
        for _ in range(2 + group % 2):
            own = base.copy()
            own[rng.integers(900)] = rng.integers(5000)
            docs.append((len(docs), " ".join(f"w{x}" for x in own)))
    found = ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["text_id"], r["n_links"], r["n_copies"]) for r in found} == brute_join(docs)
    assert max(r["n_links"] for r in found) == 2
