"""Vectors in blocks: what is sent, and links that cross blocks and tiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_statements import brute_links

from botlake.llm import vectors


def test_no_cell_is_cut_into_copies(spark):
    """In 64 dimensions pivots bound little: vectors that would go to most cells stay where they are."""
    x = np.random.default_rng(1).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    points = vectors.usable(df, "vec_id", "embedding", "label")
    assert vectors.cells_of(points, math.sqrt(0.04)).count() <= vectors.MOST_COPIES * 3000
    assert dict(points.dtypes)["v"] == "array<float>"


def test_blocks_are_bounded_in_bytes():
    """However long the vectors are."""
    assert vectors.block_size(64) == 16_384 and vectors.block_size(4096) == 256 and vectors.block_size(10**6) == 64


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_across_blocks_and_tiles(spark, monkeypatch, kind):
    """Chains, stars and a heap of near copies in one uncut cell of several blocks, in tiles of a few vectors."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "TILE", (7, 13))
    rng = np.random.default_rng(3)
    angles = np.arange(200) * 0.15  # cosine of neighbours 0.9888, of the next but one 0.955: a chain around the circle
    chain = np.stack([np.cos(angles[:40]), np.sin(angles[:40]), *np.zeros((4, 40))], axis=1)
    heap = np.array([0, 0, 1.0, 1, 0, 0]) + rng.normal(scale=0.03, size=(250, 6))
    x = np.concatenate([chain, heap, rng.normal(size=(400, 6))]).astype(np.float32).astype(np.float64)
    x = x[rng.permutation(len(x))]
    rows = [(i, v.tolist(), int(i % 5 == 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.range_join(df).collect()}
    assert got == set(brute_links(rows))


def test_trees_of_a_tile_meet(monkeypatch):
    """Random bipartite links: the forest's roots are the components' smallest places."""
    rng = np.random.default_rng(4)
    for share in (0.005, 0.02, 0.2):
        near = rng.random((60, 80)) < share
        i, j = np.arange(60) * 2, np.concatenate([np.arange(60) * 2 + 1, np.arange(120, 140)])
        parent = vectors._merge(np.arange(140), near, i, j)
        want = np.arange(140)
        for _ in range(140):
            for a, b in zip(*np.nonzero(near)):
                want[i[a]] = want[j[b]] = min(want[i[a]], want[j[b]])
        assert (parent == want).all()
