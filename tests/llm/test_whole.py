"""The text operators do the whole job: short passages, long words, long pages, neighbours across partitions."""

from __future__ import annotations

import random

import public_tokenizers

from botlake.llm import cdc, sentencepieces


def test_short_passages_go(spark):
    """Passages of 51 to 60 words in two documents each: few stay whole, and little of the others."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(5000)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    planted = [words(51 + i % 10) for i in range(600)]
    rows = [(k * 600 + i, f"{words(40)} {p} {words(40)}") for k in (0, 1) for i, p in enumerate(planted)]
    out = {r["doc_id"]: r["removed"] for r in cdc.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = []
    for (k, t), p in zip(rows[600:], planted, strict=True):
        lo, hi = t.index(p), t.index(p) + len(p)
        shares.append(sum(max(0, min(hi, r["start"] + r["length"]) - max(lo, r["start"])) for r in out[k]) / len(p))
    assert not any(out[k] for k, _ in rows[:600])
    assert sum(x == 0 for x in shares) <= 0.01 * len(shares)
    assert sum(shares) / len(shares) >= 0.8


def test_long_words_get_their_best_path():
    """A word of any length has the ids of the plain forward pass, with and without literal marks."""
    p = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    parts = ["international", "isation", "ther", "eby", "日本", "é", "😀", "station", "ing", "q"]
    for size in (4095, 4096, 4097, 9000, 20000):
        for _ in range(4):
            word = "▁" + "".join(rng.choice(parts) for _ in range(size))[: size - 1]
            plain = p.encode_sorted([word])[0]
            assert tuple(p.encode([word[1:]])[0]) == plain == p.encode_hard(word)
    long = "".join(rng.choice(parts) for _ in range(3000))
    tail = p.encode_sorted([long])[0]
    assert tuple(p.encode(["a▁" + long])[0]) == (*p.encode_sorted(["▁a"])[0], *[p.byte_ids[b] for b in "▁".encode()], *tail)
    assert p.decode(p.encode(["▁▁" + long + "▁"])[0]) == "▁▁" + long + "▁"
