"""Compression bands: every byte lies in a tested chunk."""

import base64
import random

import pytest
import zstandard

from vellumine.llm import compression

TOOL = zstandard.ZstdCompressor(level=compression.LEVEL)


def judge(data):
    return compression.verdict(len(data), *compression.ratios(data, TOOL))


def prose(n, rng):
    words = [bytes(rng.choice(b"etaoinshrdlucmwfgyp") for _ in range(rng.randrange(2, 9))) for _ in range(700)]
    return b" ".join(rng.choice(words) for _ in range(n))[:n]


@pytest.mark.parametrize("n", [0, 1, 511, 767, 768, 1024, 4095, 4096, 5000, 8191, 16_384, 30_001])
def test_chunks_cover_the_text(n):
    borders = compression.cuts(n)
    assert borders[0] == 0 and borders[-1] == n and borders == sorted(borders)
    size = next(c for below, c in compression.CHUNKS if n < below)
    assert all(b - a < 1.5 * size for a, b in zip(borders, borders[1:]))


@pytest.mark.parametrize("n", [1100, 1900, 3900, 8100, 8190, 12_000, 19_000, 25_000])
def test_order_of_the_halves_does_not_decide(n):
    rng = random.Random(n)
    clean, again = prose(n // 2 - 50, rng), (b"same words again " * n)[: n - n // 2 + 50]
    assert judge(clean) == "kept"
    assert judge(again + clean) == judge(clean + again) == "repetitive"


LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("n", [600, 1100, 3000, 4096, 9000, 13_500, 54_000, 270_000])
def test_encoded_data_and_noise_go(n):
    rng = random.Random(n)
    encoded = base64.encodebytes(rng.randbytes(n))[:n]
    letters = b" ".join(bytes(rng.choices(LETTERS, k=rng.randrange(3, 12))) for _ in range(n))[:n]
    noise = bytes(rng.choices(range(32, 127), k=n))
    assert judge(encoded) == judge(letters) == judge(noise) == "incompressible"
    assert judge(prose(n, rng)) == "kept"


def test_short_noise_goes():
    rng = random.Random(7)
    for n in (256, 300, 400, 511):
        assert judge(bytes(rng.choices(range(32, 127), k=n))) == "incompressible"


@pytest.mark.parametrize("n", [2000, 9000, 30_000])
def test_half_encoded_text_goes(n):
    rng = random.Random(n)
    clean, encoded = prose(n // 2 - n // 20, rng), base64.encodebytes(rng.randbytes(n))[: n // 2 + n // 20]
    assert judge(clean + encoded) == judge(encoded + clean) == "incompressible"


def test_bands_act_on_the_tables(spark):
    """Beside the base rules the bands alone reject, mostly what labels call bad, and leave labelled good texts alone."""
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = compression.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "reason", "base_failed").collect()
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["reason"] == "kept" for r in good) >= 0.97 * len(good)
    out = [r for r in rows if r["reason"] in ("repetitive", "incompressible")]
    bad = [r for r in out if labels.get(r["doc_id"]) == 0]
    assert len(out) >= 50 and len(bad) >= 10 * sum(labels.get(r["doc_id"]) == 1 for r in out)


def test_spaced_hex_goes_from_16_kb_on():
    rng = random.Random(4)
    data = b" ".join(rng.randbytes(4).hex().encode() for _ in range(9000))
    assert judge(data[:40_000]) == judge(data) == "incompressible"
