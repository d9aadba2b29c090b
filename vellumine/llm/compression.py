"""Quality rules: compression bands.

Each text is compressed whole, and in fixed chunks of ``CHUNK`` bytes (texts of few chunks: smaller ones, ``CHUNKS``), with
zstandard. The ratio of its bytes to its compressed bytes must lie inside the band of its length: above the band it is
repetitive, below it is incompressible (noise, encoded data). A text also goes if chunks with half of its bytes or more lie
outside the band of a chunk's length on one side, which a ratio over the whole text can miss. Chunks are laid from the start
and again from the end, and the greater share counts, so the order of the parts doesn't decide; a rest below half a chunk
belongs to the last one, so every byte lies in a tested chunk. Before the bands, base rules reject texts that are too short or
repeat 3-word windows.

All is computed in one pass over Arrow batches; nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rules. Below 16 kB codes of few symbols (hex digits: 2)
compress like prose and pass; below 512 bytes only noise and part of the encoded data fall out of the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced, texts_of

#: Bytes below, least and greatest ratio of whole texts of that length at level 3. The upper limits stand about
#: a twentieth above what prose reaches at the band's upper end (measured in four languages: 1.91, 1.99, 2.23, 2.41, 2.55 from 512
#: bytes on; long books 2.8), the lower ones between codes of 64 symbols (8 / 6; with spaces 1.39) or, from 16 kB on, space-split
#: codes of 16 symbols (1.88), and prose.
BANDS = (
    (256, 0.6, 2.1), (512, 1.15, 2.1), (1024, 1.35, 2.15), (4096, 1.45, 2.4), (16384, 1.7, 2.52), (65536, 1.95, 2.75),
    (float("inf"), 1.95, 3.0),
)
#: Least and greatest ratio of a chunk (prose: 1.72 to 2.28).
CHUNK = 4096
CHUNK_BAND = (1.55, 2.42)
#: Bytes of a text below, bytes of its chunks.
CHUNKS = ((4096, 512), (16384, 1024), (float("inf"), CHUNK))
#: Share of a text's bytes, in chunks outside the band, that rejects it.
CHUNK_SHARE = 0.5
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    words = data.split()  # bytes split at \x20 \x09-\x0D only
    n = len(words)
    starts = len(data) - sum(map(data.count, map(bytes, zip(SPACES))))  # bytes that are no white space
    trailing = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(data.count, map(bytes, zip(SYMBOLS))))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    return n, starts - trailing, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window = ids[:n]
    for i in range(1, size):  # two words at a time: numbers stay below the square of the length
        _, window = np.unique(window, return_inverse=True) if i > 1 else (None, window)
        window = window * len(numbers) + ids[i : i + n]
    _, place, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + n] |= again
    return int(covered.sum())


def cuts(n_bytes: int) -> list[int]:
    """Borders of a text's chunks: the last takes a rest below half a chunk."""
    size = next(c for below, c in CHUNKS if n_bytes < below)
    n = max(1, (n_bytes + size // 2) // size)
    return [*range(0, n * size, size), n_bytes]


def ratios(data: bytes, tool: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole text, and the shares of its bytes in chunks above and below the chunks' band."""
    n = len(data)
    whole = n / len(tool.compress(data)) if data else 0.0
    borders = cuts(n)
    above = below = 0
    for laid in (borders, [n - x for x in reversed(borders)]) if len(borders) > 2 else ():
        high = low = 0
        for start, end in zip(laid, laid[1:]):
            least, most = CHUNK_BAND if end - start >= CHUNK else band(end - start)
            ratio = (end - start) / len(tool.compress(data[start:end]))
            high += (ratio > most) * (end - start)
            low += (ratio < least) * (end - start)
        above, below = max(above, high), max(below, low)
    return whole, above / max(1, n), below / max(1, n)


def band(n_bytes: int) -> tuple[float, float]:
    return next(b[1:] for b in BANDS if n_bytes < b[0])


def verdict(n_bytes: int, whole: float, above: float, below: float) -> str:
    """``repetitive``, ``incompressible`` or ``kept``."""
    least, most = band(n_bytes)
    if whole > most or above >= CHUNK_SHARE:
        return "repetitive"
    return "incompressible" if whole < least or below >= CHUNK_SHARE else "kept"


def quality_rules(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the verdict's ground:
    ``ratio`` of the whole text and ``reason`` (``base``, ``repetitive``, ``incompressible`` or ``kept``)."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "reason"]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.string()]

    def judge(tool: zstandard.ZstdCompressor, text: str) -> tuple:
        data = text.encode("utf-8")
        counts = base_counts(data)
        failed = counts[0] < least_words or 100 * counts[4] > most_repeated * counts[0]
        whole, above, below = ratios(data, tool)
        reason = "base" if failed else verdict(len(data), whole, above, below)
        return *counts, failed, reason == "kept", whole, reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL)
        for batch in sliced(batches):
            rows = [judge(tool, t) for t in texts_of(batch)]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, schema + "base_failed boolean, kept boolean, ratio double, reason string")


def kept_documents(docs: DataFrame, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Documents that the rules keep, with the input's columns. Whole rows pass through the tasks, so nothing is joined."""
    names = list(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL)
        for batch in sliced(batches):
            good = []
            for text in batch.column(at).to_pylist():
                data = (text or "").encode("utf-8")
                counts = base_counts(data)
                failed = counts[0] < least_words or 100 * counts[4] > most_repeated * counts[0]
                good.append(not failed and verdict(len(data), *ratios(data, tool)) == "kept")
            yield batch.filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)
