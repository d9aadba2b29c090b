"""Periodic run detection by seed-and-extend on diagonals.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) whose length is at least
``least_words`` and ``least_times`` times ``q``, and which no neighbouring word extends.

Seeds. A run of period ``q`` matches itself at lag ``q`` over its length minus ``q``. The least such overlap of any period is the
size of the first k-grams; further octaves of periods, from half of k to k, overlap by more than k words, so k doubles with them.
As a k-gram at least as long as the period comes again in the run first at lag ``q``, only neighbouring occurrences of a k-gram
are paired: a word repeated a million times makes a million pairs, not their square. k-grams are numbered exactly, by pairs of
shorter ones, and those that occur once are left out, so that most texts end after a few steps.

Extension. Seeds are met by lag and place. A table per lag holds the furthest matched place; seeds before it are suppressed,
others extend to both sides word by word, in growing blocks.

All is one pass over the rows; nothing is shuffled, and a task holds one text's words at a time.

Defined cases: a null or empty text has no words and no run; rows are told apart by nothing but themselves, so repeated and null
ids, ties and clashing columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced, texts_of

#: Words of an extension's first block.
BLOCK = 64
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the number of its key, or -1 where it has none or its key occurs once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.full(n, -1, np.int64)
    again = count[number] > 1
    out[places[again]] = number[again]
    return out


def longer(grams: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the grams made of the one at a place and the one ``step`` further on."""
    n = len(grams)
    if step >= n:
        return np.full(n, -1, np.int64)
    places = np.flatnonzero((grams[: n - step] >= 0) & (grams[step:] >= 0))
    return repeated(grams[places] * (grams.max() + 1) + grams[places + step], places, n)


def seeds(grams: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag and place of neighbouring occurrences of one gram with ``low`` < lag <= ``high``, by lag and place; of seeds at
    one lag and consecutive places only the first, as the extension covers the others."""
    places = np.flatnonzero(grams >= 0)
    places = places[np.argsort(grams[places], kind="stable")]
    lag = np.diff(places)
    fits = (np.diff(grams[places]) == 0) & (lag > low) & (lag <= high)
    lag, place = lag[fits], places[:-1][fits]
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    first = np.ones(len(lag), bool)
    first[1:] = (np.diff(lag) != 0) | (np.diff(place) != 1)
    return lag[first], place[first]


def reach(ids: np.ndarray, place: int, lag: int, forward: bool) -> int:
    """First place from ``place`` on (or after which, going back) where the words do not match those ``lag`` further on."""
    size = BLOCK
    while True:
        start, end = (place, min(len(ids) - lag, place + size)) if forward else (max(0, place - size), place)
        if start >= end:
            return place
        differ = np.flatnonzero(ids[start:end] != ids[start + lag : end + lag])
        if len(differ):
            return start + int(differ[0]) if forward else start + int(differ[-1]) + 1
        place, size = (end if forward else start), size * 2


def find_runs(ids: np.ndarray, least_words: int = 24, least_times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if least_times < 3:
        raise ValueError("runs of less than three periods have no guaranteed gram of a period's length")
    n = len(ids)
    if n < least_words:
        return []
    k = min(max(least_words - q, (least_times - 1) * q) for q in range(1, least_words + 1))
    grams, size = repeated(ids, np.arange(n), n), 1
    while size < k and grams.max() >= 0:
        step = min(size, k - size)
        grams, size = longer(grams, step), size + step
    low, covered, out = 0, {}, []
    while grams.max() >= 0 and low * least_times < n:
        for lag, place in zip(*(x.tolist() for x in seeds(grams, low, k))):
            if place < covered.get(lag, 0):
                continue
            start, end = reach(ids, place, lag, False), reach(ids, place, lag, True)
            covered[lag] = end
            length = end - start + lag
            if length >= max(least_words, least_times * lag):
                out.append((start, length, lag))
        grams, low, k = longer(grams, k), k, 2 * k
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]


def collapse_runs(docs: DataFrame, least_words: int = 24, least_times: int = 3) -> DataFrame:
    """doc_id, ``n_words``, ``runs`` (array of start, length, period in words) and ``text``: the words that stay, joined by
    one space."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, runs, texts = [], [], []
            for text in texts_of(batch):
                words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 \x09-\x0D only
                found = find_runs(numbered(words), least_words, least_times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(kept_words(words, found)).decode("utf-8", "surrogatepass"))
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "text"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
