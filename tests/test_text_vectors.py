"""Text vectors: right counts, and memory that follows a slice of texts, not the batch or its vocabulary."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from vellumine.functions import vectors as V


def test_memory_is_bounded():
    words = [f"w{i}" for i in range(4 * V.KNOWN_WORDS)]
    texts = [" ".join(words[i * 1000 % len(words) :][:1000]) for i in range(4000)]
    batch = pa.array(texts)
    tracemalloc.start()
    found = list(V.hashed_text_vector.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 4000 and peak < 40e6, peak  # all words as objects took over 200 MB


def test_counts():
    text = "the cat The dog cat"
    want = np.zeros(V.DIM)
    for w in text.lower().split():
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % V.DIM] += 1
    found = list(V.hashed_text_vector.func(iter([pa.array([text, None, " "]), pa.array([], pa.string())])))
    assert np.allclose(found[0][0].as_py(), want / np.linalg.norm(want))
    assert not np.any(found[0][1].as_py()) and not np.any(found[0][2].as_py()) and len(found[1]) == 0
