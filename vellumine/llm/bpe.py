"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last bytes meets a pattern, so equal passages give equal chunks in
whatever document and place they stand. A chunk is encoded once per Python worker and then looked up by its bytes. Its
*core* runs from its first to its last break (an ASCII space between words); the words cut at its ends are not trusted:
at every join the bytes from the left chunk's last break to the right chunk's first break are encoded again, as one piece.
If a chunk holds no break the piece grows over it and goes on, up to breaks on both sides, where both readings agree
because no token or normalisation of the tokenizer reaches over such a break. So ids equal those of the whole text, also
for texts with cuts inside runs that have no break at all.

Inside a core the same is done with single words as the chunks (they end at breaks, so their joins need no repair): words
new to the worker go to the tokenizer together, each once. Both dictionaries are bounded in bytes and start anew when full.

No text moves between tasks: moving a chunk costs more than encoding it. Decoding takes the library's decoder over each
document's ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of special tokens in a text are
special tokens, as the library has it; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced, texts_of, worker_state

#: Rolling hash: bytes it looks at, and the bits that must be zero at a cut (a chunk is about 2 ** CUT_BITS bytes).
WINDOW = 16
CUT_BITS = 9
CHUNK_BYTES = 24_000_000
PIECE_COUNT = 250_000
NEW_PIECES = 4096
#: Characters whose new words go to the tokenizer together.
GROUP_CHARS = 1_000_000


def byte_table() -> np.ndarray:
    """A fixed 32-bit number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


TABLE = byte_table()


def cuts(data: bytes, window: int = WINDOW, bits: int = CUT_BITS) -> list[int]:
    """Places at which the rolling hash of the ``window`` bytes before has ``bits`` zero bits."""
    if len(data) <= window:
        return []
    values = TABLE[np.frombuffer(data, np.uint8)]
    rolled = np.zeros(len(values) - window + 1, np.uint32)
    for i in range(window):
        rolled += values[i : i + len(rolled)] << np.uint32(window - 1 - i)
    found = np.flatnonzero((rolled >> np.uint32(32 - bits)) == 0) + window
    return found[found < len(data)].tolist()


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


class ChunkEncoder:
    """Encodes texts with a tokenizer whose tokens never reach over a break, nor from letters into the marks after them.

    ``odd`` finds texts in which a break might not part tokens: those go to the tokenizer as they are.
    """

    def __init__(self, tokenizer, odd: str | None, chunk_bytes: int = CHUNK_BYTES, piece_count: int = PIECE_COUNT):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer
        self.direct = (
            tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"
            and not tokenizer.model.end_of_word_suffix and not tokenizer.model.continuing_subword_prefix
        )
        self.odd = re.compile(odd) if odd else None
        self.chunks: dict[bytes, tuple[int, int, bytes]] = {}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunk_bytes, self.piece_count, self.held = chunk_bytes, piece_count, 0

    def plain(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def by_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words. Where the tokenizer has byte-level words and no normaliser, a run of letters after at most
        one space is one word of its merges, which are asked at once."""
        if not self.direct:
            return self.plain([w.decode() for w in words])
        merge = self.tokenizer.model.tokenize
        letters = [LETTERS.fullmatch(w) is not None for w in words]
        rest = iter(self.plain([w.decode() for w, one in zip(words, letters) if not one]))
        return [
            array("I", [t.id for t in merge(w.decode("latin-1").translate(BYTE_LETTERS))]).tobytes() if one else next(rest)
            for w, one in zip(words, letters)
        ]

    def learn(self, words: set[bytes]) -> None:
        """Ids of the words that the worker doesn't hold; letters and the marks after them are looked up apart."""
        known, older, new, split = self.words, self.older, {}, []
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif m := MARKED.fullmatch(w):
                split.append((w, m[1], m[2]))
                for part in m.groups():
                    if part not in known:
                        if (ids := older.get(part)) is not None:
                            known[part] = ids
                        else:
                            new[part] = None
            else:
                new[w] = None
        new = list(new)
        for at in range(0, len(new), NEW_PIECES):
            part = new[at : at + NEW_PIECES]
            known.update(zip(part, self.by_words(part)))
        for w, letters, marks in split:
            known[w] = known[letters] + known[marks]

    def joined(self, spans: list[bytes]) -> list[bytes]:
        """Ids of spans that begin and end at breaks."""
        if len(self.words) > self.piece_count:
            self.words, self.older = {}, self.words
        cut = [pieces(s) for s in spans]
        missing = set().union(*cut).difference(self.words)
        if missing:
            self.learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def spans(self, data: bytes) -> list[bytes | tuple[bytes, int, int]]:
        """The joins of a text, and between them its chunks with their cores' begin and end."""
        edges = [0, *cuts(data), len(data)]
        out, open_from = [], 0
        for begin, end in zip(edges[:-1], edges[1:]):
            chunk = data[begin:end]
            known = self.chunks.get(chunk)
            first, last = known[:2] if known else (first_break(chunk), last_break(chunk))
            if 0 <= first < last:
                out += [data[open_from : begin + first], (chunk, first, last)]
                open_from = begin + last
        return [*out, data[open_from:]]

    def encode_chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; chunks that the worker holds are not encoded again."""
        out = []
        for group in self.groups(texts):
            cut = [self.plain([t])[0] if self.is_odd(t) else self.spans(t.encode("utf-8")) for t in group]
            parts = [p for c in cut if isinstance(c, list) for p in c]
            new = dict.fromkeys(p for p in parts if isinstance(p, tuple) and p[0] not in self.chunks)
            joins = [p for p in parts if isinstance(p, bytes)]
            ids = iter(self.joined([c[first:last] for c, first, last in new] + joins))
            for c, first, last in new:
                self.chunks[c] = (first, last, core := next(ids))
                self.held += len(c) + len(core) + 200
            for c in cut:
                if isinstance(c, list):
                    c = b"".join([next(ids) if isinstance(p, bytes) else self.chunks[p[0]][2] for p in c])
                out.append(c)
            if self.held > self.chunk_bytes:
                self.chunks, self.held = {}, 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """As ``encode_chunked``, by words alone."""
        out = []
        for group in self.groups(texts):
            odd = [self.is_odd(t) for t in group]
            ids = iter(self.joined([t.encode("utf-8") for t, o in zip(group, odd) if not o]))
            out += [self.plain([t])[0] if o else next(ids) for t, o in zip(group, odd)]
        return out

    def is_odd(self, text: str) -> bool:
        return self.odd is not None and self.odd.search(text) is not None

    @staticmethod
    def groups(texts: list[str]) -> Iterator[list[str]]:
        """Runs of texts of about ``GROUP_CHARS``."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group


def first_break(data: bytes) -> int:
    m = BREAK.search(data)
    return m.start() + 1 if m else -1


def last_break(data: bytes) -> int:
    at = max(data.rfind(b" "), data.rfind(b"\n"))
    while at > 0 and data[at - 1] in b" \n":
        at -= 1
    return at if at > 0 else -1


#: A break: the place between a byte that is no space or newline and one that is.
BREAK = re.compile(rb"[^ \n][ \n]")
#: White space besides space and newline, which may be part of a longer run.
ODD_SPACE = "[\\t\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Words with the run of spaces before them.
SPACED = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: A word of ASCII and Latin-1 letters, and ASCII marks after it (no apostrophe, which may start a suffix).
MARKED = re.compile(rb"([ \n]*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")


def pieces(data: bytes) -> list[bytes]:
    """Words with the spaces before them: cut at every break."""
    if b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data or b"\0" in data:
        return SPACED.findall(data)
    return data.replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")


def encoder(path: str, name: str, piece_count: int = PIECE_COUNT) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""

    def build() -> ChunkEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would only wait
        from tokenizers import Tokenizer

        return ChunkEncoder(Tokenizer.from_file(path), ODD_SPACE, piece_count=piece_count)

    return worker_state(f"{name}:{path}", build)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of every text."""
    return _coded(docs, path, True)


def coded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of ids and decoded text, computed where the ids are made."""
    return _coded(docs, path, False)


def _coded(docs: DataFrame, path: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, "chunks")
        for batch in sliced(batches):
            ids = e.encode_chunked(texts_of(batch))
            decoded = [e.tokenizer.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in ids]
            if whole:
                made = {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
            else:
                made = {
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for d in decoded]),
                }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.values()], names=["doc_id", *made])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    made = "ids binary, decoded string" if whole else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, {made}")
