"""Token ids by the ``tokenizers`` library, with each distinct word of a batch encoded once.

Byte-level BPE never merges across the pieces its pre-tokenizer cuts, and a cut always lies before a single space and before
and after a single newline that stand between other characters, and between a letter and a full stop or the like. So texts
are cut there by Arrow, words are numbered by
Arrow's dictionary encoding, and the ids of a batch are gathered from those of its distinct words. Words not met before go
through the library ``JOINED`` to a text; its ids are dealt back by the tokens that begin with the space or are the newline.
Texts with other white space, runs of it, white space at an edge, or the string of a special token are encoded whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JOINED, CALL = 64, 128
#: Stands, after a space put in, before what follows a letter directly.
GLUE = "\x01"
#: Bytes of text that one call of ``encode_flat`` gets from ``batches_of``.
BATCH_BYTES = 6_000_000
#: Words that an encoder remembers.
WORDS = 400_000
_loaded: dict[str, "WordEncoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """most: distinct words kept in memory for later batches; beyond it only those of the last batch."""

    def __init__(self, path: str, most: int = WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the sign put before glued parts; white space but space and newline, two of these, or one at an edge; RE2's classes
        marks = [GLUE, r"[\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z", *map(re.escape, special)]
        self.odd = "|".join(marks)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come once only
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(names.values()) + 1, bool)
        # the format's signs for a space (before a word) and a newline (a token of its own)
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.line = names["Ċ"]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _dealt(self, words: list[str], texts: list[str], starts: np.ndarray | int) -> list[bytes]:
        """Ids of each word from those of the joined texts, which begin a word at each token of ``starts``."""
        out: list[bytes] = []
        for i in range(0, len(texts), CALL):
            some = words[i * JOINED : (i + CALL) * JOINED]
            ids = np.frombuffer(b"".join(self.whole(texts[i : i + CALL])), np.uint32)
            at = np.flatnonzero(starts[ids] if isinstance(starts, np.ndarray) else ids == starts)
            if len(at) != len(some):
                out += self.whole([w if w[:1] == "\n" else " " + w for w in some])
                continue
            flat, edges = ids.tobytes(), (at * 4).tolist()
            out += [flat[a:b] for a, b in zip(edges, [*edges[1:], len(flat)])]
        return out

    def _learn(self, new: list[str]) -> None:
        glued = [w for w in new if w[:1] == GLUE]
        self.known.update(zip(glued, self.whole([w[1:] for w in glued])))
        lines = [w for w in new if w[:1] == "\n"]
        words = [w for w in new if w[:1] not in ("\n", GLUE)]
        joined = [" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        self.known.update(zip(words, self._dealt(words, joined, self.opens)))
        joined = ["".join(lines[i : i + JOINED]) for i in range(0, len(lines), JOINED)]
        self.known.update(zip(lines, self._dealt(lines, joined, self.line)))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word, or of the word itself where it begins with its newline or, without the sign, is glued."""
        self._learn([w for w in words if w not in self.known])
        found = list(map(self.known.__getitem__, words))
        if len(self.known) > self.most:
            self.known = dict(zip(words, found))
        return found

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of texts that can be cut at their single spaces and newlines."""
        # the newline put before each text makes its first word one of a line's first; its id is left out again
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type)), "\n", " \n")
        cut = pc.split_pattern(pc.replace_substring_regex(lines, r"(\pL)([.,;:!?])", rf"\1 {GLUE}\2"), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # each text begins with an empty word, before the space put in: it has no ids
        ids = [x if w else b"" for w, x in zip(words, self._ids_of(words))]
        placed = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[placed.offset : placed.offset + len(placed) + 1] // 4
        flat = np.frombuffer(placed.buffers()[2] or b"", np.uint32)
        edges = ends[np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()]
        return np.concatenate([flat[a + 1 : b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]), np.diff(edges) - 1

    def encode_flat(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts end to end, and the number of ids of each."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(texts), pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        strange = pc.match_substring_regex(texts, self.odd)
        odd = pc.indices_nonzero(strange).to_pylist()
        if not odd:
            return self._plain(texts)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = pc.indices_nonzero(pc.invert(strange))
        if len(plain):
            flat, n = self._plain(texts.take(plain))
            for i, ids in zip(plain.to_pylist(), np.split(flat, np.cumsum(n)[:-1])):
                parts[i] = ids
        for i, ids in zip(odd, self.whole([texts[i].as_py() for i in odd])):
            parts[i] = np.frombuffer(ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        flat, n = self.encode_flat(texts)
        return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []

    def encode_ended(self, texts: Sequence[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_flat, with end_id after each text."""
        flat, n = self.encode_flat(texts)
        out, inside = np.full(len(flat) + len(n), end_id, np.uint32), np.ones(len(flat) + len(n), bool)
        inside[np.cumsum(n + 1) - 1] = False
        out[inside] = flat
        return out, n + 1


def batches_of(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text (or one row of more)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(ends, done + most - size, side="right")), lo + (not held))
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                size += int(ends[hi - 1] - done)
            lo = hi
            if lo < b.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def give_back() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(batches: Iterator[pa.RecordBatch], keep: bool = True) -> Iterator[pa.RecordBatch]:
    """The batches a task makes. A worker goes on with other tasks: it gives back what those before have left, and in the end, unless keep, its encoders' words."""
    give_back()
    yield from batches
    if not keep:
        for e in _loaded.values():
            e.known = {}
        give_back()


def encoder(path: str, most: int = WORDS) -> WordEncoder:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path, most)
    _loaded[path].most = most
    return _loaded[path]
