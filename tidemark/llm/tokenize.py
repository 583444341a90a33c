"""Encoding with public tokenizers.

White space separates tokens in word_bpe_49k (its pre-tokenizer drops it, its normalizer works on
characters), so a text's ids are the ids of its space-separated chunks in order. Each batch is cut into
chunks by Arrow, its distinct chunks are looked up in a bounded table of the worker, and those not there
are encoded together in a few long texts. Their ids are told apart by the word ends in the vocabulary,
and where that count does not come out even, each chunk is encoded by itself.
Tokenizers without word ends use whole_text=True.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import kept_by_worker

END_ID = 2
TABLE_LIMIT = 600_000  # chunks kept per Python worker; what comes later is encoded once per slice
SLICE_BYTES = 16 << 20  # text encoded at once
LONGEST_KEPT = 48  # characters; longer chunks are not kept
JOINED = 4096  # chunks encoded in one call
WORD_END = "</w>"
# Fixed value: how word_bpe_49k splits normalized text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_ENCODERS: dict[tuple, "Encoder"] = kept_by_worker({})


def _words(chunk: str) -> int:
    if chunk.isascii() and chunk.isalpha():
        return 1
    return len(WORD.findall(unicodedata.normalize("NFC", chunk).lower()))


class Encoder:
    def __init__(self, path: str, whole_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.whole_text = whole_text
        self.table: dict[str, bytes] = {"": b""}

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, chunks: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(chunks), add_special_tokens=False).ids, "<u4")
        after = np.cumsum([_words(c) for c in chunks])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != after[-1] or (len(ends) and ends[-1] != len(ids)):
            return [self.one(c) for c in chunks]
        flat, cut = ids.tobytes(), [0, *(4 * np.concatenate(([0], ends))[after]).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _of_chunks(self, chunks: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of different chunks. They are kept while the table has room; its last third is for those that occur often here."""
        new = [c for c in chunks if c not in self.table]
        alone = {c: self.one(c) for c in new if len(c) > LONGEST_KEPT or "<|" in c}
        new = [c for c in new if c not in alone]
        learnt: dict[str, bytes] = {}
        for i in range(0, len(new), JOINED):
            learnt.update(zip(new[i : i + JOINED], self._together(new[i : i + JOINED])))
        table = self.table
        if 3 * len(table) < 2 * TABLE_LIMIT:
            table.update(learnt)
        elif len(table) < TABLE_LIMIT:
            table.update((c, learnt[c]) for c, kept in zip(chunks, often.tolist()) if kept and c in learnt)
        learnt.update(alone)
        return [learnt[c] if c in learnt else table[c] for c in chunks]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in a row, and where each text's begin (one bound more than texts). Null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole_text:
            parts = [self.one(t) if t else b"" for t in texts.to_pylist()]
            flat, bounds = np.frombuffer(b"".join(parts), "<u4"), np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)))
        else:
            spaced = pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " ")
            split = pc.split_pattern(spaced, " ")
            coded = pc.dictionary_encode(split.flatten())
            which = coded.indices.to_numpy()
            values = self._of_chunks(coded.dictionary.to_pylist(), np.bincount(which, minlength=len(coded.dictionary)) > 1)
            size = np.fromiter(map(len, values), np.int64, len(values)) // 4
            pool, begin = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
            sizes = size[which]
            after = np.concatenate(([0], np.cumsum(sizes)))
            flat = pool[np.repeat(begin[which] - after[:-1], sizes) + np.arange(after[-1])]
            bounds = after[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if end_id is None:
            return flat, bounds
        bounds = bounds + np.arange(len(bounds))
        out, own = np.empty(bounds[-1], "<u4"), np.ones(bounds[-1], bool)
        own[bounds[1:] - 1] = False
        out[own], out[~own] = flat, end_id
        return out, bounds


def encoder(path: str, whole_text: bool = False) -> Encoder:
    """One per Python worker and tokenizer file."""
    key = (path, whole_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, whole_text)
    return _ENCODERS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
