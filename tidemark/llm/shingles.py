"""Word shingles of texts, hashed a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_set(words: list, size: int) -> set:
    """Distinct runs of `size` words; with fewer words the whole sequence is one; without words, none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def shingle_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    split = pc.ascii_split_whitespace(trimmed)
    coded = pc.dictionary_encode(split.flatten())
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = each[coded.indices.to_numpy()]
    bounds = split.offsets.to_numpy()
    bounds = bounds - bounds[0]
    empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    run = word
    for k in range(1, size):
        run = mixed(run[:-1] * _B + word[k:]) if len(run) > 1 else run[:0]
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if empty[i]:
            out.append(np.empty(0, np.uint64))
        elif b - a < size:
            out.append(np.array([xxhash.xxh64_intdigest(word[a:b].tobytes(), seed=size)], np.uint64))
        else:
            out.append(np.unique(run[a : b - size + 1]))
    return out
