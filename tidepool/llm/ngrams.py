"""Hashed character n-grams and words of whole texts, as bucket numbers with one range for each kind.

N-grams are taken over the code points of a text with A-Z lower-cased, across word ends; words are
those of ``textbuf``, and each word also counts as one that equals the word before it, or as one that
does not. ``sums`` adds a weight a bucket over each document; ``sparse`` lists the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from tidepool.llm.textbuf import LOWER, Words, text_buffers

U32 = np.uint32
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], U32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with A-Z lower-cased, document bounds) of UTF-8 texts."""
    low = LOWER[data]
    chars = np.frombuffer(low.tobytes().decode("utf-8").encode("utf-32-le"), U32)
    return chars, offsets if len(chars) == len(data) else np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]


class Buckets:
    """``sizes`` of n-grams in characters, and whether words count; each kind has 2**bits buckets."""

    def __init__(self, sizes: tuple[int, ...], bits: int, words: bool):
        self.sizes, self.bits, self.words = sizes, bits, words
        self.total = ((len(sizes) + words) << bits) + 2 * words

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind: bucket numbers, and where each document's stretch begins and ends."""
        low, bounds = characters(data, offsets)
        for k, n in enumerate(self.sizes):
            size = max(0, len(low) - n + 1)
            h = low[:size] * _FACTORS[0]
            for j in range(1, n):
                h ^= h >> U32(13)
                h *= _FACTORS[-j]
                h += low[j : j + size] * _FACTORS[j]
            h ^= h >> U32(15)
            h *= U32(0x2C1B3C6D)
            yield (h >> U32(32 - self.bits)).astype(np.int32) + (k << self.bits), np.minimum(bounds[:-1], size), np.maximum(np.minimum(bounds[1:] - n + 1, size), np.minimum(bounds[:-1], size))
        if self.words:
            words = Words(data, offsets)
            hashes = words.hashes(lower=True)
            yield (hashes >> np.uint64(64 - self.bits)).astype(np.int32) + (len(self.sizes) << self.bits), words.first[:-1], words.first[1:]
            same = np.zeros(len(hashes), np.int32)
            same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
            yield same + ((len(self.sizes) + 1) << self.bits), words.first[:-1], words.first[1:]

    def sums(self, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x columns sums of ``weights`` (buckets x columns) over occurrences, occurrences a document)."""
        out, count = np.zeros((len(offsets) - 1, weights.shape[1])), np.zeros(len(offsets) - 1)
        columns = [np.ascontiguousarray(weights[:, c], np.float64) for c in range(weights.shape[1])]
        for at, starts, ends in self(data, offsets):
            count += ends - starts
            run = np.zeros(len(at) + 1)
            for c, w in enumerate(columns):
                np.cumsum(w[at], out=run[1:])
                out[:, c] += run[ends] - run[starts]
        return out, count

    def sparse(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document its buckets and how often each occurs; counts take two bytes each where all of a document's fit, else eight."""
        parts: list[list] = [[] for _ in offsets[1:]]
        for at, starts, ends in self(data, offsets):
            for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                parts[d].append(at[a:b])
        out = []
        for p in parts:
            values, counts = np.unique(np.concatenate(p), return_counts=True)
            out.append((values.astype(np.int32), counts.astype(np.uint16) if counts.max(initial=0) <= 0xFFFF else counts.astype(np.int64)))
        return out


SAMPLE = "at binary, times binary"


def sample_columns(buckets: Buckets, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The buckets and counts of a batch's texts as the columns of SAMPLE."""
    made = buckets.sparse(*text_buffers(batch.column("text")))
    return {"at": pa.array([m[0].tobytes() for m in made], pa.binary()), "times": pa.array([m[1].tobytes() for m in made], pa.binary())}


class Shares(Sequence):
    """(buckets, their shares of all occurrences) of each row of a collected sample, in the given order; made from the bytes on use."""

    def __init__(self, sample: pa.Table, order: list[int]):
        self.at, self.times, self.order = sample.column("at").combine_chunks(), sample.column("times").combine_chunks(), order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i >= len(self.order):
            raise IndexError(i)
        at = np.frombuffer(self.at[self.order[i]].as_buffer(), np.int32)
        raw = self.times[self.order[i]].as_buffer()
        times = np.frombuffer(raw, np.uint16 if raw.size == 2 * len(at) else np.int64)
        return at, times.astype(np.float32) / np.float32(max(1, int(times.sum(dtype=np.int64))))
