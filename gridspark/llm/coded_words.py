"""Words of many texts as codes of a dictionary, by Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What stands between words: all of ASCII but digits and small letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``most`` bytes of text, or one longer text, each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


class CodedWords:
    """``codes[bounds[i]:bounds[i + 1]]`` are the words of text i as places in ``words``.

    Texts are lower-cased in A-Z only; nulls have no words.
    """

    __slots__ = ("bounds", "codes", "words")

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BREAKS)
        coded = pc.dictionary_encode(pc.list_flatten(parts))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        blank = pc.index(self.words, "").as_py()  # a text that starts or ends with a break
        solid = codes != blank
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        self.bounds = np.concatenate([[0], np.cumsum(solid)])[edges]
        self.codes = codes[solid]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def raw(self) -> list[bytes]:
        """The dictionary's words in UTF-8."""
        return self.words.cast(pa.binary()).to_pylist()
