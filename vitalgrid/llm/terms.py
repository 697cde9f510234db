"""Terms of whole texts as Arrow dictionaries and numpy codes, a bounded piece of a batch at a time.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered. Null has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vitalgrid.llm import hashing

# What separates terms once A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Piece(NamedTuple):
    """Some rows of a batch: terms in order, as (row within the piece, code), and the distinct terms by code."""

    first: int
    rows: int
    row: np.ndarray
    code: np.ndarray
    terms: pa.Array


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """The terms of a string column; a piece has about two megabytes of text, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    _, bounds = hashing.utf8(texts)
    for first, last in hashing.groups_of_rows(bounds):
        split = pc.split_pattern_regex(pc.ascii_lower(texts.slice(first, last - first)), SEPARATORS)
        flat = pc.list_flatten(split)
        row = np.repeat(np.arange(last - first), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        full = pc.not_equal(flat, "")
        coded = flat.filter(full).dictionary_encode()
        yield Piece(
            first, last - first, row[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(), coded.dictionary
        )
