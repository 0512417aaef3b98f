"""The public tokenizer's vocabulary file, and texts as token streams."""

from __future__ import annotations

import numpy as np

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file's place on this machine, from the tokenizer package all workers have."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_ends(ids: np.ndarray, ends: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with ``end`` behind each text, or as they are, and where each text ends."""
    if end is None:
        return ids, ends
    return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
