"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's path is a parameter; no tokenizer is trained."""

from __future__ import annotations

import functools

import numpy as np

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_ids(texts: list[str], path: str = TOKENIZER) -> list[list[int]]:
    """Token numbers of each whole text."""
    # lone surrogates can't be written as UTF-8 and count as the replacement sign
    clean = [t.encode("utf-8", "replace").decode("utf-8") if not t.isascii() else t for t in texts]
    return _processor(path).encode(clean, num_threads=1)


def token_counts(texts: list[str], path: str = TOKENIZER, at_once: int = 256) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for a in range(0, len(texts), at_once):
        out[a : a + at_once] = [len(x) for x in token_ids(texts[a : a + at_once], path)]
    return out
