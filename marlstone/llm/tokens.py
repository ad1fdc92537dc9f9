"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Texts with other characters, with the special string, or with a run of one kind so long that the quick library's
#: pattern would run out of stack go to the library the vocabulary is made for. For all others both split and merge
#: alike (a test goes over every pair of such characters).
_RARE = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")
_RUN, _LONG = 4000, re.compile(r"(?<!\S)\S{4000}|(?<!\s)\s{4000}")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _quick(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text without added special tokens; none for null or empty."""
    if not text:
        return np.zeros(0, "<u4")
    if not _RARE.search(text) and not (len(text) >= _RUN and _LONG.search(text)):
        return np.array(_quick(vocabulary_path(f"{vocabulary}.tiktoken")).encode_ordinary(text), "<u4")
    ids = _exact(vocabulary_path(f"{vocabulary}.json")).encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")
