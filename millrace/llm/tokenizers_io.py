"""Loading public tokenizer files inside Python workers; the file's name is a parameter everywhere."""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np


def tokenizer_path(name: str) -> str:
    """A full path stays; a bare name is looked up among the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_json(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@lru_cache(maxsize=4)
def load_ranks(name: str, special_from: str):
    """A byte-level vocabulary as ranks, with the special strings and ids of its .json form ``special_from``."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in load_json(special_from).get_added_tokens_decoder().items()}
    return tiktoken.Encoding(special_from, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """For every code point, whether it is without a category: libraries of different Unicode versions split texts with such differently."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def has_unassigned(text: str) -> bool:
    """Whether a text has such a code point, by one look at a table a character."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def byte_level_ids(text: str, tokenizer: str) -> np.ndarray:
    """The ids that the tokenizers library gives a whole text, special strings inside it as special ids.

    Its rank file, where there is one, gives the same ids several times faster, but for texts with
    unassigned code points and for those that its pattern engine gives up (very long runs of blanks): these go to the
    library.
    """
    ranks = f"{tokenizer.removesuffix('.json')}.tiktoken"
    if os.path.exists(tokenizer_path(ranks)) and not has_unassigned(text):
        try:
            return load_ranks(ranks, tokenizer).encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            pass
    return np.array(load_json(tokenizer).encode(text, add_special_tokens=False).ids, "<u4")
