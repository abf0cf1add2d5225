"""Byte-level BPE ids from a public tokenizer file, made once a Python worker."""

from __future__ import annotations

import json
import os
from functools import cache, cached_property

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def resolve(tokenizer: str) -> str:
    """A path stays; a bare name is looked up among the installed public tokenizers."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """The ids that the ``tokenizers`` library gives, by a faster path where that is equal.

    Ordinary text goes through the rank-based encoder over the same vocabulary.
    A text that holds one of the file's added tokens, or that the fast path cannot
    take, goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        table = _byte_of_char()
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        ranks = {bytes(table[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded by the few texts that need it."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except BaseException as raised:  # the native encoder panics on some texts; what it raises is no Exception
                if type(raised).__name__ != "PanicException":
                    raise
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def encoder(tokenizer: str = TOKENIZER) -> Encoder:
    return Encoder(resolve(tokenizer))
