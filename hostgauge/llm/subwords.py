"""Subword ids of whole texts with a public byte-level vocabulary.

The ids are those that the ``tokenizers`` library gives for the same vocabulary
(the tests compare them); the vocabulary is read in its
form as ranks because that encoder is several times faster on one core.
"""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
import tiktoken.registry

VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed values: the tokens that the same vocabulary adds in its form for ``tokenizers``
ADDED = (("<|endoftext|>", 50256),)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str, special: tuple = ()) -> tiktoken.Encoding:
    # kept where the library keeps its own, which outlives a task: a worker reads the file once
    known = tiktoken.registry.ENCODINGS
    name = f"{path} {special}"
    if name not in known:
        import public_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        known[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
    return known[name]


class Subwords:
    """``special``: (string, id) pairs of tokens that stand for themselves wherever a whole text holds them, as the
    vocabulary's ``tokenizers`` form has them; in words they are ordinary. ``size``: number of ids."""

    def __init__(self, path: str, special: tuple = ()):
        self._encoding = _encoding(path, special)
        self._special = {token for token, _ in special}
        self.size = self._encoding.n_vocab

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return self._encoding.encode_to_numpy(text, allowed_special=self._special, disallowed_special=())

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word with a space before it."""
        encode = self._encoding.encode_ordinary
        return [encode(" " + w.decode()) for w in words]

    def begins_word(self) -> np.ndarray:
        """Which ids start with a space."""
        return np.array([self._encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.size)])
