"""Access to the public tokenizer files; their path is a parameter, nothing is copied.

``ids_of(path)`` gives the encoder for a byte-level BPE ``.json`` file: the ids of the `tokenizers` library
without added special tokens, special strings inside texts handled as that library does by default.  Where a
rank file with the same stem lies beside the ``.json`` file and the text holds no special string, the same ids
come from `tiktoken`, which is several times faster; the equality is tested.
"""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np

from hinloom.llm.common import safe_pieces

# Texts are encoded in pieces of this many characters, cut where the result cannot change.
PIECE_CHARS = 1 << 16

# A stretch without a safe cut above this length goes to the `tokenizers` library, whose pattern engine has no
# step limit.
LONGEST_STRETCH = 1 << 18


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    def __init__(self, path: str):
        self.path = path
        with open(path) as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            tokens = read_ranks(ranks)
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={}
            )
            self.lengths = np.zeros(max(tokens.values()) + 1, np.int64)
            for token, number in tokens.items():
                self.lengths[number] = len(token)

    @functools.cached_property
    def library(self):
        """The `tokenizers` object, loaded where it is first needed: it takes much memory."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= PIECE_CHARS:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        parts = []
        for piece in safe_pieces(text, PIECE_CHARS):
            if len(piece) > LONGEST_STRETCH:
                parts.append(np.array(self.library.encode(piece, add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self.fast.encode_to_numpy(piece, disallowed_special=()))
        return np.concatenate(parts)

    def spans(self, text: str) -> np.ndarray:
        """Where each token starts, in characters of the text; inside a character, where that one starts."""
        if self.fast is None or len(text) > LONGEST_STRETCH or any(s in text for s in self.special):
            offsets = self.library.encode(text, add_special_tokens=False).offsets
            return np.array([start for start, _ in offsets], np.int64)
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        if text.isascii():
            return starts
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first) - 1)[starts]

@functools.cache
def ids_of(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)
