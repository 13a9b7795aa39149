"""Byte-level BPE ids exactly as the tokenizers library gives them, made with whichever library is quicker for a text."""

from __future__ import annotations

import functools
import json

import numpy as np

#: Runs without a blank, or of blanks, that are longer than twice this go to the library that merges them in n log n.
RUN = 500


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bpe:
    """Encoder and decoder of one tokenizer file; special tokens in a text become their ids, nothing is added."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]    # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.quick = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = [b""] * self.size
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes[i] = t
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > RUN and (any(text.find(" ", at, at + RUN) < 0 for at in range(0, len(text) - RUN, RUN))
                                or " " * RUN in text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.quick.encode_to_numpy(text, allowed_special="all")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def bpe(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)
