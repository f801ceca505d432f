"""Token ids of whole texts."""

from __future__ import annotations

import json
from array import array


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. An added token's string in a text is that token, as with the library's defaults.

    ``path`` is a byte-level BPE of the tokenizers library. Its merges run through tiktoken, which gives the same ids (ranks
    are ids in such files; tests compare both) at a third of the CPU time.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, added = _byte_letters(), {x["content"]: x["id"] for x in file["added_tokens"]}
        ranks = {bytes(letters[x] for x in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        self.bpe = tiktoken.Encoding("rivulet", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()

    def count(self, text: str) -> int:
        return len(self.bpe.encode(text, allowed_special="all"))
