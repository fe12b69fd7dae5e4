"""Two public tokenizers as bytes: ids of a text, and the bytes of each id. The files must be at the same path on all machines."""

from __future__ import annotations

import json
from functools import lru_cache

#: Where the byte-level vocabulary's 256 symbols lie: these bytes stand for themselves, the rest, in order, from U+0100 on.
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Fixed value: the pattern that splits a text before merges of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to which a text goes to the faster of two encoders with equal results; the other one's time per
#: character does not depend on how long a run without breaks is.
QUICK = 200_000


def byte_of_symbol() -> dict[str, int]:
    rest = (b for b in range(256) if b not in set(PRINTED))
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The byte-level BPE of a tokenizers JSON file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols, special = byte_of_symbol(), {t.content for t in self.slow.get_added_tokens_decoder().values()}
        known = {k: i for k, i in model["vocab"].items() if k not in special}
        self.bytes: list[bytes] = [b""] * (max(self.slow.get_vocab().values()) + 1)
        for k, i in known.items():
            self.bytes[i] = bytes(symbols[c] for c in k)
        self.quick = self._quick(model, known)

    def _quick(self, model: dict, known: dict[str, int]):
        """The same vocabulary by ranks, if each merge makes the entry with the next id; otherwise none."""
        pairs = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        made = [known.get(p) for p in pairs]
        if made != list(range(256, 256 + len(made))) or len(known) != 256 + len(made):
            return None
        import tiktoken

        return tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks={self.bytes[i]: i for i in known.values()}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.quick is not None and len(text) <= QUICK:
            return self.quick.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """The BPE with byte fallback of a sentencepiece model; it puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.model.get_piece_size()) for p in [self.model.id_to_piece(i)]]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(2)
def loaded(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    """Both, once for each worker."""
    return ByteLevel(byte_level), Pieces(pieces)
