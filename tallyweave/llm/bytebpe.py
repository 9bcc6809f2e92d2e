"""Byte-level BPE: vocabularies, and ids of whole texts.

Files of vocabularies are parameters. A file must lie at the same path on every
executor, as an installed package does.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# Distinct words whose ids a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000
# Below this code point both libraries agree on what is a letter, number or space.
COMMON = "ɐ"
_DOUBLE_SPACE = regex.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file with a base64 token and an id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that tokenizer files use for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a tokenizer's JSON; its added tokens are left out."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    added = {token["content"] for token in made.get("added_tokens", ())}
    byte = _byte_of_char()
    return {
        bytes(byte[c] for c in token): rank
        for token, rank in made["model"]["vocab"].items()
        if token not in added
    }


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, added: bool = False) -> Encoder:
    """The encoder of a vocabulary, made once per worker."""
    return Encoder(path, pattern, added)


class Encoder(dict):
    """Ids of texts; as a dictionary, the packed ids of words it has met.

    A place where white space follows something else always parts two pre-tokens
    that do not see each other, so a text with no two white spaces in a row is
    cut there and each word's ids are looked up. Other texts go through whole.
    Words with rarer scripts go through the JSON file's own tokenizer.

    Strings of added tokens are ordinary text, or with ``added`` they become the
    ids that the JSON file's tokenizer gives them: texts that hold one go through it.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        super().__init__()
        is_json = path.endswith(".json")
        self.ranks = read_json_ranks(path) if is_json else read_ranks(path)
        top = max(self.ranks.values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.tokenizer, self.added = None, None
        if is_json:
            self.tokenizer = Tokenizer.from_file(path)
            known = self.tokenizer.get_added_tokens_decoder()
            self.tokenizer.encode_special_tokens = not added
            if added and known:
                top = max(top, *known)
                self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
                self.added = regex.compile("|".join(regex.escape(t.content) for t in known.values()))
        self.bpe = tiktoken.Encoding(
            "given", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}
        )

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self[word] = self._whole(word if word[:1] == "\n" else " " + word)
        return packed

    def _whole(self, text: str) -> bytes:
        if self.tokenizer is None or text.isascii() or max(text) < COMMON:
            ids = self.bpe.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def packed(self, text: str) -> bytes:
        """All ids of the text, little-endian, each as wide as ``kind``."""
        if not text:
            return b""
        if self.added and self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, self.kind).tobytes()
        if text[0].isspace() or _DOUBLE_SPACE.search(text):
            return self._whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self._whole(first) + b"".join(map(self.__getitem__, words))


def token_table(path: str) -> list[bytes]:
    """Bytes of each id."""
    ranks = read_json_ranks(path) if path.endswith(".json") else read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table
