"""Token ids of a byte-level BPE vocabulary, with the words of a text encoded once per task.

``vocabulary`` is the path of a ``tokenizers`` file with the GPT-2 word pattern; it must exist on every worker.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

#: Words held per task; further words are encoded each time they occur.
CACHED_WORDS = 400_000

# Characters whose Unicode class never changed, so that the pattern below splits as the tokenizer does.
_COMMON = "\t\n\r\x0b\x0c -~¡-ɏ‐-‧‰-⁞€"
_UNCOMMON = re.compile(f"[^{_COMMON}]")
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


def _ranks(vocabulary: str) -> dict[bytes, int]:
    """The vocabulary by bytes; its ids are also the order of the merges."""
    with open(vocabulary, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["id"] for t in data["added_tokens"]}
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if i not in special}


class Encoder(dict):
    """Maps a word to its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        if not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError(f"{vocabulary} is not a byte-level vocabulary")
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that the words alone can't tell: signs beyond the common ones, or a token that is matched as a whole.
        self.whole = re.compile("|".join([_UNCOMMON.pattern, *map(re.escape, added)]))
        self.word_ids = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(vocabulary), special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.word_ids.encode_ordinary(word), "<u4").tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the unchanged tokenizer gives them with ``add_special_tokens=False``."""
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _WORD.findall(text)))
