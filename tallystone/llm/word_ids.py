"""Ids of whole texts by a word-level BPE file of the tokenizers library, with a bounded memo of words.

The file's normaliser and pre-tokeniser part a text into words that are merged alone, so a word's ids don't depend on its neighbours. Texts of
characters whose classes are certain are parted here and each new word goes to the library's model; any other text goes to the library whole. Files
whose settings are not those of PARTS are always used whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

from tallystone.llm.common import Memo

#: The settings under which words may be parted here (fixed values of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The last of the characters that are parted here. Of those up to it, capitals whose small letter lies beyond it are not.
CERTAIN = 0x24F


def _certain() -> list[str]:
    known = [*range(0x20, 0x7F), *range(0xA1, CERTAIN + 1)]
    return [*"\t\n\r", *(chr(c) for c in known if all(ord(x) <= CERTAIN for x in chr(c).lower()))]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _certain() if unicodedata.category(c)[0] == kind)


class WordIds:
    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.parts = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALISERS
            and split.get("pattern") == {"Regex": PATTERN}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        )
        letters, numbers = _class("L"), _class("N")
        # letters first: no other alternative begins with one
        self.find = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^ \t\n\r{letters}{numbers}]+").findall
        self.certain = re.compile(f"[{''.join(map(re.escape, _certain()))}]*").fullmatch
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.model = self.library.model
        self.bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.memo = Memo(self._word, limit)

    def _word(self, word: str) -> bytes:
        text = word if word.isascii() else self.bytes_as_text(word)[0][0]
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Unsigned 32-bit ids in the machine's order, which is little-endian wherever Spark runs."""
        if not self.parts or not self.certain(text) or any(s in text for s in self.specials):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.memo.__getitem__, self.find(text.lower())))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
