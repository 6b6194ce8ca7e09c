"""Byte-level BPE ids by the tokenizers library, with one library call for each distinct new pre-token."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

#: Distinct words, and distinct pre-tokens, whose ids a worker keeps.
KEPT, KEPT_PARTS = 600_000, 400_000
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"


class _Words(dict):
    """Ids of words that follow a space and hold none; a missing one is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(" " + word)
        self[word] = found
        return found


class ByteBpe:
    """encode(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, as little-endian unsigned integers.

    The byte-level pre-tokenizer always starts a new pre-token at a space that a non-space follows, and no merge crosses
    pre-tokens. So a text is cut there and words seen before come from a dictionary. A new word of printable ASCII, line
    ends and Latin letters is cut into the pre-tokens that the library's pattern makes of it, and the library's model
    merges those not seen before. Other words go through the whole library, as do texts with runs of white space or with
    special tokens, and everything where the file asks for another normalisation or cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.model._resize_cache(0)  # every pre-token comes once
        self.library.model = self.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        n = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.kept = _Words(self._word)
        self.parts: dict[str, bytes] = {}
        self.blank = re.compile(r" (?:\s|$)")
        made = json.loads(self.library.to_str())
        cut = made["pre_tokenizer"] or {}
        self.plain = made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not made["model"].get("dropout")
        # words for which the pre-tokenizer's pattern needs no table of Unicode classes, and that pattern for them
        self.known = re.compile(f"[ !-~\n{_LETTERS}]*").fullmatch
        self.cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|\n+(?![^\n])|\n+").findall
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]
        self.coded = [i.to_bytes(self.type.itemsize, "little") for i in range(n)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.type).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it, if any; no other space is in it."""
        if not self.plain or not self.known(word):
            return self._whole(word)
        found, parts, coded = [], self.parts, self.coded
        for part in self.cut(word):
            ids = parts.get(part)
            if ids is None:
                if part.isascii():  # only a space and line ends don't stand for themselves
                    shown = part.replace(" ", self.alphabet[32]).replace("\n", self.alphabet[10])
                else:
                    shown = "".join([self.alphabet[b] for b in part.encode()])
                ids = parts[part] = b"".join([coded[t.id] for t in self.model.tokenize(shown)])
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.blank.search(text) or any(s in text for s in self.specials):
            return self._whole(text)
        if len(self.kept) > KEPT:
            self.kept.clear()
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        words = text.split(" ")
        return self._word(words[0]) + b"".join(map(self.kept.__getitem__, words[1:]))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.type)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
