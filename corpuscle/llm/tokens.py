"""Token ids by the tokenizers library, remembered word by word.

Where the tokenizer's own splitting never joins text over white space (KNOWN), a text's ids are the ids of its
white-space-separated parts in order. A worker remembers parts in two generations of MEMO bytes each: when the young one
is full it becomes the old one, and a part met again moves back to the young, so usual parts stay and memory is bounded.
Parts of plain letters go to the library's BPE model directly, the rest through its whole pipeline. Any other tokenizer
encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
MEMO = 72 << 20  # bytes, of each of two generations
ENTRY = 180  # bytes an entry of a dictionary takes besides its contents
#: The normalizer and pre-tokenizer that make encoding by parts right.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LATIN = re.compile(r"[a-zß-öø-ÿ]+")
_TAILED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-;=?@\[-`}~]+)")
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]
_encoders: dict[str, "Encoder"] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder(dict):
    """Part of a text (UTF-8) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.room = MEMO
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.tokenize = self.model.tokenize
        self.letters = _byte_letters()
        config = json.loads(self.whole.to_str())
        added = [t["content"] for t in config["added_tokens"]]
        self.by_parts = config["model"]["type"] == "BPE" and all(config[k] == v for k, v in KNOWN.items()) and all(t.startswith("<|") and len(t.split()) == 1 for t in added)

    def _by_library(self, part: bytes) -> bytes:
        ids = self.whole.encode(part.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_model(self, letters: str) -> bytes:
        ids = [t.id for t in self.tokenize(letters)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: bytes) -> bytes:
        out = self.old.get(part)
        if out is None:
            if len(part) > 200:
                return self._by_library(part)  # rare and long: not worth remembering
            if part.isalpha() and part.islower():  # of bytes: ASCII letters alone
                out = self._by_model(part.decode())
            elif (m := _TAILED.fullmatch(part)) and _LATIN.fullmatch(m[1].decode().lower()):
                out = self[m[1]] + self[m[2]]
            elif not part.isascii() and _LATIN.fullmatch(text := part.decode().lower()):
                out = self._by_model("".join([self.letters[b] for b in text.encode()]))
            else:
                out = self._by_library(part)
        self.room -= len(part) + len(out) + ENTRY
        if self.room <= 0:
            self.old, self.room = dict(self), MEMO
            self.clear()
        self[part] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if not self.by_parts:
            return self._by_library(text)
        if b"<|" not in text:  # special tokens are matched before letters are lowered
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
