"""Whole-text token ids by the tokenizers library, with a bounded word memo.

In a byte-level BPE whose pre-tokenizer lets a single blank open the next word,
a text's ids are those of its blank-separated words, each but the first with its
blank.  Equal words then need the library once.  That holds only where no blank
is followed by white space or ends the text; other texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from string import punctuation

import numpy as np

#: Words a worker remembers at most.
MEMO_WORDS = 200_000
#: Longer words seldom return and are not remembered.
MEMO_CHARS = 12
SEEN_SLOTS = 1 << 22
_UNSAFE = re.compile(r" \s| \Z")


#: Letters below this are letters to every Unicode version in use.
_LAST = "\u0250"


def _byte_chars() -> dict[int, str]:
    """The printable character that a byte-level vocabulary has for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class _Memo(dict):
    """Word to ids as bytes; a word that it lacks is encoded when it is asked for."""

    def __init__(self, encoder: Encoder, first: _Memo | None):
        blank = first is not None
        self.seen = bytearray(SEEN_SLOTS)  # a word is remembered from its second time on
        self.first = self if first is None else first
        self.tokenize = encoder.tokenizer.model.tokenize
        self.library, self.runs = encoder.library, encoder.runs
        self.of_id, self.letters_whole = encoder.of_id, encoder.letters_whole
        self.blank, self.lead = " " * blank, _BYTE_CHARS[32] * blank

    def __missing__(self, word: str) -> bytes:
        bare = word.rstrip(punctuation)
        head, line_end, rest = word.partition("\n")
        if self.letters_whole and line_end and head and not (head[-1].isspace() or rest[:1].isspace()):
            # a lone line end is a piece of its own, and what follows it has no blank
            ids = self[head] + self.runs[line_end] + (self.first[rest] if rest else b"")
        elif self.letters_whole and bare.isalpha() and (bare.isascii() or max(bare) < _LAST):
            # letters are one piece of the pre-tokenizer, the marks after them another
            shown = bare if bare.isascii() else bare.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = b"".join([self.of_id[t.id] for t in self.tokenize(self.lead + shown)])
            if len(bare) < len(word):
                run = word[len(bare) :]
                if run not in self.runs:
                    self.runs[run] = self.library([run])[0]
                ids += self.runs[run]
                if len(self.runs) > 10_000:
                    self.runs = {"\n": self.runs["\n"]}
        else:
            ids = self.library([self.blank + word])[0]
        if len(word) <= MEMO_CHARS and len(self) < MEMO_WORDS:
            at = hash(word) & (SEEN_SLOTS - 1)
            if self.seen[at]:
                self[word] = ids
            self.seen[at] = 1
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.separable = not any(" " in t.content or t.lstrip or t.rstrip for t in added)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Letters, with the blank before them, are one piece of the pre-tokenizer.
        self.letters_whole = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and bool(pre.get("use_regex"))
            and not pre.get("add_prefix_space")
            and not any(t.content.isalpha() or not t.content.strip(punctuation) for t in added)
        )
        self.of_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.runs = {"\n": self.library(["\n"])[0]}
        self.first = _Memo(self, None)
        self.inner = _Memo(self, self.first)

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        first, inner = self.first.__getitem__, self.inner.__getitem__
        whole = []
        for i, t in enumerate(texts):
            if t and self.separable and not _UNSAFE.search(t):
                words = t.split(" ")
                out[i] = first(words[0]) + b"".join(map(inner, words[1:]))
            elif t:
                whole.append(i)
        for i, ids in zip(whole, self.library([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, special_as_text)


def default_tokenizer() -> str:
    """The public byte-level BPE file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
