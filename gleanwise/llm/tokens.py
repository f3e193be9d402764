"""Whole texts to token ids, word by word: what the tokenizers library gives for the whole text, faster.

The vocabulary's normaliser and splitter never look across white space, and white space gives no token, so a text's ids
are those of its words (runs without white space) one after the other. Words repeat; each worker keeps a bounded table
of words it has seen. Ids come as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

#: Words longer than this are not kept in the table.
LONG_WORD = 64

#: White space to the tokenizer (fixed value). Python's split() also cuts at \x1c to \x1f, which are symbols here.
WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE_RUN = re.compile(f"[{WHITE}]+")

#: Between ASCII characters, but for apostrophes and those of special tokens, a pre-token ends between letters and signs
#: and on either side of a digit, whatever stands around (fixed values): a text may be cut there.
_GRAPH, _SIGN, _LETTER = "[!-&(-;=?-{}~]", r"[!-&(-/:;=?@\[-`{}~]", "[A-Za-z]"
SAFE = rf"(?<=[0-9])(?={_GRAPH})|(?<={_GRAPH})(?=[0-9])|(?<={_LETTER})(?={_SIGN})|(?<={_SIGN})(?={_LETTER})"
CUT = re.compile(f"[{WHITE}]+|{SAFE}")


def words_of(text: str) -> list[str]:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in SPACE_RUN.split(text) if w]
    return text.split()


#: Signs that split off from letters before them as one pre-token, and a plain word: Latin letters of the first 256
#: characters, then such signs (fixed values).
_SIGNS = """.,!?;:*#$%&|"()"""
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([" + re.escape(_SIGNS) + "]*)")


#: A text of nothing but Latin letters, digits, white space and signs: its lower case has the same ids and fewer words.
_SIMPLE = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\s!-/:-@\[-`{-~]*", re.ASCII)

#: A run of signs other than the apostrophe: without apostrophes in the text, a pre-token of its own.
_SIGN_RUN = re.compile(r"[!-&(-/:-@\[-`{-~]+")


class _Words(dict):
    """Words with their ids; a new word is looked up as it is asked for.

    When half of `keep` words are in, they become the older half, and words that are asked for again move on from it.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.new_word(word)
        if len(word) <= LONG_WORD:
            if 2 * len(self) >= self.encoder.keep:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """One tokenizer file and the words seen so far, at most `keep` of them (about 200 bytes each)."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.keep = keep
        #: For words longer than `long_word`, if set: their ids by another way.
        self.long_word, self.long_ids = 0, None
        self.seen = _Words(self)
        self.number = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        self.symbols = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters if c == c.lower()}

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.number[i] for i in ids])

    def new_word(self, word: str) -> bytes:
        """Most new words are a plain word in other letters or before other signs: the letters are one pre-token, which
        the vocabulary's model takes in lower case and as symbols, and the signs another."""
        if self.long_ids and len(word) > self.long_word:
            return self.long_ids(word)
        if word.isascii():
            letters = word if word.isalpha() else word.rstrip(_SIGNS)
            plain = letters.isalpha()
        else:
            found = _PLAIN.fullmatch(word) if len(word) <= LONG_WORD else None
            plain, letters = found is not None, found and found[1]
        if not plain:
            return self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(letters) < len(word):
            return self.seen[letters.lower()] + self.seen[word[len(letters) :]]
        low = letters.lower()
        if low != letters:
            return self.seen[low]
        number = self.number
        return b"".join([number[t.id] for t in self.tokenize(low if low.isascii() else low.translate(self.symbols))])

    def encode_words(self, words: list[str]) -> list[bytes]:
        return list(map(self.seen.__getitem__, words))

    def prepared(self, text: str) -> str:
        """A text with the same ids and fewer different words, if it is plain."""
        if "<|" not in text and _SIMPLE.fullmatch(text):  # "<|" may begin a special token
            text = text.lower()
            if "'" not in text:
                text = _SIGN_RUN.sub(r" \g<0>", text)  # fewer words: none differ by their signs alone
        return text

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.seen.__getitem__, words_of(self.prepared(text)))) if text else b""


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so a worker holds the results of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
