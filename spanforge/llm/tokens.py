"""Token ids by the tokenizers library, at the speed of a dictionary.

``word_bpe_49k.json`` normalises, cuts a text into pieces that never reach over
white space, and encodes each piece on its own; special tokens in a text are found
first. So a text's ids are those of its words in order, and the words of a task
repeat: their ids are kept in a dictionary of bounded size. A line in the plain range is put
in lower case and cut before full stops and commas at once, so that a word of other case or
with a sign at its end takes no place of its own. A word that isn't there is cut into its
pieces, which are kept as words. Each new piece is encoded by the
library's model;
words out of the plain range (other scripts, apostrophes, special tokens, white
space other than blank and newline) go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Latin letters up to U+024F and ASCII signs, but for the apostrophe, '<' (special tokens) and white space.
PLAIN = "!-&(-;=-~¡-įı-ɏ"
#: Words and pieces that are kept, at most, and the bytes that they hold together: their lengths and OVERHEAD for each.
MOST_WORDS, MOST_BYTES, OVERHEAD = 700_000, 128 << 20, 200


class _Known(dict):
    """The ids of words; what isn't there is asked for once."""

    def __init__(self, ask) -> None:
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        return self.ask(word)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """encode(text): the ids as bytes of little-endian unsigned ``width``-byte integers."""

    def __init__(self, path: str, most_words: int = MOST_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        # Each access to .model makes an object of its own, which costs as much as a short word's ids.
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most = most_words
        self.words, self.before = _Known(self._ask), {}
        self.held = 0
        # The characters that stand for bytes in the vocabulary.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        of = {c: "".join(x for x, _ in level.pre_tokenize_str(chr(c))) for c in range(0x80, 0x800)}
        self.letters = {byte: mapped[at] for c, mapped in of.items() for at, byte in enumerate(chr(c).encode())}
        self.piece = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.plain = regex.compile(f"[{PLAIN}]+")
        self.plain_line = re.compile(f"[ {PLAIN}]*")
        # A full stop or comma, and the blank after it, where a sign is before it: these are one piece.
        self.run = re.compile(r"[.,] (?<=[\W_]..)")

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def _ask(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self._word(word)
        self.words[word] = found
        self.held += len(word) + len(found) + OVERHEAD
        return found

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if word.islower() and word.isascii() and word.isalpha():
            return self._piece(word)
        if not word.isascii():
            plain = self.plain.fullmatch(word) and unicodedata.is_normalized("NFC", word)
        else:
            plain = word.isalpha() or self.plain.fullmatch(word)
        if not plain:
            return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        # A piece in lower case is a word itself, so that words of other case or with a sign at the end find it.
        if low.isalpha():
            return self._piece(low) if low == word else self.words[low]
        if low[:-1].isalpha():
            return self.words[low[:-1]] + self.words[low[-1]]
        pieces = self.piece.findall(low)
        return self._piece(low) if len(pieces) == 1 else b"".join(map(self.words.__getitem__, pieces))

    def _cut(self, text: str) -> Iterator[list[str]]:
        """The words of each line; in plain ones in lower case, and the sign at a word's end is one of its own."""
        for line in text.split("\n"):
            if self.plain_line.fullmatch(line):
                line = f"{line.lower()} "
                if not self.run.search(line):
                    line = line.replace(", ", " , ").replace(". ", " . ")
            yield line.split(" ")

    def encode(self, text: str | None) -> bytes:
        if self.held > MOST_BYTES // 2 or len(self.words) > self.most // 2:
            # Those that are asked for again come back, the others go the next time.
            self.words, self.before, self.held = _Known(self._ask), self.words, 0
        return b"".join(map(self.words.__getitem__, chain.from_iterable(self._cut(text or ""))))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    return WordEncoder(path)
