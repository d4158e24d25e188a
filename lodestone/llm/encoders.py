"""Token ids by the tokenizers library, with each distinct word encoded once
per Python worker."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

from .common import kept
from .wordcache import WordCache

#: ASCII punctuation other than the apostrophe, which can begin a contraction.
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?!\n)")

#: Below it, letters have one form when normalised, and a lower case of one letter.
_LATIN_END = "\u0130"
#: Byte-level vocabularies write a printable Latin-1 byte as itself, the others, in order, as the characters from 256 on.
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_STAND_INS = {b: chr(b) for b in range(256)} | {b: chr(256 + i) for i, b in enumerate(_UNPRINTABLE)}


def _parts(text: str) -> str | list[str]:
    """The words of a text, as a list or as a text to be cut at each space: the
    first, and others that follow a space, or begin with a newline, which then
    is a pretoken of its own.

    Texts with several white-space characters in a row keep their newlines
    within words, and are cut only at spaces between other characters.
    """
    if not text[:1].isspace() and not _SPACES.search(text):
        return text.replace("\n", " \n")
    return _CUT.split(text)


def _stem(word: str) -> tuple[str, str]:
    """``word`` without final punctuation, and that punctuation, if a letter
    stands before it that stays one when normalised and lower-cased."""
    core = word.rstrip(_PUNCTUATION)
    if len(core) < len(word) and core:
        last = core[-1]
        if (last if last.isascii() else unicodedata.normalize("NFC", last).lower()[-1]).isalpha():
            return core, word[len(core) :]
    return word, ""


class WordEncoder:
    """Ids of whole texts as little-endian unsigned integers.

    The tokenizer itself encodes every distinct word; a text's ids are those of
    its words in order (see ``_parts``).  Punctuation at the end of a word, after a
    letter, is a pretoken of its own, and so is encoded apart.
    ``plain``: the tokenizer drops white space and lower-cases, so that words
    go without either.

    Strings of special tokens in a text are ordinary text, as the description
    of the vocabulary files sets it (``encode_special_tokens = True``).  With
    ``special`` they become the ids of their tokens, which is the library's own
    default: texts that hold one are then encoded whole.
    """

    def __init__(self, path: str, plain: bool = False, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if special else ()
        self.plain = plain
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.cache = WordCache(self.dtype, self._learn, None if plain else self._ids)

    def _ids(self, words: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for i in range(0, len(words), 4096):
            found += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        return found

    def _cores(self, words: list[str]) -> list[bytes]:
        """The ids of each word, with a space before it unless space is
        dropped or it begins with a newline.  A run of Latin letters is one
        pretoken, so the tokenizer's model takes it as it is, its bytes written
        as their stand-ins."""
        tokenize, space, newline = self.tokenizer.model.tokenize, "" if self.plain else _STAND_INS[32], self._ids(["\n"])[0]
        found = {}
        for word in words:
            opens = word[:1] == "\n"
            w = word[1:] if opens else word
            if w.isalpha() and (w.isascii() or max(w) < _LATIN_END):
                w = w.lower() if self.plain else w
                w = w if w.isascii() else w.encode().decode("latin-1").translate(_STAND_INS)
                ids = array(self.code, [t.id for t in tokenize(w if opens else space + w)]).tobytes()
                found[word] = newline + ids if opens else ids
        others = [w for w in words if w not in found]
        found.update(zip(others, self._ids([w if self.plain or w[:1] == "\n" else " " + w for w in others]), strict=True))
        return [found[w] for w in words]

    def _learn(self, words: list[str]) -> list[bytes]:
        cut = [_stem(w) for w in words]
        cores, tails = list({core for core, _ in cut}), list({tail for _, tail in cut})
        core_ids = dict(zip(cores, self._cores(cores), strict=True))
        tail_ids = dict(zip(tails, self._ids(tails), strict=True))
        return [core_ids[core] + tail_ids[tail] if tail else core_ids[core] for core, tail in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(map(t.__contains__, self.special))]
        if whole:
            texts = list(texts)
            for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                texts[i] = ids
            others = iter(self.encode([t for t in texts if isinstance(t, str)]))
            return [next(others) if isinstance(t, str) else t for t in texts]
        return self.cache.encode([t.replace("\n", " ") if self.plain else _parts(t) for t in texts])


def word_encoder(path: str, plain: bool = False, special: bool = False) -> WordEncoder:
    """One encoder per worker process and vocabulary file, until the worker
    turns to another stage."""
    return kept(("words", path, plain, special), lambda: WordEncoder(path, plain, special))
