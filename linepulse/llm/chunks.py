"""The tokenizers library over whole texts, by remembered chunks.

A text is cut before each run of white space that follows other characters.  The pre-split patterns of both
byte-level and word-level files never join a character to white space after it, and the library's
normalisers (NFC, white space, lower case) do not look across that cut, so the ids of a text are the ids of
its chunks, one after another.  Special strings hold no white space and stay inside one chunk.  Only chunks
not seen before go through the library; a worker remembers two generations of a bounded number of them, and
results do not depend on what is remembered.

A chunk that is a plain Latin word with plain marks behind it is two pieces for either pattern; the pieces
go straight to the library's model, so that "word", "word," and "word." share one entry.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from operator import itemgetter

from linepulse.llm.common import per_worker

MAX_CHUNKS = 400_000   # remembered chunks a generation
PACKED = 650_000       # the same where words and pieces share one memory
LONGEST = 64           # longer chunks are encoded each time

# the characters of Unicode's White_Space property (fixed values)
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD = re.compile(f"[^{WHITE}]+")
# letters that are one NFC code point and have a plain lower case; marks that no pattern treats by themselves
PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# characters whose lower case does not depend on their neighbours and is one NFC code point
SIMPLE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch


class Remembered(dict):
    """chunk -> value; ``make`` gives the value of a chunk not remembered."""

    def __init__(self, make: Callable, size: int = MAX_CHUNKS):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
            if len(chunk) > LONGEST:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies spell bytes: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@per_worker
def library(path: str):
    """The library's tokenizer, one per worker, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def chunk_ids(tokenizer, lower: bool, code: str) -> Callable[[str], bytes]:
    """A function that gives the ids of a chunk as bytes (array type ``code``).

    lower: the file lower-cases and drops white space.
    """
    spell = dict(zip(byte_letters().values(), byte_letters()))
    model, encode = tokenizer.model, tokenizer.encode
    odd = any(PLAIN(t.content) for t in tokenizer.get_added_tokens_decoder().values())   # a special string like a word

    def whole(chunk: str) -> bytes:
        return array(code, encode(chunk, add_special_tokens=False).ids).tobytes()

    def piece(p: str) -> bytes:
        p = p if p.isascii() and p[0] != " " else "".join([spell[b] for b in p.encode()])
        return array(code, [t.id for t in model.tokenize(p)]).tobytes()

    pieces = Remembered(piece)

    def ids(chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if lower and core.isascii() and core.isalpha():
            marks = chunk[len(core):]
            return pieces[core.lower()] + pieces[marks] if marks else pieces[core.lower()]
        m = PLAIN(chunk)
        if m is None:
            return whole(chunk)
        lead, word, marks = m.groups()
        head = pieces[word.lower() if lower else lead + word]
        return head + pieces[marks] if marks else head

    return whole if odd else ids


@per_worker
def counter(path: str) -> Callable[[str], int]:
    """Token count of a whole text for a byte-level file."""
    ids = chunk_ids(library(path), lower=False, code="I")
    known = Remembered(lambda c: len(ids(c)) // 4)
    return lambda text: sum(map(known.__getitem__, CHUNK.findall(text)))


class Words(Remembered):
    """Remembered ids of chunks of a file that lower-cases and drops white space; "word", "word," and "Word" share what they have in common."""

    def __init__(self, tokenizer, code: str):
        ids = chunk_ids(tokenizer, lower=True, code=code)
        super().__init__(ids, PACKED)
        self.tokenize, self.code = tokenizer.model.tokenize, code
        self.plain = not any(PLAIN(t.content) for t in tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            core = chunk.rstrip(MARKS)
            if not (self.plain and core.isascii() and core.isalpha()):
                value = self.make(chunk)
            elif len(core) < len(chunk):
                value = self[core] + self[chunk[len(core):]]
            elif core.islower():
                value = array(self.code, [t.id for t in self.tokenize(core)]).tobytes()
            else:
                value = self[core.lower()]
            if len(chunk) > LONGEST:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value


@per_worker
def packer(path: str, code: str) -> Callable[[str], bytes]:
    """Ids of a whole text as little-endian bytes, for a file whose normaliser drops white space."""
    tokenizer = library(path)
    known = Words(tokenizer, code)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def pack(text: str) -> bytes:
        low = text.lower()
        if SIMPLE(text) and not any(x.lower() in low for x in special):
            words = low.split()       # of these characters, the library and Python split at the same ones
        else:
            words = WORD.findall(text)
        return b"".join(itemgetter(*words)(known) if len(words) > 1 else map(known.__getitem__, words))

    return pack
