"""Encoding whole texts with a public tokenizer, remembering each chunk's ids.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct chunk is encoded
once by the tokenizers library, and a document's ids are the chunks' ids in order. The result is
what the library returns for the whole text (tested), at several times the speed.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

#: The characters that Unicode calls white space, but for U+001C to U+001F.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Letters of which every version of Unicode says the same, that compose with nothing before them.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: After them: the end, white space that cuts, or an ASCII character other than a letter or the apostrophe of 's and 're.
ENDS = r"(?![^ \n!-&(-@\[-`{-~])"

#: Where texts may be cut, by kind of vocabulary. A run of Latin letters up to a mark is one pre-token.
CHUNKS = {
    # White space is dropped and nothing spans it: any run without space or line feed stands alone.
    "word": re.compile(f"[{LATIN}]+{ENDS}|[^ \n]+"),
    # A space goes with the word after it; the rest of a run of white space is a token apart.
    "byte": re.compile(f" ?[{LATIN}]+{ENDS}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
}
ONE = re.compile(f" ?[{LATIN}]+")
#: Byte-level vocabularies write bytes as printable characters: those of Latin-1 that print stand for themselves, the others follow from U+0100 on.
PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTS)}
SPACE = SHOWN[32]
#: Few enough for the dict's table of 2^20 places.
MAX_CACHED = 650_000
MAX_CHUNK = 100


class Encoder(dict):
    """encode(texts) gives each text's ids as little-endian unsigned integers of 32 bits, or 16 if narrow; null counts as empty.

    As a dict it maps the chunks it has met to their ids.
    """

    def __init__(self, path: str, kind: str, narrow: bool = False, most: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.findall, self.lower, self.code = CHUNKS[kind].findall, kind == "word", "H" if narrow else "I"
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        bare = chunk[1:] if chunk[0] == " " else chunk
        # One pre-token: the library's model is asked for it without normalizing and cutting again.
        if bare.isascii() and bare.isalpha():
            shown = chunk.lower() if self.lower else bare if bare is chunk else SPACE + bare
        elif ONE.fullmatch(chunk):
            shown = (chunk.lower() if self.lower else chunk).encode().decode("latin-1").translate(SHOWN)
        else:
            shown = ""
        if shown:
            ids = array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()
        else:
            ids = array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= MAX_CHUNK:
            self[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.most:
            self.clear()
        findall, ids = self.findall, self.__getitem__
        # Nothing here can form a cycle, and the collector's rounds over so many new objects cost a seventh of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return [b"".join(map(ids, findall(t))) if t else b"" for t in texts]
        finally:
            if collects:
                gc.enable()


_KEPT: list = [None, None]


def kept(key, make):
    """make(), kept by the worker's process until another key is asked for: a process that goes on to other work holds one model or cache at a time."""
    if _KEPT[0] != key:
        _KEPT[:] = [None, None]
        _KEPT[:] = [key, make()]
    return _KEPT[1]


def encoder(path: str, kind: str, narrow: bool = False, most: int = MAX_CACHED) -> Encoder:
    return kept(("encoder", path, kind, narrow, most), lambda: Encoder(path, kind, narrow, most))


def slices(batch, rows: int = 512, text: str | None = None, most: int = 4_000_000):
    """Parts of an Arrow batch, of few rows and, if text names a string column, of about most bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n, at = batch.num_rows, 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64")) if text and n else None
    while at < n:
        to = min(n, at + rows)
        if sizes is not None:
            to = max(at + 1, min(to, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to
