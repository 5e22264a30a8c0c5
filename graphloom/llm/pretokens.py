"""Ids of a byte-level BPE vocabulary, encoded once per distinct piece of text.

The vocabulary's pattern never joins a character to white space that follows it. So a text falls apart, before
every run of white space, into chunks (pre-tokens with what directly follows them) that encode to the same ids
alone as in place; the tokenizers library encodes each distinct chunk once, and the ids of a text are those of
its chunks. Special strings are taken out first, as the library does.

A chunk is named by a key: without its leading space if it has just that one, as it is if it starts with a
newline, and else after a zero byte.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

from graphloom.llm import worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space and the zero byte that make a text need the pattern, as pairs of lone spaces and newlines do.
ASCII_ODD, ODD = re.compile("[\\x00\\t\\x0b-\\r]"), re.compile("[\\x00\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Distinct chunks, and distinct pre-tokens, that a worker remembers; later ones are encoded again when they come again.
REMEMBERED = 350_000
#: Characters below this have had their categories since long before any vocabulary here was made.
LATIN_END = 0x250


def _latin(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == category)


#: The vocabulary's pattern for chunks of Latin characters.
LATIN, PIECE = re.compile(f"[\\x00-{chr(LATIN_END - 1)}]*"), re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_latin('L')}]+| ?[{_latin('N')}]+| ?[^{WHITE}{_latin('L')}{_latin('N')}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(rest)}


_LETTERS = _byte_letters()
_encoders: dict[str, "ChunkEncoder"] = {}
worker.remembers("tokens", _encoders.clear)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, looked up on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def key_of(chunk: str) -> str:
    if chunk[0] == " " and chunk[1:2] not in ("\n", "\0"):
        return chunk[1:]
    return chunk if chunk[0] == "\n" else "\0" + chunk


def chunk_of(key: str) -> str:
    if key[:1] == "\0":
        return key[1:]
    return key if key[:1] == "\n" else " " + key


class ChunkEncoder:
    """Keys, ids and counts of texts under one tokenizers file, without begin, end or added special ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special strings that take in their surroundings are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        parts = json.loads(self.tokenizer.to_str())
        #: Whether pre-tokens can go to the model as they are; else the library takes whole chunks.
        self.byte_level = parts["normalizer"] is None and parts["post_processor"] is None and (parts["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        self.model, self.pieces = self.tokenizer.model, {}
        self.known: dict[str, bytes] = {"\0" + s: array("I", [i]).tobytes() for s, i in self.special.items()}

    def keys(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [k for n, part in enumerate(self.split.split(text)) if part for k in (["\0" + part] if n % 2 else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or (ASCII_ODD if text.isascii() else ODD).search(text):
            return [key_of(c) for c in CHUNK.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        if keys[0] and keys[0][0] != "\n":
            keys[0] = "\0" + keys[0]
        else:
            del keys[: 1 - len(keys[0][:1])]
        return keys

    def ids(self, keys: list[str]) -> list[bytes]:
        """The ids of chunks as little-endian unsigned 32-bit integers."""
        chunks = [chunk_of(k) for k in keys]
        out: list = [None] * len(chunks)
        other, pieces = [], self.pieces
        for n, chunk in enumerate(chunks):
            if chunk in self.special:
                out[n] = self.known["\0" + chunk]
                continue
            if not self.byte_level or not (chunk.isascii() or LATIN.fullmatch(chunk)):
                other.append(n)
                continue
            found = PIECE.findall(chunk)
            ids = [pieces.get(p) for p in found]
            if None in ids:
                for i, p in enumerate(found):
                    if ids[i] is None:
                        ids[i] = array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
                        if len(pieces) < REMEMBERED:
                            pieces[p] = ids[i]
            out[n] = b"".join(ids)
        for n, e in zip(other, self.tokenizer.encode_batch_fast([chunks[n] for n in other], add_special_tokens=False), strict=True):
            out[n] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        get = self.known.get
        cut = [self.keys(t) for t in texts]
        parts = [list(map(get, x)) for x in cut]
        gaps = [[i for i, p in enumerate(x) if p is None] if None in x else () for x in parts]
        new = list({x[i] for x, g in zip(cut, gaps, strict=True) for i in g})
        if new:
            got = dict(zip(new, self.ids(new), strict=True))
            for x, g, p in zip(cut, gaps, parts, strict=True):
                for i in g:
                    p[i] = got[x[i]]
            if len(self.known) + len(got) <= REMEMBERED:
                self.known.update(got)
        return [b"".join(p) for p in parts]


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a vocabulary."""
    if path not in _encoders:
        worker.begins("tokens")
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def slices(batch, size: int = 64, most: int = 1 << 21):
    """Parts of an Arrow batch with a column text: ``size`` rows at most, fewer where texts are long."""
    texts = batch.column("text")
    step = max(1, min(size, most * max(1, batch.num_rows) // max(1, texts.nbytes)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)
