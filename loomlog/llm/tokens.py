"""Tokenizing text in executors with the ``tokenizers`` library.

``Encoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. The strings of special
tokens in a text are those tokens, as the library has it by default, or ordinary text if ``literal`` is set. It cuts a text only where the tokenizer's own first split must cut
it, and keeps the ids of each such part, so a part that was seen before isn't encoded again:

* byte-level tokenizers: before a single space, around a single line feed and between letters and the punctuation
  behind them, unless two white-space characters meet anywhere in the text (then the whole text goes to the library);
* tokenizers that drop white space and case: at spaces and line feeds and before such punctuation, after
  lower-casing texts of Latin letters, for which normalising changes nothing else;
* any other tokenizer: nowhere.

For byte-level tokenizers the parts of many texts are cut and counted as arrays, and the words that occur in them go
to the model together, strung into one, each once (``_Strung``).
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes (about: strings, ids and places in the table) of the parts kept per Python worker. Half is for parts in use; when that is full it becomes the other half, from which parts that are met again come back.
MAX_PART_BYTES = 64_000_000
#: Characters of text handed over at a time.
SLICE_CHARS = 3_000_000
#: Words strung into one for the model.
STRUNG = 500

_NULL = "\x00"
assert sys.byteorder == "little" and array("I").itemsize == 4
#: What byte-level tokenizers write for each byte: printable Latin-1 for itself, the others from code point 256 on.
_BYTE_CHARS = dict(enumerate(range(256)))
_BYTE_CHARS |= {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_SPACES = re.compile(r"\s\s")
#: Beyond Latin letters: normalising and changing case may then mean more than str.lower does.
_FAR = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: What may follow a word within a part: the tokenizers here always split between letters and these. (An apostrophe may belong to letters.)
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_file(name: str) -> str:
    """An absolute path is taken as it is; other names are those of the public tokenizers package."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as bytes: one little-endian unsigned integer of ``width`` bytes per id."""

    def __init__(self, name: str, width: int = 4, literal: bool = False, most: int = MAX_PART_BYTES):
        from tokenizers import Tokenizer

        path = tokenizer_file(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.width, self.code = width, {2: "H", 4: "I"}[width]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Strings that the tokenizer takes out of a text before anything else; texts that may hold one are encoded as a whole.
        self.added = [t["content"].lower() for t in spec.get("added_tokens", []) if not (literal and t.get("special"))]
        if width == 2 and max(spec["model"]["vocab"].values()) > 65_535:
            raise ValueError(f"ids of {name} need more than two bytes")
        self.kind = self._kind(spec)
        self.parts = _Parts(self, most)
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        merges = spec["model"].get("type", "BPE") == "BPE" and not any(spec["model"].get(x) for x in odd)
        self.strung = _Strung(self, spec["model"]["vocab"]) if self.kind == "bytes" and merges else None

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec.get("post_processor") is not None and spec["post_processor"].get("type") not in (None, "ByteLevel"):
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "bytes"
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
        return "words" if kinds == ["NFC", "Replace", "Lowercase"] and dropped else "whole"

    def _split(self, text: str) -> list[str] | None:
        """The parts of a text, or None if it has to be encoded as a whole."""
        if self._special(text):
            return None
        if self.kind == "words":
            if not text.isascii() and _FAR.search(text):
                return text.replace("\n", " ").split(" ")
            return text.lower().replace("\n", " ").split(" ")
        if self.kind == "whole" or _NULL in text or _SPACES.search(text):
            return None
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split(_NULL)

    def _special(self, text: str) -> bool:
        return "<" in text and any(t in text.lower() for t in self.added)

    def _plain(self, part: str) -> bool:
        """Whether the tokenizer's own normaliser and split leave the part as it is: (a space and) Latin letters, for some tokenizers lower-case ones."""
        if part.isascii():
            return (part.isalpha() and (self.kind == "bytes" or part.islower())) or (self.kind == "bytes" and part[:1] == " " and part[1:].isalpha())
        if self.kind == "words":
            return part.isalpha() and not _FAR.search(part) and part.lower() == part
        return (part.isalpha() or (part[:1] == " " and part[1:].isalpha())) and not _FAR.search(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out, whole = self.parts.__getitem__, [], []
        if self.strung:
            whole = [i for i, text in enumerate(texts) if _SPACES.search(text) or self._special(text)]
            out, skipped = [b""] * len(texts), set(whole)
            cut = [i for i in range(len(texts)) if i not in skipped]
            for i, packed in zip(cut, self.strung.encode([texts[i] for i in cut]), strict=True):
                out[i] = packed
        else:
            for i, text in enumerate(texts):
                split = self._split(text)
                if split is None:
                    whole.append(i)
                    out.append(b"")
                else:
                    out.append(b"".join(map(get, split)))
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = array(self.code, e.ids).tobytes()
        return out


class _Parts(dict):
    """Packed ids of parts, ``most`` bytes at most. A part that isn't there is encoded: plain ones by the tokenizer's model alone, since its normaliser and split leave them as they are."""

    def __init__(self, owner: Encoder, most: int):
        self[""] = b""
        self.half, self.held, self.old = most // 2, 0, {}
        self.plain, self.code, self.tokenizer, self.model = owner._plain, owner.code, owner.tokenizer, owner.tokenizer.model

    def __missing__(self, part: str) -> bytes:
        if (packed := self.old.get(part)) is not None:
            return self._keep(part, packed)
        if self.plain(part):
            ids = [x.id for x in self.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_CHARS))]
        elif (word := part.rstrip(_MARKS)) and len(word) < len(part) and self.plain(word):
            return self._keep(part, self[word] + self[part[len(word) :]])
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return self._keep(part, array(self.code, ids).tobytes())

    def _keep(self, part: str, packed: bytes) -> bytes:
        size = 200 + 2 * len(part) + len(packed)
        if self.held + size > self.half:
            self.old = dict(self)
            self.clear()
            self[""], self.held = b"", 0
        if size <= self.half:
            self[part] = packed
            self.held += size
        return packed


def _bytes_of(chars: str) -> np.ndarray:
    """By byte, whether it is one of these."""
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode("latin-1"))] = True
    return table


_LETTER = _bytes_of("".join(chr(x) for x in range(128) if chr(x).isalpha()))
_MARK = _bytes_of(_MARKS)
#: First bytes, of two, of the letters U+00C0 to U+023F (and of the signs U+00D7 and U+00F7 among them).
_LEAD = _bytes_of("\xc3\xc4\xc5\xc6\xc7\xc8")
_CHAR_OF_BYTE = np.array([_BYTE_CHARS[b] for b in range(256)], dtype="<u4")


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By byte, whether it belongs to a Latin letter, and whether one ends with it."""
    lead = _LEAD[data]
    lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    end = _LETTER[data]
    end[1:] |= lead[:-1]
    return lead | end, end


class _Strung:
    """Ids of texts without special tokens and without two white-space characters in a row, for byte-level tokenizers that only merge, by the words that occur in them.

    Words of a space and Latin letters are what the split leaves as it is; ``STRUNG`` at a time they are strung into
    one for the model. A word's only space is its first character: if as many tokens as there are words start with
    one, none reaches over the end of a word, so merging in one word changed nothing in another. Otherwise, and for
    any other part, the part is encoded alone.
    """

    def __init__(self, owner: Encoder, vocab: dict[str, int]):
        from tokenizers import Tokenizer

        self.parts, self.dtype = owner.parts, np.dtype(f"<u{owner.width}")
        self.model = Tokenizer(owner.tokenizer.model)  # shared; no split and no special tokens
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for t, i in vocab.items() if t.startswith(chr(_BYTE_CHARS[32]))]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [x.encode() for x in texts]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts)
        first, words = self._cut(data, np.cumsum(sizes) - sizes)
        ids, n = self._encode(words.dictionary)
        which = words.indices.to_numpy()
        lens = n[which]
        ends = np.cumsum(lens)
        at = (np.cumsum(n) - n)[which] - (ends - lens)
        packed = ids[np.repeat(at, lens) + np.arange(ends[-1])].tobytes()
        upto = np.concatenate(([0], ends))[np.searchsorted(first, np.concatenate(([0], np.cumsum(sizes))))] * self.dtype.itemsize
        return [packed[lo:hi] for lo, hi in zip(upto.tolist(), upto[1:].tolist(), strict=False)]

    @staticmethod
    def _cut(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where the parts begin, and the parts as a dictionary: cut at texts' begins, before spaces, around line feeds, and between Latin letters and the punctuation behind them."""
        _, end = _letters(data)
        new = (data == 32) | (data == 10)
        new[1:] |= (data[:-1] == 10) | (end[:-1] & _MARK[data[1:]])
        new[begins[begins < len(data)]] = True
        first = np.flatnonzero(new)
        offsets = np.append(first, len(data)).astype(np.int32)
        return first, pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()

    def _encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one behind the other, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: offsets[-1]]
        letter, lens = _letters(data)[0], np.diff(offsets)
        plain = (data[offsets[:-1]] == 32) & (lens > 1) & (np.add.reduceat(letter, offsets[:-1], dtype=np.int64) == lens - 1)
        strung, alone = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        text = _CHAR_OF_BYTE[data[np.repeat(plain, lens)]].tobytes().decode("utf-32-le")
        cuts = np.concatenate(([0], np.cumsum(lens[strung])))
        n, found = np.zeros(len(words), dtype=np.int64), []
        groups = range(0, len(strung), STRUNG)
        for k, e in zip(groups, self.model.encode_batch_fast([text[cuts[k] : cuts[min(k + STRUNG, len(strung))]] for k in groups], add_special_tokens=False), strict=True):
            some, ids = strung[k : k + STRUNG], np.array(e.ids, dtype=self.dtype)
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) == len(some):
                n[some] = np.diff(begins, append=len(ids))
                found.append((some, ids))
            else:
                alone += some.tolist()
        packed = [self.parts[x] for x in words.take(pa.array(alone, pa.int64())).to_pylist()]
        n[alone] = [len(x) // self.dtype.itemsize for x in packed]
        found.append((np.array(alone, dtype=np.int64), np.frombuffer(b"".join(packed), dtype=self.dtype)))
        out, begin = np.empty(n.sum(), dtype=self.dtype), np.cumsum(n) - n
        for some, ids in found:
            own = n[some]
            out[np.repeat(begin[some] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, n


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder(name: str, width: int = 4, literal: bool = False) -> Encoder:
    """The Python worker's encoder; workers are used again, and so are the parts they know. Only one vocabulary's is kept."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = name, width, literal
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS, encoding: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each holds about ``most`` bytes of text at most (or one row), with the texts; null counts as empty. Behind the last one, memory that is free again goes back to the system, as the worker is used for tasks of other kinds; encoders, which tasks that don't say ``encoding`` have no use for, go at the start of one."""
    if not encoding:
        _encoders.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(lo, hi - lo)
            yield piece, [x or "" for x in piece.column(piece.schema.get_field_index(column)).to_pylist()]
    give_back()


def give_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
