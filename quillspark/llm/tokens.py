"""Exact, cached encoding of texts with the word-level BPE vocabulary."""

from __future__ import annotations

import gc
import os
import re

import numpy as np

#: id that ends every document
END_OF_DOCUMENT = 2
#: entries a worker keeps; a full cache is emptied and fills again
CACHE_ENTRIES = 600_000
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
# texts of printable ASCII and Latin letters: their pre-tokens can be told apart here
_PLAIN = re.compile("[\x20-\x7e\n\t\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
# the vocabulary's own pre-token pattern over those characters in lower case
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class WordEncoder:
    """Ids of whole texts, equal to the library's, through a cache of words.

    The vocabulary's rules never look across white space, and each pre-token is
    encoded alone. So plain texts are cut into pre-tokens, others at ASCII
    blanks, and only pieces not met before go to the library, together. A text
    with one of the vocabulary's special tokens goes there whole, and has its id, as
    by the library's own setting; with ``special_as_text`` it is text like any other.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.hint = os.path.commonprefix(special)  # a plain search for it comes first
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.limit = cache_entries
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that are one pre-token each."""
        lines = [" ".join(parts[k : k + 200]) for k in range(0, len(parts), 200)]
        found = self.tok.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4  # each pre-token has one id that ends a word
        if len(cuts) != len(parts):
            raise ValueError("a part is not one pre-token")
        raw, a, known = ids.tobytes(), 0, self.known
        for p, b in zip(parts, cuts.tolist()):
            known[p] = raw[a:b]
            a = b

    def _pieces(self, texts: list[str]) -> tuple[list[list[str]], dict[int, bytes]]:
        """The known pieces of each text, and the ids of texts that went to the library whole."""
        split, parts, chunks, whole = [], set(), set(), {}
        for k, t in enumerate(texts):
            if self.special and self.hint in t and self.special.search(t):
                split.append([])
                whole[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif _PLAIN.fullmatch(t):
                split.append(p := _PARTS.findall(t.lower()))
                parts.update(p)
            else:
                split.append(p := t.replace("\n", " ").replace("\t", " ").split(" "))
                chunks.update(p)
        if len(self.known) + len(parts) + len(chunks) > self.limit:
            self.known = {"": b""}
        if new := [p for p in parts if p not in self.known]:
            self._learn(new)
        if new := [c for c in chunks if c not in self.known]:
            for c, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
                self.known[c] = np.array(e.ids, dtype="<u4").tobytes()
        return split, whole

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, end id included."""
        gc.disable()  # a batch makes many small objects and no cycles
        try:
            pieces, whole = self._pieces(texts)
            get, end = self.known.__getitem__, np.array([END_OF_DOCUMENT], dtype="<u4").tobytes()
            return [whole.get(k, b"") + b"".join(map(get, ws)) + end for k, ws in enumerate(pieces)]
        finally:
            gc.enable()


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """The worker's encoder for this vocabulary, kept between tasks."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, special_as_text=special_as_text)
    return _ENCODERS[key]


def release() -> None:
    """Give the worker's cached words back; tasks of other operators that hold much call this first."""
    import ctypes

    import pyarrow

    _ENCODERS.clear()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed below its heap's top
        trim(0)
