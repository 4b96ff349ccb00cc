"""Whole-text encoding with the tokenizers library, through a bounded cache of words per worker.

Both vocabularies cut a text at single blanks, at line ends and between a letter and a stop or comma
before any merge, so a text's ids are the ids of its pieces one after the other. Arrow finds the distinct words of a slice; only words that the
worker has not met are encoded. Texts whose blanks do not allow the cut, or that spell a special token,
are encoded as one, as a plain call of the library does.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, ragged

#: Words a worker remembers; beyond it starts anew.
CACHE_WORDS = 400_000
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Marks a piece that no blank precedes; texts that hold it are encoded as one.
_GLUE = "\x01"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts; ``blank`` tells that the vocabulary keeps blanks as part of words."""

    #: Pattern of literals that the library takes for single ids; texts that hold one are encoded as one.
    special = ""
    #: What all these literals begin with, whatever the case: a plain search that spares most texts the pattern.
    mark = ""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.blank = layout["normalizer"] is None
        literals = [t["content"] for t in layout.get("added_tokens") or []]
        self.special = "|".join(f"(?:{re.escape(x)})" for x in literals)
        self.mark = re.match("[^A-Za-z]*", os.path.commonprefix(literals))[0] if "".join(literals).isascii() else ""
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in layout["model"]["vocab"].items():
            self.edge[number] = token.startswith("\u0120") if self.blank else token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.starts, self.ids, self.size = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.count = 0

    def _ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in an order of their own, their ids and how many each has.

        Plain words go many at a time as one text and are told apart by their ids: each begins with the
        only blank, or ends with the only word end, that it has.
        """
        plain, others, parts, counts = [], [], [], []
        for w in words:
            (plain if (w[0] == " " and w[1:].isalpha() if self.blank else w.isalpha()) else others).append(w)
        done: list[str] = []
        for k in range(0, len(plain), 1024):
            chunk = plain[k : k + 1024]
            text = ("" if self.blank else " ").join(chunk)  # the fast call keeps no offsets
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(chunk):
                done += chunk
                parts.append(ids)
                counts.append(np.diff(at, append=len(ids)) if self.blank else np.diff(at, prepend=-1))
            else:
                others += chunk
        lists = self._one_by_one(others)
        counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        parts.append(np.fromiter((i for x in lists for i in x), np.int32, int(counts[-1].sum())))
        return done + others, np.concatenate(parts), np.concatenate(counts)

    def _one_by_one(self, texts: list[str]) -> list[list[int]]:
        found = []
        for k in range(0, len(texts), 512):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 512], add_special_tokens=False)]
        return found

    def _remember(self, words: list[str]) -> None:
        words, flat, lengths = self._ids(words)
        if self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)))
        self.ids[self.size : self.size + len(flat)] = flat
        self.starts = np.concatenate((self.starts[: self.count + 1], self.size + np.cumsum(lengths)))
        self.words.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.count, self.size = len(self.words), self.size + len(flat)

    def _cut(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeListArray]:
        """Which texts can't be cut, and the pieces of the others."""
        odd = np.zeros(len(texts), bool)
        if self.special:
            some = np.flatnonzero(np.asarray(pc.match_substring(texts, self.mark)))
            if len(some):
                odd[some] = np.asarray(pc.match_substring_regex(texts.take(pa.array(some)), self.special, ignore_case=True))
        empty, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        if self.blank:
            odd |= np.asarray(pc.match_substring_regex(texts, f"^{_WHITE}|{_WHITE}{_WHITE}|{_GLUE}"))
        if odd.any():
            texts = pc.if_else(pa.array(odd), empty, texts)
        if self.blank:
            cut = pc.replace_substring(texts, "\n", " \n")
            cut = pc.replace_substring_regex(cut, "([a-z])([.,])", rf"\1 {_GLUE}\2")
            cut = pc.binary_join_element_wise(line, cut, empty)
        else:
            cut = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            cut = pc.replace_substring_regex(cut, "([a-z])([.,])", r"\1 \2")
        return odd, pc.split_pattern(cut, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of each text in them; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd, lists = self._cut(texts)
        firsts = np.asarray(lists.offsets).astype(np.int64)
        firsts = firsts - firsts[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.blank:
            words = [w if w[:1] == "\n" else w[1:] if w[:1] == _GLUE else " " + w for w in words]
        if self.count + len(words) > CACHE_WORDS:
            self._reset()
        own = list(map(self.words.get, words))
        if new := [w for w, place in zip(words, own, strict=True) if place is None]:
            self._remember(new)
            own = [self.words[w] if place is None else place for w, place in zip(words, own, strict=True)]
        own = np.array(own, np.int64)[codes]
        starts, ends = self.starts[own], self.starts[own + 1]
        flat = self.ids[ragged(starts, ends - starts)]
        ends = np.concatenate(([0], np.cumsum(ends - starts)))[firsts]
        if self.blank:  # the line end that was put before each text
            keep = np.ones(len(flat), bool)
            keep[ends[:-1]] = False
            flat, ends = flat[keep], ends - np.arange(len(texts) + 1)
        if odd.any():
            return self._with_whole(texts, odd, flat, ends)
        return flat, ends

    def _with_whole(self, texts: pa.Array, odd: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(odd)
        whole = dict(zip(rows.tolist(), self._one_by_one([texts[int(r)].as_py() for r in rows]), strict=True))
        parts = [np.asarray(whole[r], np.int32) if r in whole else flat[ends[r] : ends[r + 1]] for r in range(len(odd))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def encoder(path: str) -> Encoder:
    """The worker's encoder for one vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each text."""
    out = np.insert(flat, ends[1:], end_id) if len(ends) > 1 else flat
    return out, ends + np.arange(len(ends))


KEPT.append(_ENCODERS.clear)
