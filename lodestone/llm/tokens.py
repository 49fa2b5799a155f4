"""Exact token ids by the tokenizers library, with each distinct run of non-space text encoded once per worker.

Byte-level BPE never merges over the places where its pattern splits text, and it always splits around
white space. So a text's ids are the ids of its units (a run of non-space characters with the one blank
before it, or a run of white space), one after the other. Texts with only single blanks and newlines take
a quick split, others a regular expression. Texts that may hold a special token's string, and
vocabularies with another kind of pre-tokenizer, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_FIRST = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")
_WORDS_ONLY = re.compile(f"[^{_W}]+")
_ODD_ASCII = re.compile("[\t\x0b-\r]")
_ODD_WIDE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CONTROL = re.compile("[\x1c-\x1f]")
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
CACHE_UNITS = 500_000
_LOADED: dict[str, "UnitEncoder"] = {}


def encoder(path: str) -> "UnitEncoder":
    """This worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = UnitEncoder(path)
    return _LOADED[path]


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's visible character for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitEncoder:
    """blank_first: units keep the blank before them; else white space is dropped and case is folded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"].lower() for x in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kind = self._kind(spec)
        self.model, self.chars = self.whole.model, _byte_chars()
        self.code, self.tails = "H" if self.dtype.itemsize == 2 else "I", {}
        self.cache: dict[str, bytes] = {}
        self.newline = self._raw(["\n"])[0] if self.kind == "blank_first" else b""

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            return "blank_first"
        parts = pre.get("pretokenizers") or []
        if (
            [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0].get("behavior") == "Removed"
            and parts[0].get("invert")
            and "\\s" in str(parts[0].get("pattern"))
            and not parts[1].get("use_regex", True)
            and not parts[1].get("add_prefix_space")
            and [n.get("type") for n in (norm or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        ):
            return "words"
        return "whole"

    def _raw(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.whole.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _units(self, text: str) -> tuple[list[str], int]:
        """Keys of the cache, and how many newlines too many their ids begin with."""
        if self.kind == "words":
            return (text.split() if not _CONTROL.search(text) else _WORDS_ONLY.findall(text)), 0
        odd = _ODD_ASCII if text.isascii() else _ODD_WIDE
        if text and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or odd.search(text)):
            return ("\n" + text).replace("\n", " \n").split(" ")[1:], 1
        # here a key is the unit itself behind a mark, as plain keys stand for " " + key
        return ["\t" + u for u in _BLANK_FIRST.findall(text)], 0

    def _new(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of units that aren't in the cache."""
        out, rest, blank = {}, [], self.kind == "blank_first"
        tokenize, code, chars, tails = self.model.tokenize, self.code, self.chars, self.tails
        first = chars[32] if blank else ""
        for key in keys:
            # one run of letters is one piece for the model, and full stops or commas at its end another
            if key.isascii() and key.isalpha():
                out[key] = array(code, [t.id for t in tokenize(first + (key if blank else key.lower()))]).tobytes()
                continue
            head, unit = (key[0], key[1:]) if blank and key[0] in "\n\t" else ("", key)
            word = unit.rstrip(".,")
            if not word or not _LETTERS.fullmatch(word):
                rest.append((key, unit if head or not blank else " " + unit, head == "\n"))
                continue
            shown = word if blank else word.lower()
            shown = shown if word.isascii() else shown.encode().decode("latin-1").translate(chars)
            ids = array(code, [t.id for t in tokenize(shown if head else first + shown)]).tobytes()
            if len(word) < len(unit):
                tail = unit[len(word) :]
                more = tails.get(tail)
                if more is None:
                    more = self._raw([tail])[0]
                    if len(tails) < 1000:
                        tails[tail] = more
                ids += more
            out[key] = self.newline + ids if head == "\n" else ids
        for (key, _, line), ids in zip(rest, self._raw([u for _, u, _ in rest]), strict=True):
            out[key] = (self.newline if line else b"") + ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype."""
        out: list[bytes | None] = [None] * len(texts)
        get, waiting, missing, whole = self.cache.get, [], set(), []
        for k, text in enumerate(texts):
            if self.kind == "whole" or ("<" in text and any(s in text.lower() for s in self.special)):
                whole.append(k)
                continue
            units, skip = self._units(text)
            parts, gaps, at = list(map(get, units)), [], -1
            try:
                while True:
                    at = parts.index(None, at + 1)
                    gaps.append(at)
            except ValueError:
                pass
            if gaps:
                missing.update([units[i] for i in gaps])
                waiting.append((k, units, parts, gaps, skip))
            else:
                out[k] = b"".join(parts)[skip * len(self.newline) :]
        for k, ids in zip(whole, self._raw([texts[k] for k in whole]), strict=True):
            out[k] = ids
        if missing:
            new = self._new(missing)
            for k, units, parts, gaps, skip in waiting:
                for i in gaps:
                    parts[i] = new[units[i]]
                out[k] = b"".join(parts)[skip * len(self.newline) :]
            room = CACHE_UNITS - len(self.cache)
            if room > 0:
                self.cache.update([(u, ids) for u, ids in new.items() if len(u) <= 40][:room])
        return out


def text_groups(column, limit: int = 2_000_000):
    """(first row, texts) in groups of about limit bytes; null is the empty text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right")))
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j
