"""Vocabulary pieces of texts with the tokenizers library, each distinct pre-token encoded once per worker.

A text is cut where no pre-token can reach across (``runs``), runs are cut into pre-tokens, and the library's model encodes a
pre-token. Runs and pre-tokens seen before come from bounded tables. The short way of cutting holds for texts of Latin letters and common
marks, whose classes are fixed; everything else goes through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

#: Parts in a table's young half, half as many pre-tokens; a full half becomes the old half, from which what is asked for again moves to the young one.
RUNS = 60_000
#: Longer runs are not kept.
KEPT = 64

# The two pre-token patterns that have a short way, as the tokenizer files and the library state them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = [chr(c) for c in (*range(1, 0x1C), *range(0x20, 0x85), *range(0x86, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), 0x20AC)]
_CLASS = {kind: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN"}
_SIMPLE = re.compile("[" + "".join(re.escape(c) for c in _PLAIN) + "]*")
_ODD = "\x1c\x1d\x1e\x1f\x85"
_BEFORE_BLANK = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\0")
_WIDE_BLANKS = "\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
_STOP = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_RUN = re.compile(r"\s*\S+|\s+")
_MARK = "\0"
#: Packs so many ids as little-endian 32-bit integers.
_PACK = [struct.Struct(f"<{n}i").pack for n in range(4 * KEPT + 1)]


class Halves(dict):
    """A bounded table of two halves: the dict itself is the young one, which ``dict.get`` reads."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def revive(self, key: str) -> bytes | None:
        """The value of a key that ``get`` did not find a moment ago, if any; it is young again."""
        value = self.old.get(key)
        if value is None:
            return self.get(key)
        self[key] = value
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def _plain_pattern(pattern: str) -> re.Pattern:
    pattern = pattern.replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:s|t|re|ve|m|ll|d)")
    return re.compile(pattern.replace(r"[\p{L}]", f"[{_CLASS['L']}]").replace(r"[\p{N}]", f"[{_CLASS['N']}]")
                      .replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_CLASS['L']}{_CLASS['N']}]").replace(r"\p{L}", f"[{_CLASS['L']}]")
                      .replace(r"\p{N}", f"[{_CLASS['N']}]"))


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters()


class Pieces:
    """One tokenizer file, ready for use in a task."""

    def __init__(self, path: str, runs: int = RUNS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._find_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.kind = self._kind(spec)
        self._pattern = _plain_pattern(WORD_PATTERN if self.kind == "word" else BYTE_PATTERN)
        self._runs, self._ids = Halves(runs), Halves(runs // 2)

    def _kind(self, spec: dict) -> str:
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]) or spec["post_processor"]:
            return "other"
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            return "byte"
        parts = before.get("pretokenizers", [])
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed" \
                and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] \
                and [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return "word"
        return "other"

    def has_special(self, text: str) -> bool:
        for special in self.special:
            if special in text:
                return True
        return False

    def runs(self, text: str) -> list[str]:
        """Parts whose encodings, one after the other, are the encoding of the text."""
        if self.kind == "other" or self.has_special(text) or any(map(text.__contains__, _ODD)):
            return [text]
        if self.kind == "word":
            return text.split()
        if any(map(text.__contains__, _BEFORE_BLANK)) or not text.isascii() and any(map(text.__contains__, _WIDE_BLANKS)):
            return _RUN.findall(text)
        parts = text.replace(" ", "\0 ").split("\0")
        return parts if parts[0] else parts[1:]

    def _short(self, run: str) -> list[str] | None:
        """Pre-tokens of a word of Latin letters, with a blank before or one mark behind; None for anything else."""
        lead, word = ("Ġ", run[1:]) if run[:1] == " " else ("", run)
        last = None
        if not word.isalpha():
            last, word = word[-1:], word[:-1]
            if last not in _STOP or not word.isalpha():
                return None
        if not word.isascii():
            if max(word) >= "\u0180" or "\u0130" in word:
                return None
            word = word.encode().decode("latin-1").translate(_BYTES)
        return [lead + word] if last is None else [lead + word, last]

    def pretokens(self, run: str) -> list[str]:
        """The pre-tokens of a part as the model reads them; a special token is marked."""
        if self.kind == "word" or self.kind == "byte":
            word = run.lower() if self.kind == "word" else run
            if (self.kind == "byte" or run[:1] != " ") and (found := self._short(word)) is not None and "\u0130" not in run:
                return found
            if _SIMPLE.fullmatch(run) and not self.has_special(run):
                return [p if p.isascii() and " " not in p and p.isprintable() else p.encode().decode("latin-1").translate(_BYTES)
                        for p in self._pattern.findall(word)]
        out = []
        for part in self._find_special.split(run) if self.special else [run]:
            if part in self.special:
                out.append(_MARK + part)
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if self.tokenizer.pre_tokenizer else [normal]
        return out

    def count(self, pretoken: str) -> int:
        """Number of pieces of a pre-token."""
        return 1 if pretoken[:1] == _MARK else len(self.model.tokenize(pretoken))

    def _pretoken_ids(self, pretoken: str) -> bytes:
        table = self._ids
        ids = table.get(pretoken) or table.revive(pretoken)
        if ids is None:
            got = [self.special[pretoken[1:]]] if pretoken[:1] == _MARK else [t.id for t in self.model.tokenize(pretoken)]
            if len(pretoken) <= KEPT:
                ids = _PACK[len(got)](*got)
                table.keep(pretoken, ids)
            else:
                ids = struct.pack(f"<{len(got)}i", *got)
        return ids

    def _run_ids(self, run: str) -> bytes:
        if self.kind == "other":
            got = self.tokenizer.encode(run, add_special_tokens=False).ids
            return struct.pack(f"<{len(got)}i", *got)
        found = self.pretokens(run)
        return self._pretoken_ids(found[0]) if len(found) == 1 else b"".join(map(self._pretoken_ids, found))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        parts, known = self.runs(text), self._runs
        out = list(map(known.get, parts))
        at = -1
        while None in out:
            try:
                while True:
                    at = out.index(None, at + 1)
                    run = parts[at]
                    ids = known.revive(run)
                    if ids is None:
                        ids = self._run_ids(run)
                        if len(run) <= KEPT:
                            known.keep(run, ids)
                    out[at] = ids
            except ValueError:  # no further part that was not known
                break
        return b"".join(out)


@lru_cache(maxsize=2)
def pieces(path: str, runs: int = RUNS) -> Pieces:
    """The tables of a tokenizer file, for parts and half as many pre-tokens; a worker keeps them from task to task."""
    return Pieces(path, runs)
