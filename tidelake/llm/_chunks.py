"""Texts as runs that a tokenizer provably treats one by one, so that the tokens of a run are computed once.

A tokenizer file is read for what its pre-tokenizer does with white space:

* "dropped": tokens never hold white space, so each run between blanks, tabs and line ends stands alone;
* "leading": byte-level splitting, where one blank goes to the word after it. A blank between two characters that aren't
  white space is always a boundary, and so is any blank of a text without two white-space characters in a row;
* "whole": anything else; the text is one run.

Special tokens hold no white space, so no cut divides one.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re

import numpy as np

#: Entries that a worker keeps before it forgets those it learned (about 80 MB).
CACHE_LIMIT = 400_000
#: Characters of the longest run that is kept.
KEPT = 4096
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f]")
_TWO = re.compile(r"\s\s")
#: Letters (no capital I with a dot, whose small form is two characters) with ASCII marks after them: two pre-tokens, the
#: second perhaps empty, that no normalization joins or divides.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> str:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    rest = iter(range(256, 512))
    return "".join(chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else chr(next(rest)) for b in range(256))


def trim() -> None:
    """Gives memory that reading a vocabulary took for a moment back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ids_of(tok, texts: list[str]) -> list[list[int]]:
    batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return [e.ids for e in batch(texts, add_special_tokens=False)]


def mode(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        return "whole"
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and norm is None:
        return "leading"
    steps = pre.get("pretokenizers", [])
    if steps and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not spec.get("post_processor"):
        pattern, kinds = steps[0]["pattern"].get("Regex", ""), [n["type"] for n in (norm or {}).get("normalizers", [])]
        # every alternative: letters, one digit, no white space, or an apostrophe with letters
        plain = all(re.fullmatch(r"\[?\\p\{[LN]\}\]?\+?|\[\^\\s[^\]]*\]\+|'[a-z]+", x) for x in pattern.split("|"))
        if plain and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            return "dropped"
    return "whole"


def spaced(text: str) -> bool:
    """The text has two white-space characters in a row, or a blank at its begin or end."""
    if text[:1] == " " or text[-1:] == " ":
        return True
    if text.isascii() and not _RARE.search(text):
        return "  " in text or "\n " in text or " \n" in text or "\n\n" in text
    return _TWO.search(text) is not None


def cut(text: str, how: str) -> list:
    """Runs of the text, in order. "leading": each run but the first stands for itself with a blank before it, and the first,
    which has none, is a tuple."""
    if how == "dropped":
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return text.split(" ")
    if how == "leading":
        runs: list = text.split(" ") if not _TWO.search(text) else [r[k > 0 :] for k, r in enumerate(_BETWEEN.split(text))]
        runs[0] = (runs[0],)
        return runs
    return [text]


class Runs:
    """Ids of distinct runs, many in one call of the library.

    Runs of plain letters with marks after them go to the model alone, in its byte alphabet and cut where its pre-tokenizer
    would cut; their tokens are told apart by the blank before each run ("leading") or by the ends of words ("dropped").
    Any other run goes through the whole tokenizer.
    """

    STEP = 32

    def __init__(self, tok, how: str, path: str):
        from tokenizers import pre_tokenizers

        self.tok, self.how = tok, how
        suffix = getattr(tok.model, "end_of_word_suffix", None) or ""
        self.model = None
        if how == "leading" and not suffix or how == "dropped" and suffix:
            self.model = load(path)
            self.model.normalizer = None
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            size = tok.get_vocab_size(with_added_tokens=True)
            names = (tok.id_to_token(i) or "" for i in range(size))
            self.edge = np.fromiter((n.endswith(suffix) if suffix else n.startswith("\u0120") for n in names), bool, size)
            self.alphabet = byte_alphabet()
        trim()

    def _plain(self, pieces: list[str], runs: list[int]) -> list[list[int]]:
        """pieces of several runs in the byte alphabet; runs: how many pieces each has."""
        ids = ids_of(self.model, [" ".join(pieces)])[0]
        at = np.flatnonzero(self.edge[ids])
        if self.how == "leading":
            cuts = [*at.tolist(), len(ids)]
        else:
            cuts = [0, *(at + 1)[np.cumsum(runs) - 1].tolist()]
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, runs: list) -> list[list[int]]:
        if self.model is None:
            return ids_of(self.tok, [r[0] if isinstance(r, tuple) else r for r in runs])
        lead, small, alphabet, full = ("\u0120", False, self.alphabet, _PLAIN.fullmatch) if self.how == "leading" else ("", True, self.alphabet, _PLAIN.fullmatch)
        out: list = [None] * len(runs)
        rest: list[int] = []
        for first in range(0, len(runs), self.STEP):
            pieces: list[str] = []
            sizes: list[int] = []
            where: list[int] = []
            for k, r in enumerate(runs[first : first + self.STEP], first):
                m = full(r) if type(r) is str else None
                if m is None:
                    rest.append(k)
                    continue
                a, b = m.groups()
                if small:
                    a = a.lower()
                if not a.isascii():
                    a = a.encode().decode("latin-1").translate(alphabet)
                where.append(k)
                if b:
                    pieces += (lead + a, b)
                    sizes.append(2)
                else:
                    pieces.append(lead + a)
                    sizes.append(1)
            if where:
                for k, x in zip(where, self._plain(pieces, sizes), strict=True):
                    out[k] = x
        if rest:
            lead = " " if self.how == "leading" else ""
            for k, x in zip(rest, ids_of(self.tok, [runs[k][0] if isinstance(runs[k], tuple) else lead + runs[k] for k in rest]), strict=True):
                out[k] = x
        return out


class Memo(dict):
    """Values of runs; forgets what it learned when it grows past its limit."""

    def __init__(self, base: dict, encode, limit: int = CACHE_LIMIT):
        super().__init__(base)
        self._base, self._encode, self._limit = base, encode, limit + len(base)

    def values_of(self, runs: list) -> list:
        out = list(map(self.get, runs))
        if None in out:
            new = list({r for r, v in zip(runs, out, strict=True) if v is None})
            if len(self) + len(new) > self._limit:
                self.clear()
                self.update(self._base)
                new = list({r for r in runs if r not in self})
            self.update(zip(new, self._encode(new), strict=True))
            out = list(map(self.__getitem__, runs))
            for r in new:
                if len(r) > KEPT:
                    del self[r]
        return out

    def by_text(self, texts: list[str], how: str) -> list[list]:
        """The values of the runs of each text."""
        cuts = [cut(t, how) for t in texts]
        flat = self.values_of([r for c in cuts for r in c])
        out, at = [], 0
        for c in cuts:
            out.append(flat[at : at + len(c)])
            at += len(c)
        return out
