"""Byte-level BPE ids of many texts at once.

Byte-level BPE never merges across a single blank between two non-blanks, so a
text is a row of pieces that can be encoded on their own.  Arrow splits and
numbers the pieces of a batch, each distinct piece is encoded once by the
tokenizers library, and numpy puts the ids together.  Texts that do not have that
shape go through a slower split or through the library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: RE2: a blank that isn't alone between two non-blanks.
_ODD = f"\\A[{_SPACE}]|[{_SPACE}]\\z| [{_SPACE}]|[{_SPACE}] |\\x00"
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Characters whose class is the same in every Unicode version.
_PLAIN = re.compile("[\n\x20-\x7e¡-¬®-ɏ]*\\Z")
#: Marks that are a part of their own after a word of letters.
_TAIL = frozenset(".,;:!?)")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Encoder:
    """Ids of whole texts, with a bounded memory of pieces.

    ``max_pieces`` bounds the memory: when it is reached, the pieces are forgotten
    and learned again; results don't depend on it.
    """

    def __init__(self, path: str | None = None, max_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words = regex.compile(PATTERN)
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        back = {c: b for b, c in self.letters.items()}
        plain = (bytes(back[c] for c in t).decode("utf-8", "replace") for t in vocabulary if "\u0120" in t[1:] and all(c in back for c in t))
        # words can be merged in a row only if no token has a blank after a letter (or after a letter's last bytes)
        self.in_rows = not any(re.search("[^\\W\\d_] |\ufffd ", t) for t in plain)
        self.marks = {c: vocabulary[c] for c in _TAIL if c in vocabulary}
        self.max_pieces = max_pieces
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        ids = self.tails.get(part)
        if ids is None:
            letters = part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(letters)]
            if len(part) <= 8:
                self.tails[part] = ids
        return ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each after a blank, and how many each has.

        No token of the vocabulary has the blank's stand-in after a letter (``in_rows``), so
        words in a row can be merged in one call.
        """
        ids: list[int] = []
        letters = (" " + " ".join(words)).encode().decode("latin-1").translate(self.letters) if words else ""
        mapped = letters.split("\u0120")
        for k in range(1, len(mapped), 30):
            ids += [t.id for t in self.model.tokenize("\u0120" + "\u0120".join(mapped[k : k + 30]))]
        out = np.array(ids, np.uint32)
        starts = np.flatnonzero(self.leads[out])
        return out, np.diff(np.append(starts, len(out)))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The numbers of the pieces."""
        known = self.pieces
        if len(known) + len(pieces) > self.max_pieces or len(self.tails) > self.max_pieces:
            self._forget()
            known = self.pieces
        new = [p for p in pieces if p not in known]
        words, ended, rest = {}, [], []
        for p in new:
            if not self.in_rows:
                rest.append(p)
            elif p.isalpha() and _PLAIN.match(p):
                words[p] = None
            elif p[-1] in self.marks and (q := p[:-1]).isalpha() and _PLAIN.match(q):
                ended.append(p)
                if q not in known:
                    words[q] = None
            else:
                rest.append(p)
        self._keep(list(words), *self._words(list(words)))
        core = np.array([known[p[:-1]] for p in ended], np.int64)
        sizes = self.ends[core + 1] - self.ends[core] + 1
        ends = np.cumsum(sizes)
        ids = self.ids[np.minimum(np.arange(sizes.sum()) + np.repeat(self.ends[core] - (ends - sizes), sizes), max(len(self.ids) - 1, 0))]
        ids[ends - 1] = [self.marks[p[-1]] for p in ended]
        self._keep(ended, ids, sizes)
        found = [self._piece(p) for p in rest]
        self._keep(rest, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if pieces:
            self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, np.cumsum(sizes, dtype=np.int64) + self.ends[-1]])

    def _piece(self, piece: str) -> list[int]:
        text = piece[1:] if piece[:1] == "\x00" else " " + piece
        if not _PLAIN.match(text):
            return self.whole(text)
        out: list[int] = []
        for part in self.words.findall(text):
            out += self._part(part)
        return out

    def _pieces(self, flat: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = flat.dictionary_encode()
        own = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        first = self.ends[own]
        size = (self.ends[own + 1] - first).astype(np.int32)
        low = int(first.min()) if len(first) else 0
        sizes = size[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = (first - low)[at] - (ends - sizes)
        ids = self.ids[np.arange(low, low + total) + np.repeat(shift, sizes)]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        upto = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(upto)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and how many each text has (int64)."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        even = texts if not odd.any() else texts.filter(pa.array(~odd))
        marked = pc.binary_join_element_wise(pa.scalar("\x00"), even, pa.scalar(""))
        split = pc.split_pattern(marked, " ")
        ids, counts = self._pieces(split.flatten(), np.diff(split.offsets.to_numpy()))
        if not odd.any():
            return ids, counts
        per = [np.zeros(0, np.uint32)] * n
        starts = np.cumsum(counts) - counts
        for k, i in enumerate(np.flatnonzero(~odd).tolist()):
            per[i] = ids[starts[k] : starts[k] + counts[k]]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            if "\x00" in text:
                per[i] = np.array(self.whole(text), np.uint32)
            else:
                parts = _GAP.split(text)
                parts[0] = "\x00" + parts[0]
                per[i] = self._pieces(pa.array(parts, pa.string()), np.array([len(parts)]))[0]
        return np.concatenate(per), np.array([len(x) for x in per], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def forget() -> None:
    """Let the worker's encoders go, where no text is to be encoded next."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
