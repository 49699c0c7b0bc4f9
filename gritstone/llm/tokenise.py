"""Exact tokenizer ids at the speed of a dictionary: the words between single spaces and line ends are
encoded once.

Both tokenizers cut their input before a space or line end that stands between two non-space characters,
and between a letter and a final run of signs, and what they make of such a piece does not depend
on its neighbours, so a text's ids are the ids of its pieces. Texts in which other white space touches a
space or line end, and texts that hold the string of a special token, are encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_table

#: Pieces of a generation; a worker remembers at most two, and what it meets again stays.
CACHE = 600_000
#: Pieces of more characters are met once as a rule, and of any length: they are not remembered.
LONG = 64
#: Texts, or new words, that go to the library at once. What it makes of each is some kB until its ids are taken, and memory
#: that a worker has once had for them it does not give back.
AT_ONCE = 2048
#: Signs that may end a piece. None of them belongs to a letter's token.
_SIGNS = ".,;:!?()[]{}<>|/\\\"`~@#$%^&*_+=-"


#: White space other than the space and the line end.
_SPACES = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x20, 0x0A))


def _letters(word: str) -> bool:
    """All letters, in lower case too: what lower-casing makes of some letters holds a mark."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids by a tokenizers file, as little-endian unsigned integers of ``width`` bytes: two
    where the vocabulary allows, else four. Ids are those of the library with ``add_special_tokens=False``
    and its other settings as the file has them: a special token's string in a text becomes that token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.tails: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # a word as it stands after a space; after a line end with it before
        self.older: dict[str, bytes] = {}
        self.line_end = self._whole(["\n"])[0]
        self.mark = self._find_mark()

    def _whole(self, texts: list[str]) -> list[bytes]:
        cuts = (texts[k : k + AT_ONCE] for k in range(0, len(texts), AT_ONCE))
        return [array(self.code, e.ids).tobytes() for cut in cuts for e in self.tokenizer.encode_batch_fast(cut, add_special_tokens=False)]

    def _find_mark(self) -> tuple[str, int] | None:
        """A string between two words that is always one token of its own, with its id."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for mark in ("\n", "\x01"):
            one = ids(mark)
            if len(one) == 1 and all(ids(f"{x}ab{mark}{x}cd") == ids(x + "ab") + one + ids(x + "cd") for x in ("", " ")):
                return mark, one[0]
        return None

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Each word with the lead before it."""
        return [ids for k in range(0, len(words), AT_ONCE) for ids in self._some_words(words[k : k + AT_ONCE], lead)]

    def _some_words(self, words: list[str], lead: str) -> list[bytes]:
        """Words of letters go through the tokenizer as one text and are told apart by the mark."""
        if self.mark and len(words) > 8:
            mark, number = self.mark
            text = "".join([f"{lead}{w}{mark}" for w in words])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.flatnonzero(ids == number)
            if len(ends) == len(words):
                raw, ends = ids.tobytes(), (ends * self.width).tolist()
                return [raw[a:b] for a, b in zip([0, *[e + self.width for e in ends[:-1]]], ends, strict=True)]
        return self._whole([lead + w for w in words])

    def _learn(self, pieces: list[str]) -> None:
        known, older, tails = self.known, self.older, self.tails
        after_space: set[str] = set()
        after_line: set[str] = set()
        with_signs, rest = [], []
        for p in pieces:
            stem = p.rstrip(_SIGNS)
            if stem != p:
                if not _letters(stem[-1:]):
                    rest.append(p)
                    continue
                signs = p[len(stem) :]
                if signs not in tails:
                    tails[signs] = self._whole([signs])[0]
                with_signs.append((p, stem, signs))
                p = stem
            if p not in known:
                old = older.get(p)
                if old is not None:
                    known[p] = old
                elif _letters(p):
                    after_space.add(p)
                elif p[0] == "\n" and _letters(p[1:]):
                    after_line.add(p[1:])
                else:
                    rest.append(p)
        words = list(after_space)
        known.update(zip(words, self._words(words, " "), strict=True))
        words = list(after_line)
        known.update(("\n" + w, self.line_end + ids) for w, ids in zip(words, self._words(words, ""), strict=True))
        known.update(zip(rest, self._whole([p if p[0] == "\n" else " " + p for p in rest]), strict=True))
        for p, stem, signs in with_signs:
            known[p] = known[stem] + tails[signs]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column. Pieces are told apart and counted in Arrow, so that each
        different piece of a batch is looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # A line end opens the piece after it.
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        at, edges = coded.indices.to_numpy(), parts.offsets.to_numpy()
        edges = edges - edges[0]
        pieces = coded.dictionary.to_pylist()
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
            self.tails = {}
        ids = list(map(self.known.get, pieces))
        new = [k for k, x in enumerate(ids) if x is None]
        # Pieces that are empty or have other white space at an end are never known, so they show up here.
        odd = np.zeros(len(pieces), bool)
        odd[[k for k in new if (p := pieces[k]) == "" or p[-1].isspace() or p[0] in _SPACES]] = True
        self._learn([pieces[k] for k in new if not odd[k]])
        for k in new:
            ids[k] = b"" if odd[k] else self.known[pieces[k]]
        for p in (pieces[k] for k in new):
            if len(p) > LONG:
                self.known.pop(p, None)
                self.known.pop(p.rstrip(_SIGNS), None)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(ids), f"<u{self.width}")
        # A first piece has no space before it and is encoded by itself.
        counts = sizes[at]
        heads = edges[:-1]
        counts[heads] = 0
        ends = np.cumsum(counts)
        flat = every[np.repeat(starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        raw, bounds = flat.tobytes(), np.r_[0, ends * self.width]
        whole = np.logical_or.reduceat(odd[at], heads) if len(heads) else np.zeros(0, bool)
        for string in self.special:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        first = [pieces[k] for k in at[heads].tolist()]
        alone = [t if w else f for t, w, f in zip(texts.to_pylist() if whole.any() else first, whole.tolist(), first, strict=True)]
        lead = self._whole(alone)
        spans = zip(bounds[heads].tolist(), bounds[edges[1:]].tolist(), strict=True)
        return [x if w else x + raw[a:b] for x, w, (a, b) in zip(lead, whole.tolist(), spans, strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file: it lives over all the worker's tasks, until one of another operator."""
    return worker_table(path, lambda: Encoder(path))
