"""Token ids of whole texts by the tokenizers library, remembering the ids of pieces between spaces.

Both tokenizers used here split a text at single spaces anyway, so the ids of a text are those of its pieces in turn. Where that does not hold (a space
between two other white spaces joins a longer run; a special token's string stands in the text) the whole text goes to the library.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import public_tokenizers

from .common import ragged, remembered, starts

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def path(name: str) -> str:
    return public_tokenizers.path(name)


def load(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


class Store:
    """Ids of numbered pieces, one after another in one array that grows."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        """Number of the first of the added pieces."""
        first, n = self.count, len(lengths)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.flat[self.used:self.used + len(flat)] = flat
        self.begin[first:first + n], self.length[first:first + n] = self.used + starts(lengths)[:-1], lengths
        self.used, self.count = self.used + len(flat), first + n
        return first

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.begin[numbers], self.length[numbers])


_POINTS = ".,;:!?"


class Encoder:
    """Ids of texts. `spaced` tokenizers keep a piece's leading space, the others drop white space.

    Pieces are remembered up to `most`, or 64 bytes times that; then the half used more often stays, without pieces of more than 256 characters.
    """

    def __init__(self, file: str, most: int = 800_000):
        self.library, self.most = load(file), most
        self.spaced = '"type":"Lowercase"' not in self.library.to_str().replace(" ", "")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.apart,) = self.library.encode(self.special[-1] if self.spaced else "\x01", add_special_tokens=False).ids
        self.store, self.first, self.later, self.held = Store(), {}, {}, 0
        self.begins_white, self.ends_white, self.uses = (np.zeros(1 << 14, k) for k in (bool, bool, np.int64))

    def forget(self) -> None:
        """Keep the half of the pieces that were used most."""
        n = self.store.count
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[:self.most // 2])
        place = np.full(n, -1)
        place[keep] = np.arange(len(keep))
        old, self.store = self.store, Store()
        self.store.add(old.ids(keep), old.length[keep])
        for name in ("begins_white", "ends_white", "uses"):
            setattr(self, name, np.concatenate([getattr(self, name)[keep], np.zeros(self.most, getattr(self, name).dtype)]))
        self.uses //= 2
        at = place.tolist()
        self.first, self.later = ({p: at[i] for p, i in known.items() if at[i] >= 0 and len(p) <= 256} for known in (self.first, self.later))
        self.held = sum(map(len, self.first)) + sum(map(len, self.later))

    def learn(self, known: dict[str, int], pieces: list[str], prefix: str) -> None:
        """Add pieces; points after a letter are split off, as both tokenizers do, so that a word is merged once whatever follows it."""
        self.held += sum(map(len, pieces))
        plain, pointed = [], []
        for p in pieces:
            core = p.rstrip(_POINTS)
            if len(core) == len(p) or not core or not core[-1].isalpha():
                plain.append(p)
            else:
                pointed.append((p, core))
        plain += [c for c in dict.fromkeys(c for _, c in pointed) if c not in known]
        ends = dict.fromkeys(p[len(c):] for p, c in pointed)
        for names, held, before in (([t for t in ends if t not in self.first], self.first, ""), (list(dict.fromkeys(plain)), known, prefix)):
            if names:
                at = self.store.add(*self.encode([before + c for c in names]))
                held.update(zip(names, range(at, at + len(names)), strict=True))
                self.mark(at, names, bool(before))
        if pointed:
            numbers = np.array([(known[c], self.first[p[len(c):]]) for p, c in pointed], np.int64)
            at = self.store.add(self.store.ids(numbers.reshape(-1)), self.store.length[numbers].sum(1))
            names = [p for p, _ in pointed]
            known.update(zip(names, range(at, at + len(names)), strict=True))
            self.mark(at, names, bool(prefix))

    def mark(self, at: int, names: list[str], spaced: bool) -> None:
        """Which pieces begin or end with white space; an empty piece after a space ends with it."""
        while len(self.begins_white) < self.store.count:
            self.begins_white, self.ends_white, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins_white, self.ends_white, self.uses))
        self.begins_white[at:at + len(names)] = self.ends_white[at:at + len(names)] = False
        for k in [k for k, p in enumerate(names) if not p or p[0].isspace() or p[-1].isspace()]:
            p = names[k]
            self.begins_white[at + k] = not p or p[0].isspace()
            self.ends_white[at + k] = p[-1].isspace() if p else spaced

    def encode(self, texts: list[str], together: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library, one text after another, and their numbers; short texts go together, apart by what has one id of its own."""
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        whole = "".join(texts) if len(texts) >= 8 else "<|"
        if "<|" in whole or "\x01" in whole:
            found = [np.array(e.ids, np.uint32) for e in run(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))
        apart = self.special[-1] if self.spaced else " \x01 "
        made = run([apart.join(texts[i:i + together]) + apart for i in range(0, len(texts), together)], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in made])
        ends = np.flatnonzero(flat == self.apart)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.store.count > self.most or self.held > 64 * self.most:
            self.forget()
        plain = texts if self.spaced else [t.replace("\n", " ") for t in texts]
        sizes = np.fromiter((t.count(" ") + 1 for t in plain), np.int64, len(plain))
        at = starts(sizes)
        pieces = " ".join(plain).split(" ")
        opening = at[:-1]
        number = np.fromiter(map(self.later.get, pieces, repeat(-1)), np.int64, len(pieces))
        prefix = " " if self.spaced else ""
        for where, known, before in ((None, self.later, prefix), (opening, self.first, "")):
            if where is not None:
                number[where] = [known.get(pieces[i], -1) for i in where]
            missing = np.flatnonzero(number < 0) if where is None else where[number[where] < 0]
            if where is None and len(missing):
                first = np.zeros(len(pieces), bool)
                first[opening] = True
                missing = missing[~first[missing]]
            if len(missing):
                new = [pieces[i] for i in missing]
                self.learn(known, list(dict.fromkeys(new)), before)
                number[missing] = [known[p] for p in new]
        whole = np.zeros(len(texts), bool)
        if self.spaced and len(pieces) > 1:
            joined = np.flatnonzero(self.ends_white[number[:-1]] & self.begins_white[number[1:]]) + 1
            joined = joined[~np.isin(joined, opening)] if len(joined) else joined
            whole[np.searchsorted(at, joined, side="right") - 1] = True
        for i, t in enumerate(texts):
            if "<|" in t and any(s in t for s in self.special):
                whole[i] = True
        self.uses[:self.store.count] += np.bincount(number, minlength=self.store.count)
        if whole.any():
            odd, keep = np.flatnonzero(whole), ~np.repeat(whole, sizes)
            extra = self.store.add(*self.encode([texts[i] for i in odd]))
            self.mark(extra, ["x"] * len(odd), False)
            number = np.insert(number[keep], starts(np.where(whole, 0, sizes))[odd], extra + np.arange(len(odd)))
            sizes = np.where(whole, 1, sizes)
        total = np.concatenate([[0], np.cumsum(self.store.length[number])])
        at = starts(sizes)
        return self.store.ids(number), total[at[1:]] - total[at[:-1]]


def encoder(file: str, most: int = 800_000) -> Encoder:
    """One encoder for each Python worker, so that what one task has learned serves the next; results do not depend on it."""
    return remembered(("encoder", file, most), lambda: Encoder(file, most))
