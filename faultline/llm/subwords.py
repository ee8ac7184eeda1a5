"""Public subword ids of texts, with the ids of words kept between texts."""

from __future__ import annotations

import array
import codecs
import os
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from faultline.llm.common import Memo


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed values of byte-level vocabularies: how a text falls into runs that are encoded alone, and the letters that stand for bytes
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
# Unicode versions of the tokenizers and regex libraries may tell letters and numbers apart differently only here (tested for every code point)
_ODD = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U00010000-\U0001efff\U0002a6e0-\U0010ffff]")
# end of fixed values


# a place between pieces: a single space between characters that no library takes for white space
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
_SHIFTED = dict(zip((b for b in range(256) if b not in _PLAIN), range(256, 512)))
_LETTERS = "".join(chr(_SHIFTED.get(b, b)) for b in range(256))


class Subwords:
    """Byte-level ids (below 65,536) of whole texts, as little-endian 16-bit integers, by the tokenizer's own model.

    A text is cut at single spaces between other characters, where no run of the tokenizer crosses. Words repeat,
    so the ids of a piece, and of the runs in it, are looked up if they were met before; the new pieces of a batch of texts fall
    into runs together. A text with other white space next to a space is cut at its other spaces. A text that holds
    the content of an added token, and a piece with a code point on which the run pattern and the library may differ, go
    through the library's own call. `most` bounds the pieces and the runs kept (of each up to twice as many, some 200 bytes
    apiece); those of more than `LONG` characters are kept for one batch alone.
    """

    LONG = 100
    #: Pieces looked up, or put together, at a time.
    TOGETHER = 50_000

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.most = Tokenizer.from_file(path), most
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.runs = Memo(lambda run: self._runs_alone([run])[0])
        self.pieces = Memo(lambda piece: self._ids(" " + piece))
        self.long: list[tuple[Memo, str]] = []

    def _runs_alone(self, runs: list[str]) -> list[bytes]:
        model = self.model.tokenize
        letters = [codecs.charmap_decode(r.encode("utf-8", "surrogatepass"), "strict", _LETTERS)[0] for r in runs]
        self.long += [(self.runs, r) for r in runs if len(r) > self.LONG]
        return [array.array("H", [t.id for t in model(x)]).tobytes() for x in letters]

    def _ids(self, text: str) -> bytes:
        """Ids of a text by itself."""
        if _ODD.search(text) or self._has_added(text):
            return array.array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.runs.__getitem__, _RUNS.findall(text)))

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces after a space. Each run that begins with a space begins a piece, but for pieces of a kind that are asked one by one."""
        self.long += [(self.pieces, p) for p in pieces if len(p) > self.LONG]
        joined = " " + " ".join(pieces)
        alone = {p for p in pieces if not p or p.strip() != p}
        if joined.count(" ") > len(pieces) or _ODD.search(joined) or self._has_added(joined):
            alone.update(p for p in pieces if " " in p or _ODD.search(p) or self._has_added(p))
        some = [p for p in pieces if p not in alone] if alone else pieces
        if not some:
            return [self._ids(" " + p) for p in pieces]
        runs = _RUNS.findall(" " + " ".join(some) if alone else joined)
        self.runs.fill(set(filterfalse(self.runs.__contains__, runs)), self._runs_alone)
        ids = list(map(self.runs.__getitem__, runs))
        begin = [i for i, r in enumerate(runs) if r[0] == " "]
        found = [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(begin, [*begin[1:], len(runs)])]
        if not alone:
            return found
        found = iter(found)
        return [self._ids(" " + p) if p in alone else next(found) for p in pieces]

    def _after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(self.pieces.get, pieces))
        others = [i for i, ids in enumerate(found) if ids is None]
        self.pieces.fill([pieces[i] for i in others], self._learn)
        for i in others:
            found[i] = self.pieces[pieces[i]]
        self._forget()
        return found

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words (without ASCII white space), each after a space. They are not kept, their runs are."""
        texts = b" ".join(words).decode("utf-8", "replace").split(" ") if words else []
        out = []
        for a in range(0, len(texts), self.TOGETHER):
            out += self._learn(texts[a : a + self.TOGETHER])
            self._forget()
        return out

    def _forget(self) -> None:
        for kept, key in self.long:
            kept.pop(key, None)
        self.long.clear()
        self.runs.trim(self.most)
        self.pieces.trim(self.most)

    def _numbered(self, cut: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where texts begin, the numbers of their pieces, and the distinct pieces."""
        coded = cut.flatten().dictionary_encode()
        begin = cut.offsets.to_numpy()
        return begin - begin[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()

    def _cut_ids(self, begin: np.ndarray, place: np.ndarray, distinct: list[str]) -> list[bytes]:
        """Ids of texts of at least one piece each; each distinct piece is looked up once."""
        first = begin[:-1]
        inner = np.zeros(len(distinct), bool)
        inner[np.delete(place, first)] = True
        ids: list[bytes] = [b""] * len(distinct)
        some = np.flatnonzero(inner).tolist()
        for a in range(0, len(some), self.TOGETHER):
            for i, x in zip(some[a : a + self.TOGETHER], self._after_space([distinct[i] for i in some[a : a + self.TOGETHER]])):
                ids[i] = x
        ids += [self._ids(distinct[i]) for i in place[first]]
        place[first] = len(distinct) + np.arange(len(first))  # a text's first piece has no space before it
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        start, every = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint16)
        out = []
        for a in range(0, len(place), self.TOGETHER):
            at = place[a : a + self.TOGETHER]
            n = size[at]
            out.append(every[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        out = np.concatenate(out)
        end = np.cumsum(size[place])[begin[1:] - 1]
        return [out[a:b].tobytes() for a, b in zip([0, *end[:-1].tolist()], end.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        begin, place, distinct = self._numbered(pc.split_pattern(pa.array(texts, pa.large_string()), " "))
        # texts with white space beside a space are cut elsewhere, those with an added token not at all
        odd = np.array([not p or p.strip() != p for p in distinct], bool)
        whole = np.array([self._has_added(t) for t in texts], bool)
        apart = whole if not odd.any() else whole | (np.add.reduceat(odd[place], begin[:-1]) > 0)
        if not apart.any():
            return self._cut_ids(begin, place, distinct)
        out: list[bytes] = [b""] * len(texts)
        plain = np.flatnonzero(~apart)
        if len(plain):
            size = np.diff(begin)
            rest = place[np.repeat(~apart, size)]
            for i, ids in zip(plain.tolist(), self._cut_ids(np.concatenate([[0], np.cumsum(size[plain])]), rest, distinct)):
                out[i] = ids
        recut = np.flatnonzero(apart & ~whole).tolist()
        if recut:
            pieces = pa.array([_CUT.split(texts[i]) for i in recut], pa.large_list(pa.large_string()))
            for i, ids in zip(recut, self._cut_ids(*self._numbered(pieces))):
                out[i] = ids
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._ids(texts[i])
        return out


_made: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """One instance for each file and process."""
    if path not in _made:
        _made[path] = Subwords(path)
    return _made[path]


def release() -> None:
    """Gives up this process' instances and what they keep; later stages don't need them."""
    _made.clear()
