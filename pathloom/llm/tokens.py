"""Encoding of text columns with a public tokenizer file; every distinct piece of text is encoded once per cache."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from itertools import repeat
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that end in a mark once they are composed or made small.
MARKED = r"\x{130}\x{958}-\x{95f}\x{9dc}-\x{9dd}\x{9df}\x{a33}\x{a36}\x{a59}-\x{a5b}\x{a5e}\x{b5c}-\x{b5d}\x{f43}\x{f4d}\x{f52}\x{f57}\x{f5c}\x{f69}\x{fb1d}\x{fb1f}\x{fb2a}-\x{fb36}\x{fb38}-\x{fb3c}\x{fb3e}\x{fb40}-\x{fb41}\x{fb43}-\x{fb44}\x{fb46}-\x{fb4e}"
#: A full stop or comma after anything but a letter or digit, or first: such texts keep their marks with what is before.
MARK_AFTER_MARK = r"^[.,]|[^\p{L}\p{N}][.,]|[" + MARKED + "][.,]"
#: Runs of white space, at an end or other than blanks and line ends.
ODD_SPACE = r"^[ \n]|[ \n][ \n]|[ \n]\z|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _joined(*parts: str | pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in (*parts, "")))


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls, made all at once."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    pieces says where a text may be cut without changing its ids: "space" for byte-level files whose pattern takes
    one leading space with a word, "word" for files that lower-case and drop white space, "text" for any file (no
    cut). Words of letters are encoded by the library many at a time, by the file's own merges and without its
    patterns, which cannot cut a run of letters; so are words with ASCII marks after them, where the patterns always
    cut. All else goes through the file as it is. Each piece is encoded once while it stays in the cache; a full cache
    keeps the pieces that came again in a later call. Texts that the cutting rule doesn't cover (runs of white space,
    other separators) are encoded whole.
    """

    PIECES, IDS = 400_000, 4_000_000

    def __init__(self, path: str, pieces: str = "text") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = {"space": self._by_space, "word": self._by_word, "text": None}[pieces]
        self.spaced = pieces == "space"
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():  # where words begin (byte level: a space) or end
            self.edge[i] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        first = pre_tokenizers.Split(" ", "merged_with_next") if self.spaced else pre_tokenizers.WhitespaceSplit()
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([first, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.bounds = array("i"), array("q", [0])
        self.ends: dict[int, int] = {}
        self.again = bytearray()  # of each piece: whether a later call had it

    def _make_room(self) -> None:
        """Keeps the pieces that came again since they were learned or since the last time; none, if those are many."""
        again = np.zeros(len(self.bounds) - 1, dtype=bool)
        again[: len(self.again)] = np.frombuffer(self.again, dtype=bool)
        stay, places = np.flatnonzero(again), (np.cumsum(again) - 1).tolist()
        again = again.tolist()
        known = {p: places[i] for p, i in self.known.items() if again[i]}
        taken = self._taken(stay)
        self._clear()
        if len(known) <= self.PIECES // 2 and len(taken.values) <= self.IDS // 2:
            self.known = known
            self.flat.frombytes(np.asarray(taken.values).tobytes())
            self.bounds = array("q", np.asarray(taken.offsets).tobytes())

    def _taken(self, codes: np.ndarray) -> pa.LargeListArray:
        """The ids of pieces, one list each, in new memory."""
        bounds, flat = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat)).take(pa.array(codes))

    @staticmethod
    def _marked(texts: pa.Array, *marks: tuple[str, str]) -> pa.Array:
        """texts with blanks before the full stops and commas at words' ends, where that doesn't change ids."""
        cut = texts
        for mark, to in marks:
            cut = pc.replace_substring(cut, mark, to)
        return pc.if_else(pc.match_substring_regex(texts, MARK_AFTER_MARK), texts, cut)

    def _by_space(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        # no other piece holds \r: it says that there is no space before
        cut = self._marked(_joined(texts, " "), (", ", " \r, "), (". ", " \r. "), (".\n", " \r.\n"))
        pieces = pc.split_pattern(_joined("\r", pc.replace_substring(cut, "\n", " \n")), " ")
        return pc.match_substring_regex(texts, ODD_SPACE), pieces

    def _by_word(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        cut = self._marked(_joined(texts, "\n"), (", ", " , "), (". ", " . "), (".\n", " .\n"))
        return pc.match_substring_regex(texts, r"[\x1c-\x1f]"), pc.ascii_split_whitespace(pc.ascii_lower(cut))

    def _text_of(self, piece: str) -> str:
        if not piece or not self.spaced or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == "\r" else " " + piece

    def _is_word(self, piece: str) -> bool:
        return piece.isalpha() and (self.spaced or piece.isascii() or (is_normalized("NFC", piece) and piece == piece.lower()))

    def _add(self, texts: list[str]) -> range:
        first = len(self.bounds) - 1
        for at in range(0, len(texts), 2000):
            for found in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False):
                self.flat.extend(found.ids)
                self.bounds.append(len(self.flat))
        return range(first, len(self.bounds) - 1)

    def _add_words(self, pieces: list[str], words: list[str]) -> None:
        """Makes pieces known that are words of letters, each with the ASCII marks after it, if any."""
        for at in range(0, len(words), 500):
            own, some = pieces[at : at + 500], words[at : at + 500]
            joined = " " + " ".join(some) if self.spaced else " ".join(some).lower()
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
            edges = np.flatnonzero(self.edge[ids])
            ends = np.append(edges[1:], len(ids)) if self.spaced else edges + 1
            if len(ends) != len(some):  # never seen: words whose ids don't show where they begin
                self.known.update(zip(own, self._add([self._text_of(p) for p in own])))
                continue
            marked = [(i, self.known[self._marks(p[len(w) :])]) for i, (p, w) in enumerate(zip(own, some)) if len(p) != len(w)]
            if marked:
                rows, codes = np.array(marked).T
                marks = self._taken(codes)
                sizes = np.zeros(len(ends), dtype=np.int64)
                sizes[rows] = np.diff(np.asarray(marks.offsets))
                ids = np.insert(ids, np.repeat(ends, sizes), np.asarray(marks.flatten()))
                ends = ends + np.cumsum(sizes)
            first = len(self.bounds) - 1
            self.bounds.frombytes((len(self.flat) + ends).astype(np.int64).tobytes())
            self.flat.frombytes(ids.tobytes())
            self.known.update(zip(own, range(first, first + len(own))))

    def _marks(self, marks: str) -> str:
        """The piece that marks make which follow a letter."""
        return "\r" + marks if self.spaced else marks

    def _learn(self, new: list[str]) -> None:
        """Makes pieces known that aren't; each is there once."""
        if self.spaced:
            return self._learn_these(new)
        # by their small letters, of which ASCII has none left; a capital sigma's small form depends on its place
        low = {p: q for p in new if not p.isascii() and "\u03a3" not in p and is_normalized("NFC", p) and (q := p.lower()) != p}
        own = [p for p in new if p not in low] if low else new
        self._learn_these([*own, *(q for q in set(low.values()).difference(own) if q not in self.known)])
        self.known.update((p, self.known[q]) for p, q in low.items())

    def _learn_these(self, new: list[str]) -> None:
        pieces, words, others = [], [], []
        for p in new:
            if self._is_word(p):
                pieces.append(p)
                words.append(p)
            elif p[-1:] in punctuation and self._is_word(w := p.rstrip(punctuation)):
                pieces.append(p)
                words.append(w)
            else:
                others.append(p)
        ends = {self._marks(p[len(w) :]) for p, w in zip(pieces, words) if len(p) != len(w)}
        others += [m for m in ends.difference(others) if m not in self.known]
        self.known.update(zip(others, self._add([self._text_of(p) for p in others])))
        self._add_words(pieces, words)

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as int32, number of ids of each), with end_id after each if given.

        Texts are cut and their pieces told apart in columns; Python sees each distinct piece of the texts once.
        """
        if len(self.known) > self.PIECES or len(self.flat) > self.IDS:
            self._make_room()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if self.cut is None:
            odd, counts, codes = np.ones(len(texts), bool), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        else:
            odd, pieces = self.cut(texts)
            odd = np.array(odd, dtype=bool)
            counts = np.array(pc.list_value_length(pieces), dtype=np.int64)
            found = pieces.flatten().dictionary_encode()
            if odd.any():
                found = found.filter(pa.array(np.repeat(~odd, counts)))
                counts[odd] = 0
            used = np.unique(np.asarray(found.indices)) if odd.any() else np.arange(len(found.dictionary))
            own = _strings(found.dictionary.take(pa.array(used)) if odd.any() else found.dictionary)
            at = np.fromiter(map(self.known.get, own, repeat(-1)), dtype=np.int64, count=len(own))
            self.again.extend(bytes(len(self.bounds) - 1 - len(self.again)))
            np.frombuffer(self.again, dtype=bool)[at[at >= 0]] = True
            if (new := np.flatnonzero(at < 0)).size:
                self._learn(some := [own[i] for i in new.tolist()])
                at[new] = np.fromiter(map(self.known.__getitem__, some), dtype=np.int64, count=len(some))
            of = np.zeros(len(found.dictionary), dtype=np.int64)
            of[used] = at
            codes = of[np.asarray(found.indices)]
        ends = np.cumsum(counts)
        if odd.any():
            at = np.flatnonzero(odd)
            codes = np.insert(codes, ends[at], self._add([texts[int(n)].as_py() for n in at]))
            ends = ends + np.cumsum(odd)
        if end_id is not None:
            if end_id not in self.ends:
                self.ends[end_id] = len(self.bounds) - 1
                self.flat.append(end_id)
                self.bounds.append(len(self.flat))
            codes = np.insert(codes, ends, self.ends[end_id])
            ends = ends + np.arange(1, len(ends) + 1)
        taken = self._taken(codes)
        done = np.asarray(taken.offsets)
        return np.asarray(taken.flatten()), np.diff((done - done[0])[np.concatenate(([0], ends))])

    def encode_with_end(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with end_id after each text."""
        return self.encode(texts, end_id)


@lru_cache(maxsize=4)
def encoder(path: str, pieces: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    return Encoder(path, pieces)
