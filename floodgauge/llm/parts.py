"""Coding texts by their parts: a block of texts is cut at spaces by Arrow, each distinct part is coded
once, and the ids of all texts are gathered from those of the parts by numpy.

Codes of parts are kept in a bounded cache of the worker process, as Arrow and numpy arrays: as Python
objects they took several times the memory. A final run of ASCII punctuation behind a letter is coded
apart from what is before it, so that a word is known with and without it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from floodgauge.llm.common import strings

#: Parts of one cached generation per worker process, tails likewise, and the longest part that stays
#: in the cache: bounds on memory only.
CACHED_PARTS, CACHED_TAILS, CACHED_CHARS = 450_000, 20_000, 80
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters in every version of Unicode whose lower case is one letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Every character that some library takes for white space.
WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

Ragged = tuple[np.ndarray, np.ndarray]  # ids of all rows, and the bounds of the rows


def ragged(rows: list[bytes]) -> Ragged:
    bounds = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 4, out=bounds[1:])
    return np.frombuffer(b"".join(rows), "<u4"), bounds


def stack(*several: Ragged) -> Ragged:
    """The rows of all, one after the other."""
    shift = np.cumsum([0] + [int(b[-1]) for _, b in several])
    return np.concatenate([v for v, _ in several]), np.concatenate([[0], *[b[1:] + s for (_, b), s in zip(several, shift)]])


def take(rows: Ragged, index: np.ndarray) -> Ragged:
    values, at = rows
    length = (at[1:] - at[:-1])[index]
    bounds = np.zeros(len(index) + 1, np.int64)
    np.cumsum(length, out=bounds[1:])
    place = np.repeat(at[:-1][index] - bounds[:-1], length)
    place += np.arange(len(place))
    return values[place], bounds


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _places(words: pa.Array, keys: pa.Array) -> np.ndarray:
    """Where each word is among the keys, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=keys), -1).to_numpy().astype(np.int64)


class KnownParts:
    """Ids by part, in two generations like generations.Generations: when ``young`` is full it becomes
    the old one, from which parts in use come back."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.young: tuple[pa.Array, Ragged] | None = None
        self.old: tuple[pa.Array, Ragged] | None = None

    def rows(self, words: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> Ragged:
        """Ids of the (distinct) words; ``learn`` gives those of the words not known."""
        none = words.slice(0, 0), ragged([])
        if self.young is not None and len(self.young[0]) > self.capacity:
            self.old, self.young = self.young, None
        keys, known = self.young or none
        old_keys, old = self.old or none
        index = _places(words, keys)
        missing = np.flatnonzero(index < 0)
        back = _places(words.take(pa.array(missing)), old_keys)
        new = words.take(pa.array(missing[back < 0]))
        added = stack(take(old, back[back >= 0]), ragged(learn(strings(new)) if len(new) else []))
        order = np.concatenate([missing[back >= 0], missing[back < 0]])
        index[order] = len(keys) + np.arange(len(order))
        both = stack(known, added)
        came = words.take(pa.array(order))
        short = _mask(pc.less_equal(pc.utf8_length(came), CACHED_CHARS))
        kept = both if short.all() else stack(known, take(added, np.flatnonzero(short)))
        self.young = pa.concat_arrays([keys, came.filter(pa.array(short))]), kept
        return take(both, index)


class PartCoder:
    """``code`` gives the ids (unsigned 32-bit, as bytes) of strings that stand alone.

    ``spaced``: the tokenizer splits text by the byte-level pattern (letters, digits, other signs, each
    with one space before it), so that a space belongs to the part after it and a text with runs of
    white space is coded whole; else white space only separates. ``folds``: case does not count.
    ``special``: strings with this beginning may be special tokens and are left to ``code`` whole.
    ``cached``: parts of a generation of the cache.
    """

    def __init__(self, code: Callable[[list[str]], list[bytes]], spaced: bool = True, folds: bool = False, special: str = "<|", cached: int = CACHED_PARTS):
        self.code, self.spaced, self.folds, self.special = code, spaced, folds, special
        self.known, self.tails = KnownParts(cached), KnownParts(CACHED_TAILS)

    def _learn(self, cores: list[str]) -> list[bytes]:
        return self.code([c if c[:1] == "\n" else " " + c for c in cores] if self.spaced else cores)

    def _split(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """(cores, which parts have a tail, those tails)."""
        cut = pc.utf8_rtrim(parts, characters=PUNCTUATION)
        ends = pc.and_(pc.match_substring_regex(cut, f"[{LETTERS}]$"), pc.invert(pc.match_substring(parts, self.special)))
        has = pc.and_(ends, pc.less(pc.binary_length(cut), pc.binary_length(parts)))
        cores = pc.if_else(has, cut, parts)
        if self.folds:
            plain = pc.match_substring_regex(cores, f"^[{LETTERS}]+$")
            cores = pc.if_else(plain, pc.utf8_lower(cores), cores)
        return cores, _mask(has), pc.replace_substring_regex(parts.filter(has), f"(?s)^.*[{LETTERS}]", "")

    def _parts(self, parts: pa.Array) -> Ragged:
        """Ids of distinct parts."""
        cores, has, tails = self._split(parts)
        core, tail = cores.dictionary_encode(), tails.dictionary_encode()
        words, signs = core.dictionary, tail.dictionary
        out = stack(self.known.rows(words, self._learn), self.tails.rows(signs, self.code), ragged([b""]))
        pairs = np.full((len(parts), 2), len(words) + len(signs))  # the last row, the empty one, where there is no tail
        pairs[:, 0] = core.indices.to_numpy()
        pairs[has, 1] = tail.indices.to_numpy() + len(words)
        values, bounds = take(out, pairs.ravel())
        return values, bounds[::2]

    def _whole(self, parts: pa.Array, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts in which white space does not stand alone, or is neither space nor line end."""
        good = _mask(pc.match_substring_regex(parts, rf"^\n?[^{WHITE}]+$"))
        lone = _mask(pc.or_(pc.equal(parts, ""), pc.equal(parts, "\n")))  # white space follows, but at the end
        bad, inner = ~(good | lone)[index], lone[index]
        inner[at[1:] - 1] = inner[at[:-1]] = False
        return np.logical_or.reduceat(bad | inner, at[:-1])

    def encode(self, texts: pa.Array, end: int | None = None) -> Ragged:
        """Ids of each text, null counting as empty, and the ``end`` id after each."""
        if not len(texts):
            return ragged([])
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "), " ")
        at, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        parts, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        rows = self._parts(parts)
        if self.spaced:  # the first part has no space before it
            whole = self._whole(parts, index, at)
            first = parts.take(pa.array(index[at[:-1]])).to_pylist()
            for i, text in zip(np.flatnonzero(whole).tolist(), texts.filter(pa.array(whole)).to_pylist()):
                first[i] = text
            index[np.repeat(whole, np.diff(at))] = len(parts) + len(texts)
            index[at[:-1]] = len(parts) + np.arange(len(texts))
            rows = stack(rows, ragged(self.code(first)), ragged([b""]))
        if end is not None:
            index, at = np.insert(index, at[1:], len(rows[1]) - 1), at + np.arange(len(at))
            rows = stack(rows, ragged([np.array([end], "<u4").tobytes()]))
        values, bounds = take(rows, index)
        return values, bounds[at]
