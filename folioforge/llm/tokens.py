"""Token ids by the tokenizers library, each distinct word of a slice of texts encoded once; shared by packing and the id files."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioforge.llm.shared import slices

TOKEN_SLICE = 12_000_000  # bytes of the texts that are encoded together
LIBRARY_CHARS = 200_000  # characters, and 10 for each string, that the library encodes at once, as it holds 100 bytes for each id that it returns
_SPACED = re.compile(r"\s \s|\s $")
_MARKS = ".,!?;:$%&*#|"
_SPACES = "\t\r\x0b\x0c"
_WIDE_SPACES = "\x85\xa0                　"
_OPENING, _LINE = "\x01", "\x02"  # stand before a text's first piece, and for the end of a line, where a leading space matters
_LATIN_DOTTED_I = "İ"  # lower-cased, it ends in a combining mark


def _holds(text: str, some: str) -> bool:
    return any(ch in text for ch in some)


def _spaced(text: str) -> bool:
    """Whether a space stands between white space, or at the end after some."""
    if "  " in text or "\n " in text or _holds(text, _SPACES) or not text.isascii() and _holds(text, _WIDE_SPACES):
        return _SPACED.search(text) is not None
    return False


def _bytes_from(words: pa.StringArray, least: int) -> np.ndarray:
    """Whether a word has a UTF-8 byte of `least` or more."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]] if words.buffers()[2] is not None else np.empty(0, np.uint8)
    high = np.concatenate([[0], np.cumsum(raw >= least, dtype=np.int32)])
    return high[offsets[1:]] > high[offsets[:-1]]


def _listed(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.uint32()))


class WordTokenizer:
    """Ids of whole texts, equal to tokenizer.encode(text, add_special_tokens=False).ids.

    Both kinds of public BPE split texts into words before merging, so a piece of text that ends where a word must
    end has the same ids wherever it stands. Pieces are what stands between spaces: for vocabularies that drop white
    space as it is (`joined` False), for byte-level ones with the space before it (`joined` True). Arrow finds the
    distinct pieces of a slice; each is encoded once by the library. Letters with marks behind them are two pieces
    where no letter becomes anything but a letter by the vocabulary's normalisation: scripts up to Armenian, whose
    letters compose with marks only, without U+0130. All other pieces are encoded as they are, and byte-level texts
    where the split would not be exact (runs of spaces, strings of special tokens, U+0001) whole.
    """

    def __init__(self, path: str, joined: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.joined = Tokenizer.from_file(path), joined
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that open (joined) or close a word of letters
        for token, k in vocabulary.items():
            self.edge[k] = token.startswith("Ġ") if joined else token.endswith("</w>")
        self.folds = not joined and self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of strings, every one by itself."""
        parts, sizes = [np.empty(0, np.uint32)], []
        for a, b in slices([len(s) + 10 for s in strings], LIBRARY_CHARS):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(strings[a:b], add_special_tokens=False)]
            sizes += map(len, got)
            parts.append(np.fromiter((x for i in got for x in i), np.uint32, sum(map(len, got))))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def _letters(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of letters, 500 of them to a string; the ids' edges tell them apart, and where they don't each is encoded alone."""
        lead = " " if self.joined else ""
        parts, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        bounds = np.append(np.arange(0, len(words), 500), len(words)).astype(np.int32)
        strings = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), " ").to_pylist()
        for a, b in slices([len(s) + 10 for s in strings], LIBRARY_CHARS):
            for k, e in enumerate(self.tokenizer.encode_batch_fast([lead + s for s in strings[a:b]], add_special_tokens=False), a):
                ids = np.array(e.ids, np.uint32)
                edge = np.flatnonzero(self.edge[ids])
                if edge.size != bounds[k + 1] - bounds[k] or not (edge[0] == 0 if self.joined else edge[-1] == ids.size - 1):
                    ids, size = self._each([lead + w for w in words[bounds[k] : bounds[k + 1]].to_pylist()])
                else:
                    size = np.diff(edge, append=ids.size) if self.joined else np.diff(edge, prepend=-1)
                parts.append(ids)
                sizes.append(size)
        return np.concatenate(parts), np.concatenate(sizes)

    def _pieces(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct pieces. A joined piece is meant with a space before it, one behind _OPENING as it is, one behind _LINE with a line end."""
        head = pc.ascii_rtrim(words, characters=_MARKS)
        letters = pc.utf8_is_alpha(head).to_numpy(zero_copy_only=False) & ~_bytes_from(words, 0xD6) & ~pc.match_substring(words, _LATIN_DOTTED_I).to_numpy(zero_copy_only=False)
        marks = np.where(letters, pc.binary_length(words).to_numpy() - pc.binary_length(head).to_numpy(), 0)
        heads = head.filter(pa.array(letters)).dictionary_encode()
        first, second = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[letters] = heads.indices.to_numpy()
        tails: list[str] = []
        for n in np.unique(marks[marks > 0]).tolist():  # marks are ASCII: as many characters as bytes
            found = pc.utf8_slice_codeunits(words.filter(pa.array(marks == n)), start=-n).dictionary_encode()
            second[marks == n] = len(heads.dictionary) + len(tails) + found.indices.to_numpy()
            tails += found.dictionary.to_pylist()
        others = words.filter(pa.array(~letters)).to_pylist()
        if self.joined:
            others = [w[1:] if w[:1] == _OPENING else "\n" + w[1:] if w[:1] == _LINE else " " + w for w in others]
        first[~letters] = len(heads.dictionary) + len(tails) + np.arange(len(others))
        made = [self._letters(heads.dictionary), self._each(tails), self._each(others)]
        table = _listed(np.concatenate([m[0] for m in made]), np.concatenate([*(m[1] for m in made), [0]]))
        second[marks == 0] = len(table) - 1
        both = table.take(pa.array(np.stack([first, second], axis=1).ravel()))
        return pa.ListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def encode(self, texts: pa.Array | list, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); null texts are empty; `end` is appended to each text where given."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        n, whole = len(texts), {}
        if self.joined:
            strings = texts.to_pylist()
            for k, t in enumerate(strings):
                if "<|" in t or _OPENING in t or _LINE in t or _spaced(t):
                    whole[k], strings[k] = t, ""
                elif "\n" in t and "\n\n" not in t and not _holds(t, _SPACES) and not (not t.isascii() and _holds(t, _WIDE_SPACES)):
                    strings[k] = t.replace("\n", " " + _LINE)  # a line end between other characters is a word
            texts = pc.binary_join_element_wise(_OPENING, pa.array(strings, pa.string()), "")
            del strings
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0] if n else 0
        coded = split.flatten().dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary
        del split, coded, texts
        if self.folds:  # case first: fewer distinct pieces. Not where marks may compose with a letter
            plain = ~_bytes_from(words, 0xCC)
            coded = pc.if_else(pa.array(plain), pc.ascii_lower(words), words).dictionary_encode()
            word, words = coded.indices.to_numpy()[word], coded.dictionary
        table = self._pieces(words)
        odd = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in whole.values()]
        tail = [np.fromiter((x for i in odd for x in i), np.uint32), np.array([] if end is None else [end], np.uint32)]
        sizes = np.concatenate([np.diff(table.offsets.to_numpy()), [len(i) for i in odd], [tail[1].size]])
        table = _listed(np.concatenate([table.values.to_numpy(), *tail]), sizes)
        if whole:
            word = word.astype(np.int64)
            word[bounds[list(whole)]] = len(words) + np.arange(len(odd))  # the one piece of an emptied text
        slot = np.full(word.size + n, len(table) - 1)
        slot[np.arange(word.size) + np.repeat(np.arange(n), np.diff(bounds))] = word
        got = table.take(pa.array(slot))
        ends = got.offsets.to_numpy()[bounds[1:] + np.arange(1, n + 1)].astype(np.int64) if n else np.empty(0, np.int64)
        return got.values.to_numpy(), np.diff(ends, prepend=0)


_HELD: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, joined: bool) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, kept from task to task; it remembers no words."""
    if (path, joined) not in _HELD:
        _HELD.clear()
        _HELD[path, joined] = WordTokenizer(path, joined)
    return _HELD[path, joined]
