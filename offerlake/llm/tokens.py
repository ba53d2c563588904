"""Token ids of whole texts by a public byte-level BPE vocabulary, each distinct word encoded once.

A text is cut where a single space or newline stands between two non-space characters: the vocabulary's
pre-tokeniser never joins across such a place, so a word's ids don't depend on its neighbours. Arrow splits
a batch and finds its distinct words; those that the worker has not met are encoded, and numpy lays their ids
out. Texts with other white space or a special token go to the ``tokenizers`` library whole. Single words go
to ``tiktoken``, which holds the same vocabulary and needs a quarter of the time; the ids are the same.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os

import numpy as np

#: Words remembered in one worker.
CACHE_WORDS = 200_000
#: White space other than single spaces and newlines between words.
_UNEVEN = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class TextTokenizer:
    def __init__(self, path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._opens = np.zeros(max(ranks.values()) + 1, bool)
        self._opens[[i for token, i in ranks.items() if token[:1] in (b" ", b"\n")]] = True
        self._word_ids = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        #: Place of each word among the known ones; where its ids start among all of theirs, and how many they are.
        self._place: dict[str, int] = {}
        self._ids, self._size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _places(self, words: list[str], openers: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct words, each with the space or newline before it, and of texts' first words, after encoding the new ones."""
        if len(self._place) + len(words) + len(openers) > CACHE_WORDS:
            self._forget()
        new = [w for w in words if w not in self._place]
        if new:
            # Encoded in one call: a word's first token is the only one that starts with its space or newline.
            ids = np.array(self._word_ids("".join(new)), np.uint32)
            self._learn(new, ids, np.diff(np.append(np.flatnonzero(self._opens[ids]), len(ids))))
        new = list(dict.fromkeys(w for w in openers if w not in self._place))
        if new:
            found = [self._word_ids(w) for w in new]
            self._learn(new, np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        place = self._place.__getitem__
        return np.fromiter(map(place, words), np.int64, len(words)), np.fromiter(map(place, openers), np.int64, len(openers))

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._place |= zip(words, range(len(self._place), len(self._place) + len(words)), strict=True)
        self._size, self._ids = np.append(self._size, sizes), np.append(self._ids, ids)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow string array; null as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, ""))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = whole.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(whole):
            out[i] = self.encode(texts[int(i)].as_py())
        even = np.flatnonzero(~whole)
        if len(even):
            units = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
            first = units.offsets.to_numpy().astype(np.int64)
            coded = units.values.dictionary_encode()
            words = [w if w[:1] == "\n" else " " + w for w in coded.dictionary.to_pylist()]
            openers = units.values.take(pa.array(first[:-1])).to_pylist()  # no space before them
            place, opening = self._places(words, openers)
            at = place[coded.indices.to_numpy()]
            at[first[:-1]] = opening
            size = self._size[at]
            end = np.cumsum(size)
            start = np.cumsum(self._size) - self._size
            ids = self._ids[np.arange(end[-1]) + np.repeat(start[at] - (end - size), size)]
            ends = end[first[1:] - 1]
            for i, a, b in zip(even, np.append(0, ends), ends, strict=False):
                out[i] = ids[a:b]
        return out


@functools.cache
def tokenizer_of(path: str, ranks_path: str, pattern: str) -> TextTokenizer:
    """One a worker, with the words it has met."""
    return TextTokenizer(path, ranks_path, pattern)


def default_tokenizer() -> TextTokenizer:
    import public_tokenizers as files

    return tokenizer_of(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
