"""Token ids and spans of whole texts by the tokenizers library, each distinct word encoded once per worker.

For tokenizers that drop white space and never join over it (such as word_bpe_49k.json), the ids of a text are those
of its words between ASCII white space, one after another. Words are told apart by Arrow, encoded by the library and
put together by numpy; tests compare the result with the library's encoding of whole texts. Whether a tokenizer is one of
these is tried when it is loaded; the texts of others are encoded as a whole.
"""

from __future__ import annotations

import functools
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.shared import joined_bytes, ragged, whole_texts
from siftline.llm.words import word_spans

#: Largest number of words that a worker remembers, and of their bytes; then it starts anew.
MEMORY, MEMORY_BYTES = 400_000, 8 << 20
# A letter or digit before a stop or comma ends a word of the tokenizer, so both sides can be encoded apart.
_STOPPED = re.compile(r"(.*[A-Za-z0-9À-ɏ])([.,]+)", re.S).fullmatch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    return max(_load(path).get_vocab(with_added_tokens=True).values()) + 1


#: Texts that a tokenizer must encode like their words, to be used by words.
_PROBES = ("ab  cd\n\nEf. gh,\tIj", " a b ", "x\r\ny z", "don't  stop... 12 345\n", "é ß\u00a0ü <tag> \"q\"")


class _Known:
    """Distinct words with a few integers each, as arrays."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, words: pa.Array, values: list[list[int]] | list[np.ndarray]) -> None:
        counts = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter((x for v in values for x in v), np.uint32, int(counts.sum()))
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.r_[self.ends, len(self.flat) + np.cumsum(counts)]
        self.flat = np.r_[self.flat, flat]


class Encoder:
    """What a worker remembers of words: their ids or their spans."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.tokenizer, self.memory = _load(path), memory
        self.lower = all(t.content == t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known = {False: _Known(), True: _Known()}
        self.by_words = all(self._alone(t) == [x for w in re.split(r"[\x20\x09-\x0D]+", t) if w for x in self._alone(w)] for t in _PROBES)

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _library(self, words: list[str], spans: bool) -> list[list[int]]:
        out: list = []
        for start in range(0, len(words), 8192):
            part = words[start: start + 8192]
            if spans:
                out += [[x for span in e.offsets for x in span] for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            else:
                out += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn(self, new: pa.Array, spans: bool) -> None:
        words = new.to_pylist()
        if spans:
            values = self._library(words, True)
        else:
            cut = [m.groups() if (m := _STOPPED(w)) else (w,) for w in words]
            parts = list({p for c in cut for p in c})
            ids = dict(zip(parts, self._library(parts, False)))
            values = [ids[c[0]] if len(c) == 1 else ids[c[0]] + ids[c[1]] for c in cut]
        self.known[spans].add(new, values)

    def _values(self, texts: pa.Array, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The remembered integers of all words of all texts; how many each word has; the n + 1 offsets of the texts
        in the words; the texts without nulls. Empty words are left out."""
        filled = whole_texts(texts)
        # the tokenizer lower-cases anyway, but a special token in capitals must not turn into one
        lower = self.lower and not pc.any(pc.match_substring(filled, "<|")).as_py()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(filled) if lower else filled)
        flat = lists.flatten()
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        starts = lists.offsets.to_numpy()
        coded = flat.dictionary_encode()
        known = self.known[spans]
        if len(known.words) + len(coded.dictionary) > self.memory or known.words.nbytes + coded.dictionary.nbytes > MEMORY_BYTES:
            known.__init__()
        where = pc.index_in(coded.dictionary, value_set=known.words)
        if where.null_count:
            missing = pc.is_null(where)
            base = len(known.words)
            collecting = gc.isenabled()
            gc.disable()  # the many short-lived lists hold no cycles
            try:
                self._learn(coded.dictionary.filter(missing), spans)
            finally:
                if collecting:
                    gc.enable()
            place = pc.fill_null(where, 0).to_numpy().copy()
            place[missing.to_numpy(zero_copy_only=False)] = np.arange(base, len(known.words))
        else:
            place = where.to_numpy()
        word = place[coded.indices.to_numpy()[size]]
        first = np.r_[0, known.ends]
        each = (first[1:] - first[:-1])[word]
        return known.flat[ragged(first[word], each)], each, np.r_[0, np.cumsum(size)][starts - starts[0]], filled

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the n + 1 offsets of the texts in them."""
        if not self.by_words:
            found = self._library(whole_texts(texts).to_pylist(), False)
            return np.fromiter((x for ids in found for x in ids), np.uint32), np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
        ids, each, offsets, _ = self._values(texts, False)
        return ids, np.r_[0, np.cumsum(each)][offsets]

    def encode_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every token, in characters of all texts one after another; the offsets of the texts in
        the tokens; their offsets in the characters."""
        if not self.by_words:
            filled = whole_texts(texts)
            found = [np.array(x, np.int64) for x in self._library(filled.to_pylist(), True)]
            data, byte_offsets = joined_bytes(filled)
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][byte_offsets]
            spans = np.concatenate([np.zeros(0, np.int64), *(x + at for x, at in zip(found, chars))])
            return spans[::2], spans[1::2], np.r_[0, np.cumsum([len(x) // 2 for x in found])].astype(np.int64), chars
        found, each, offsets, filled = self._values(texts, True)
        data, byte_offsets = joined_bytes(filled)
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        each = each // 2
        shift = np.repeat(chars[word_spans(data, byte_offsets)[0]], each)
        return found[::2] + shift, found[1::2] + shift, np.r_[0, np.cumsum(each)][offsets], chars[byte_offsets]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)
