"""Exact batch encoding with the public tokenizers library.

White space always ends a token of ``word_bpe_49k`` (its normalizer turns runs
of white space into one space, its pre-tokenizer never joins across one), so a
text's ids are the ids of its white-space separated words put together.  Each
distinct word of a batch is encoded once and the ids are gathered with numpy.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; words remembered between batches.
SLICE_BYTES = 8 << 20
CACHE_WORDS = 700_000

TOKENIZER_FILE = "word_bpe_49k.json"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


#: Signs that end a run of letters and stay one run among themselves; neither apostrophes nor the brackets of special tokens are here.
TAIL = ".,;:!?&%*#$)(-_+=/"
#: Words that may be parted from such signs: letters that stay letters to the last when normalized.  The dotted capital I does not (its dot
#: would join the signs), and other scripts have such letters too; their words are encoded whole.
PARTED = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏЀ-џ]+$"


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest for characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes arrays of texts; memory is bounded by the slice and the cache."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.start, self.length = array("I"), array("i", [0]), array("i", [0])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.start)
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)

    def _learn(self, words: list[str]) -> None:
        """Latin letters need no normalization but lower case, and are one run: the library's model takes them as they are. All else goes through the whole tokenizer."""
        tokenize, letters, rest = self.model.tokenize, self.letters, []
        for word in words:
            low = word.lower()
            if low.isalpha() and max(word) < "\u0250" and max(low) < "\u0250":
                if low not in self.known:
                    own = low if low.isascii() else low.encode().decode("latin-1").translate(letters)
                    self._keep(low, [t.id for t in tokenize(own)])
                if low != word:
                    self.known[word] = self.known[low]
            else:
                rest.append(word)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for word, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self._keep(word, enc.ids)

    def _entries(self, words: pa.Array) -> np.ndarray:
        """Positions in the cache of distinct words."""
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        own = np.fromiter(map(known.get, distinct, repeat(-1)), np.int32, len(distinct))
        if len(new := np.flatnonzero(own < 0).tolist()):
            words = [distinct[i] for i in new]
            self._learn(words)
            own[new] = [known[w] for w in words]
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]]; a null text has none."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = words.offsets.to_numpy(zero_copy_only=False)
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        distinct = coded.dictionary
        if not len(distinct):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        core = pc.utf8_rtrim(distinct, characters=TAIL)
        two = pc.match_substring_regex(core, PARTED)  # letters and a tail: two runs of the pre-tokenizer, whose ids follow one another
        core = pc.if_else(two, core, distinct)
        parts = np.zeros((len(distinct), 2), np.int32)  # the entry of no word is 0
        parts[:, 0] = self._entries(core)
        tailed = np.flatnonzero(pc.not_equal(pc.binary_length(distinct), pc.binary_length(core)).to_numpy(zero_copy_only=False))
        parts[tailed, 1] = self._entries(pc.replace_substring_regex(distinct.take(tailed), PARTED[:-1], ""))
        start, length = np.frombuffer(self.start, np.int32), np.frombuffer(self.length, np.int32)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        part = parts[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        bounds = 2 * (bounds - bounds[0])
        del words, coded, distinct, core, parts
        counts = length[part]
        ends = np.zeros(len(part) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        at = np.repeat((start[part] - ends[:-1]).astype(np.int32), counts)  # a slice has far fewer than 2**31 ids
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], ends[bounds]


def slices(batch: pa.RecordBatch, column: str = "text"):
    """The batch in runs of rows of at most SLICE_BYTES of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    done = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto
