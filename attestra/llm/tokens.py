"""Token ids of whole texts as little-endian bytes.

The tokenizer file is a parameter.  A tokenizer that cuts texts into words before it merges gives each word the same
ids wherever it stands, so the ids of a word are kept and each distinct word of a task is encoded once; a text with
characters for which the cut could differ from the plain one below is encoded as a whole by the library.
"""
from __future__ import annotations

import functools
import json
import re
from typing import Sequence

#: fixed value: the cut of the word tokenizer, as its file states it
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: the same cut over lower-cased characters up to U+017F without control characters
PLAIN_CUT = re.compile("[a-zªµºß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼½¾]+")
#: anything for which PLAIN_CUT is not used: other characters, control characters, the start of a special token
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ňŊ-ž]|<\\|")
KEPT_WORDS = 600_000


class Encoder:
    """``encode(texts)`` gives, for each text, its ids as bytes of ``dtype`` (little-endian)."""

    def __init__(self, path: str, dtype: str = "<u4"):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self._of, self._dtype, self._kept = Tokenizer.from_file(path), np.dtype(dtype), {}
        cut = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        steps = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers", [])]
        self._by_word = cut == WORD_CUT and steps == ["NFC", "Replace", "Lowercase"]
        vocabulary = self._of.get_vocab()
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        if self._dtype.itemsize < 4 and self._of.get_vocab_size() > 2 ** (8 * self._dtype.itemsize):
            raise ValueError(f"{dtype} cannot hold {self._of.get_vocab_size()} ids")

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self._dtype).tobytes() for e in self._of.encode_batch(list(texts), add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """All at once, parted by spaces: the last id of a word, and only that, ends with the word-end mark."""
        import numpy as np

        ids = np.array(self._of.encode(" ".join(words), add_special_tokens=False).ids, self._dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._whole(words)
        own, width, bounds = ids.tobytes(), self._dtype.itemsize, [0, *ends.tolist()]
        return [own[a * width:b * width] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self._by_word:
            return self._whole(texts)
        out = []
        for t in texts:
            if NOT_PLAIN.search(t):
                out += self._whole([t])
                continue
            words = PLAIN_CUT.findall(t.lower())
            new = list(set(words).difference(self._kept))
            if new:
                if len(self._kept) + len(new) > KEPT_WORDS:
                    self._kept, new = {}, list(set(words))
                self._kept.update(zip(new, self._words(new)))
            out.append(b"".join(map(self._kept.__getitem__, words)))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder per worker process, so that words stay known from task to task."""
    return Encoder(path, dtype)
