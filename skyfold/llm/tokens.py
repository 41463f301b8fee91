"""Token ids of whole texts; through a cache of words for tokenizers that split at white space and drop it."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache
from itertools import compress

import numpy as np

from .words import release

#: Words that one worker process remembers at most, in two generations.
CACHE_WORDS = 2_400_000
_EDGE = re.compile(rb"[a-z]{2,}[.,]")


_PUNCT = (b".", b",")
#: A special token of the tokenizer, which keeps words apart that are encoded together.
_JOINT = "<|endoftext|>"
#: Words of lower-case Latin letters: one piece for the tokenizer's splitting, unchanged by its composing and lower-casing.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet by its public rule: printable bytes stand for themselves, the others for code points from 256 on.
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _lower(text: bytes) -> bytes:
    """A-Z lower-cased, as the tokenizer does after composing characters; not where combining marks (lead bytes CC, CD) might compose first."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


#: What a tokenizer file must say for the way by words: these steps never join characters across a space or a line feed.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer of a file lower-cases, drops white space, splits as _SPLIT says, and has the token that keeps words apart."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return d.get("normalizer") == _NORMALIZER and d.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and any(t["content"] == _JOINT for t in d.get("added_tokens", []))


class PlainTokenizer:
    """Ids as little-endian 32-bit bytes, text by text, by any tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(texts), 64) for e in self.tokenizer.encode_batch([t or "" for t in texts[k : k + 64]], add_special_tokens=False)]


class WordTokenizer:
    """Ids as little-endian 32-bit bytes, through a cache of words.

    The tokenizer's own splitting never joins characters across a space or a line feed, so a text's ids are those
    of its pieces in order; and between ASCII letters and one final full stop or comma it always splits.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.generation = cache_words // 2
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.path, self.joined = path, Tokenizer.from_file(path)
        self.joint = self.joined.token_to_id(_JOINT)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, WhitespaceSplit()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def tokenizer(self):
        """For the rare words that look like special tokens: in texts these are ordinary text, between joined words they are not."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _fetch(self, words: set[bytes]) -> list[bytes]:
        """Move words from the old generation to the new one; return those in neither."""
        missing = words.difference(self.known)
        again = missing.intersection(self.old)
        old = self.old
        self.known.update([(w, old[w]) for w in again])
        return list(missing.difference(again))

    def _learn(self, new: list[bytes]) -> None:
        """Plain lower-case words are encoded together, without the steps that leave such words as they are."""
        texts = b"\n".join(new).decode().split("\n") if new else []
        plain = [_PLAIN.fullmatch(t) is not None for t in texts]
        self._encode_joined(self.letters, [t.encode().decode("latin-1").translate(_BYTE_CHARS) for t in compress(texts, plain)], list(compress(new, plain)))
        odd = [not p and "<|" in t for t, p in zip(texts, plain, strict=True)]
        for t, w in zip(compress(texts, odd), compress(new, odd), strict=True):
            self.known[w] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        rest = [not (p or o) for p, o in zip(plain, odd, strict=True)]
        self._encode_joined(self.joined, list(compress(texts, rest)), list(compress(new, rest)))

    def _encode_joined(self, tokenizer, texts: list[str], names: list[bytes]) -> None:
        for k in range(0, len(texts), 512):
            ids = np.array(tokenizer.encode(_JOINT.join(texts[k : k + 512]), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.joint), len(ids)) * 4
            flat = ids.tobytes()
            self.known.update([(w, flat[a:b]) for w, a, b in zip(names[k : k + 512], [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [_lower((t or "").encode()).replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.known) > self.generation:
            self.known, self.old = {b"": b""}, self.known
        new = self._fetch(set().union(*split))
        edged = [w for w in new if w[-1:] in _PUNCT and _EDGE.fullmatch(w)]
        if edged:
            self._learn(self._fetch(set(new).difference(edged).union([w[:-1] for w in edged], _PUNCT)))
            known = self.known
            known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in edged])
        else:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, own)) for own in split]


@lru_cache(2)
def tokenizer_of(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer | PlainTokenizer:
    """The way by words where the file allows it, else the plain one; both give the tokenizer's ids."""
    return WordTokenizer(path, cache_words) if splits_at_spaces(path) else PlainTokenizer(path)


def forget() -> None:
    """Let go of a worker's tokenizers and the words they remember: workers live on, and the memory is then another operator's."""
    if tokenizer_of.cache_info().currsize:
        tokenizer_of.cache_clear()
        release()
