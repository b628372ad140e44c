"""Token ids of a public tokenizer file, fast enough for whole corpora.

A byte-level BPE never joins characters across the units that its pattern cuts a text into, so the ids of each unit are
kept in a bounded cache as little-endian unsigned 32-bit bytes. Frequent units cost one dictionary
look-up. Texts with unusual characters or control strings go to the tokenizers library whole. Machines are taken to be
little-endian, as all that Spark runs on at scale are.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

#: Letters and numbers up to U+024F, and the units of the vocabulary's own pattern within that range.
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r"
UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
#: Other white space, and characters on which the libraries might not agree (those up to U+024F are tested one by one):
#: a text with any of them is encoded whole by the file's own library.
ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0]|[^\x00-\u024f]")
#: Longer units, and more units than this, are not kept.
UNIT_CHARS, UNITS = 32, 250_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _merger(spec: dict):
    """A tiktoken encoding equal to the file, or None where the file is not a plain byte-level BPE in rank order."""
    import tiktoken
    from public_tokenizers import PATTERN

    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, at = model["vocab"], _byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    for i, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if vocab.get(a + b) != 256 + i:
            return None
    ranks = {bytes(at[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Units(dict):
    """Unit -> bytes of its ids."""

    def __init__(self, merger):
        self.encode = merger.encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        out = array("I", self.encode(unit)).tobytes()
        if len(unit) <= UNIT_CHARS and len(self) < UNITS:
            self[unit] = out
        return out


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit bytes, without added tokens."""

    def __init__(self, path: str):
        self.units = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text, num_threads=1)
            self.decode = lambda ids: model.decode(ids)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda text: model.encode(text, add_special_tokens=False).ids
            self.decode = lambda ids: model.decode(ids, skip_special_tokens=False)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            if merger := _merger(spec):
                self.units = _Units(merger)
                self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def word(self, word: str) -> bytes:
        """ids(" " + word) of a word that is not expected again: the cache of units is left alone."""
        if self.units is not None and not ODD.search(word) and "<|" not in word:
            return array("I", self.units.encode(" " + word)).tobytes()
        return array("I", self._encode(" " + word)).tobytes()

    def ids(self, text: str) -> bytes:
        if self.units is not None and not ODD.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.units.__getitem__, UNIT.findall(text)))
        return array("I", self._encode(text)).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file. Workers live on after a task: those that go on to other work call release()."""
    return Encoder(path)


def release() -> None:
    """Lets go of the encoders of this process."""
    encoder.cache_clear()
