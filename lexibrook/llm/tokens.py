"""Token ids of the `tokenizers` library, by word: equal to encode(), with each distinct word merged once.

Both vocabularies cut a text into words before anything is merged, so ids of a text are the ids of its words in order. Texts
whose characters are all in SAFE (ASCII and the letters of Latin-1) are cut here, on Latin-1 bytes: first at spaces, then each
unseen run into words, and each unseen word is merged. Runs and words are kept with their packed ids in a cache of two generations
of CACHE entries (about 80 MB), so memory is bounded. All other texts go whole to the library, and so does a text that spells one of
the vocabulary's special tokens, which the library turns into that token's id. A file whose normalizer or pre-tokenizer isn't one of the
two that are cut here is encoded by the library alone."""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

LETTERS = rb"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF"
SAFE = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
SUFFIX = rb"'s|'t|'re|'ve|'m|'ll|'d|"
BYTE_LEVEL = re.compile(SUFFIX + rb" ?[%b]+| ?[0-9]+| ?[^\s0-9%b]+|\s+(?!\S)|\s+" % (LETTERS, LETTERS))
WORD_LEVEL = re.compile(SUFFIX + rb"[%b]+|[0-9]|[^\s0-9%b]+" % (LETTERS, LETTERS))
LOWER = bytes(i + 32 if 65 <= i <= 90 or 0xC0 <= i <= 0xDE and i != 0xD7 else i for i in range(256))
CACHE = 300_000
#: How the two vocabulary files cut texts, which WORD_LEVEL and BYTE_LEVEL repeat for SAFE texts.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
BYTE_FORM = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


class Known(dict):
    """Bytes -> their packed ids; what is missing is taken from the generation before, or made."""

    def __init__(self, make, before: dict | None = None) -> None:
        self.make, self.before = make, before or {}

    def __missing__(self, x: bytes) -> bytes:
        got = self.before.get(x)
        if got is None:
            got = self.make(x)
        self[x] = got
        return got


def printable() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(odd)) for b in range(256)}


def merger(library, spec: dict):
    """Bytes of a word -> ids, by merging the pair whose union has the least id, where that equals the library's merges; else None.

    It does if ids rise in the order of merges and the library makes each entry of the vocabulary from its own characters: by
    induction over merges, two neighbours whose union is an entry are then the very pair of that entry's merge, since merges
    inside a stretch of text that nothing merges across depend on that stretch alone. Both are checked here. A mark for the end
    of a word is the byte FF, which no UTF-8 text has."""
    import tiktoken

    model, value = spec["model"], {c: b for b, c in printable().items()}
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    never = printable()[0xF8]
    special = {t["content"] for t in spec["added_tokens"]}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    merged = [vocab[m] for m in merges]
    if merged != sorted(set(merged)) or merged and merged[0] < len(vocab) - len(merged) - len(special):
        return None
    ranks = {}
    for piece, k in vocab.items():
        if piece not in special:
            last = bool(end) and piece.endswith(end)
            text = piece[: -len(end)] if last else piece
            inside = bool(end) and not last  # such an entry never ends a word: a byte that nothing merges with follows
            if [t.id for t in library.model.tokenize(text + never * inside)] != [k] + [vocab[never + end]] * inside:
                return None
            ranks[bytes(value[c] for c in text) + b"\xff" * last] = k
    if end:
        ranks.setdefault(b"\xff", 1 << 30)
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    mark, merge = b"\xff" if end else b"", core._core_bpe.encode_single_piece
    return (lambda word: merge(word + mark)) if mark else merge


class Encoder:
    """special_as_text: the strings of special tokens are ordinary text, which isn't the library's default."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, form = Tokenizer.from_file(path), (spec.get("normalizer"), spec.get("pre_tokenizer"))
        self.library.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple(t["content"].encode("latin-1", "replace") for t in spec["added_tokens"])
        self.known = form in (WORD_FORM, BYTE_FORM) and not any(t["normalized"] for t in spec["added_tokens"])
        self.lower, self.bytes = form == WORD_FORM, printable()
        self.cut = (WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        self.merge = self.known and merger(self.library, spec) or self.slow
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.words, self.runs = Known(self.word), Known(self.run)  # runs: in word_bpe between white space, in byte_bpe after a space

    def fresh(self) -> None:
        """A new generation of the cache; the one before that before is forgotten."""
        for known in (self.words, self.runs):
            known.before = {}
        self.words, self.runs = Known(self.word, self.words), Known(self.run, self.runs)

    def slow(self, word: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word.decode("latin-1").translate(self.bytes))]

    def word(self, word: bytes) -> bytes:
        return array(self.kind, self.merge(word if word.isascii() else word.decode("latin-1").encode())).tobytes()

    def run(self, run: bytes) -> bytes:
        if run.isalpha():  # ASCII letters: one word
            return array(self.kind, self.merge(run if self.lower else b" " + run)).tobytes()
        parts = self.cut(run if self.lower else b" " + run)
        if len(parts) == 1:
            return self.word(parts[0])
        if self.lower:
            return b"".join([self.runs[p] for p in parts])
        return b"".join([self.runs[p[1:]] if len(p) > 1 and p[0] == 32 else self.words[p] for p in parts])  # what a run of its own would be is looked up as such

    def packed(self, text: str | None, end: int) -> bytes:
        """The ids of the text and the end id, as unsigned numbers of `kind`."""
        last = array(self.kind, [end]).tobytes()
        try:
            raw = (text or "").encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or not self.known or raw.translate(None, SAFE) or any(x in raw for x in self.special):
            return array(self.kind, self.library.encode(text or "", add_special_tokens=False).ids).tobytes() + last
        if len(self.words) + len(self.runs) > CACHE:
            self.fresh()
        if self.lower:  # words never hold white space
            return b"".join(map(self.runs.__getitem__, raw.translate(LOWER).split())) + last
        if b"  " in raw:  # white space at which words part in ways that depend on both sides
            return b"".join(map(self.words.__getitem__, self.cut(raw))) + last
        first, *rest = raw.split(b" ")  # a space before anything but a space starts a word
        return b"".join([*map(self.words.__getitem__, self.cut(first)), *map(self.runs.__getitem__, rest), last])

    def ids(self, text: str | None, end: int):
        """The same as an array of unsigned 32-bit numbers."""
        return self.unpacked(self.packed(text, end))

    def unpacked(self, data: bytes):
        import numpy as np

        return np.frombuffer(data, self.kind).astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, special_as_text)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
