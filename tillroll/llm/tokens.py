"""Token ids of whole texts inside Spark tasks, with the `tokenizers` library.

A file that drops white space, lowers case and splits as ``_WORD_RULES`` say gives a text the ids of
its words in turn: each distinct word is encoded once per cache life and looked up after that. Any
other file encodes whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PARTS_KEPT = 200_000
_KNOWN = 2_000_000
_KNOWN_BYTES = 64 << 20
_SLICE = 4 << 20

#: words whose ids the model gives directly: visible ASCII without the apostrophe, Latin-1 letters
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write a byte as its own printable character, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    spare = {b: chr(256 + i) for i, b in enumerate(others)}
    return [spare.get(b, chr(b)) for b in range(256)]


def _lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case: other bytes of UTF-8 are above them all."""
    _, offsets, data = texts.buffers()
    lowered = pa.py_buffer(data.to_pybytes().lower() if data else b"")
    return pa.Array.from_buffers(
        texts.type, len(texts), [None, offsets, lowered], offset=texts.offset
    )


# The rules of a tokenizers file that `WordEncoder` follows.
_WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {
                    "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
                },
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextEncoder:
    """Encodes whole texts by whatever rules the tokenizers file has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit, little-endian) and each text's first position in them."""
        written = pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()
        coded = self.tokenizer.encode_batch(written, add_special_tokens=False)
        lists = [np.array(c.ids, "<u4") for c in coded]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        return np.concatenate([np.zeros(0, "<u4"), *lists]), starts


class WordEncoder:
    """Encodes texts word by word; ``path`` is a tokenizers file of ``_WORD_RULES``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        #: words met so far and their ids, row by row
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= _PARTS_KEPT:
                self.parts.clear()
            written = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            ids = [t.id for t in self.tokenizer.model.tokenize(written)]
            found = self.parts[part] = array("I", ids).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if len(word) > 200 or _PLAIN(word) is None or "<|" in word:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self._part, _PARTS(word.lower())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit, little-endian) and each text's first position in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = _lower(texts)  # as the vocabulary does, but for its special tokens
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        taken = self.ids.take(pa.array(place[coded.indices.to_numpy()]))
        offsets = taken.offsets.to_numpy() if len(taken) else np.zeros(1, np.int64)
        flat = taken.values.to_numpy() if len(taken) else np.zeros(0, "<u4")
        per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
        return flat, offsets[per_text]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word's ids are; new words are encoded and added."""
        if len(self.known) + len(words) > _KNOWN or self.known.nbytes > _KNOWN_BYTES:
            self._forget()
        found = pc.index_in(words, value_set=self.known).to_numpy(zero_copy_only=False)
        new = np.isnan(found) if found.dtype.kind == "f" else np.zeros(len(found), bool)
        place = np.where(new, 0, found).astype(np.int64)
        place[new] = len(self.known) + np.arange(int(new.sum()))
        added = words.filter(pa.array(new))
        encoded = [self._word(w) for w in added.to_pylist()]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(encoded), "<u4"))
        self.known = pa.concat_arrays([self.known, added])
        self.ids = pa.concat_arrays([self.ids, ids])
        return place


def follows_word_rules(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    plain = not (model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout"))
    marks = all(t["content"].startswith("<|") for t in spec["added_tokens"])
    same = all(spec.get(part) == rules for part, rules in _WORD_RULES.items())
    return same and marks and plain and model["type"] == "BPE"


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder | TextEncoder:
    return WordEncoder(path) if follows_word_rules(path) else TextEncoder(path)


def slices(
    batches: Iterator[pa.RecordBatch], text: int, size: int = _SLICE
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of column ``text``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // size
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            if b > a:
                yield batch.slice(a, b - a)


def with_end(flat: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put id ``end`` behind every text."""
    n = len(starts) - 1
    moved = starts + np.arange(n + 1)
    ids = np.full(len(flat) + n, end, "<u4")
    inside = np.ones(len(ids), bool)
    inside[moved[1:] - 1] = False
    ids[inside] = flat[: starts[-1]]
    return ids, moved


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
