"""Token ids of whole texts by a tokenizers file, encoded once per distinct word.

The file's normaliser turns white space into spaces and its pre-tokeniser drops them, so a text's ids
are those of its words one after another. Words are split at U+0020 and U+0009 to U+000D, all of them
white space to the file; what lies between is encoded by the library itself and kept in a bounded
table per worker. A file of another kind has its texts encoded whole by the library. Special tokens
that stand in a text become their ids, as the library has it.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

from .common import Growing, Numbers, held, offsets, spread

#: Distinct words kept per worker before the table starts afresh (about 150 bytes each).
TABLE_WORDS = 400_000
#: A word of Latin letters (each its own composed form) and then marks: two pieces to the pre-tokeniser,
#: which the model can be given without the normaliser.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
#: How byte-level models write the bytes of those letters: U+0080 to U+00FF stand for themselves from
#: U+00A1 on (U+00AD apart), the rest from U+0100 + 33 up.
WRITTEN = {
    c: "".join(chr(b if b >= 0xA1 and b != 0xAD or b < 0x7F else 0x143 if b == 0xAD else 0xA2 + b) for b in chr(c).encode())
    for c in range(0xC0, 0x100)
}
#: Special token that ends a document.
END_ID = 1
#: The normaliser and pre-tokeniser of files whose texts may be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        spaced = any(re.search(r"\s", t["content"]) for t in file["added_tokens"])
        alike = (file["normalizer"], file["pre_tokenizer"], file["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None)
        self.by_words = alike and not spaced and file["model"]["type"] == "BPE"
        self.clear()

    def clear(self) -> None:
        self.numbers, self.lengths, self.pool = Numbers(), Growing(np.int64), Growing(np.uint32)
        self.starts = Growing(np.int64)
        self.pieces: dict[str, tuple[int, ...]] = {"": ()}

    def piece(self, written: str) -> tuple[int, ...]:
        ids = self.pieces.get(written)
        if ids is None:
            ids = self.pieces[written] = tuple(t.id for t in self.tokenizer.model.tokenize(written))
        return ids

    def ids_of(self, words: list[str]) -> list:
        out: list = [None] * len(words)
        others = []
        for i, word in enumerate(words):
            if m := PLAIN.fullmatch(word):
                letters, marks = m.groups()
                letters = letters.lower()
                out[i] = self.piece(letters if letters.isascii() else letters.translate(WRITTEN)) + self.piece(marks)
            else:
                others.append(i)
        found = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        for i, encoding in zip(others, found, strict=True):
            out[i] = tuple(encoding.ids)
        return out

    def encode(self, texts: list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (uint32) and each text's number of ids; null is as empty."""
        if not self.by_words:
            return self.encode_whole(texts, end_id)
        if self.numbers.full(TABLE_WORDS):
            self.clear()
        numbers, counts = self.numbers.of_texts(texts)
        if self.numbers.fresh:
            fresh = [w.decode("utf-8", "replace") for w in self.numbers.fresh]
            self.numbers.fresh = []
            gc.disable()  # else it walks all the lists kept here, again and again
            ids = self.ids_of(fresh)
            gc.enable()
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts.extend(self.pool.n + np.cumsum(lengths) - lengths)
            self.lengths.extend(lengths)
            self.pool.extend(np.fromiter((i for own in ids for i in own), np.uint32, int(lengths.sum())))
        lengths = self.lengths.view()[numbers]
        flat = self.pool.view()[spread(self.starts.view()[numbers], lengths)]
        n_ids = np.diff(offsets(lengths)[offsets(counts)])
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(n_ids), end_id)
            n_ids = n_ids + 1
        return flat, n_ids

    def encode_whole(self, texts: list, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        ids = [e.ids if end_id is None else [*e.ids, end_id] for e in found]
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.uint32, int(n_ids.sum())), n_ids


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file."""
    return held(f"words {path}", lambda: WordEncoder(path))
