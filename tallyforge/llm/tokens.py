"""Token ids of documents by a public vocabulary, in bounded slices of Arrow batches."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tallyforge.llm.common import slices

#: The id that ends each document.
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Longer runs without a blank, and longer texts, go to the ``tokenizers`` library, whose time is not quadratic in a run.
LONG_RUN, LONG_TEXT = 2_000, 1_000_000
#: The pieces that byte-level BPE merges within (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 itself, then the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts by a byte-level BPE file of the ``tokenizers`` library, and marks the ids that end a sentence.

    Where the file's ids are its merge order, ``tiktoken`` gives the same ids several times faster and is used
    for all but texts with very long runs; tests compare the two.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 2, bool)
        for token, i in vocabulary.items():
            ends[i] = token.rstrip("\"')]Ċ").endswith((".", "!", "?")) or "Ċ" in token
        self.ends_sentence = ends
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        to_byte = _bytes_of()
        special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        merges = [m if isinstance(m, str) else " ".join(m) for m in held["model"].get("merges", [])]
        own = held["model"]["vocab"]
        in_order = all(own.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        self.fast = None
        if in_order and (held.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not held["pre_tokenizer"].get("add_prefix_space"):
            ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in own.items() if t not in special}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, with END_ID behind."""
        if self.fast is None or len(text) > LONG_TEXT or len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        return np.append(found, np.uint32(END_ID))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) of each row in order; a null text is an empty one, so its ids are END_ID alone."""
    enc = encoder(path)
    for batch in batches:
        for part in slices(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                yield doc_id, enc.ids(text or "")
