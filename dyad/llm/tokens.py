"""Byte-level BPE ids of whole texts with the ``tokenizers`` library.

Words repeat, texts do not: a batch is split before single spaces, the distinct
chunks are found with Arrow's dictionary encoding, only chunks not seen lately
are encoded, and the texts' ids are gathered from the chunks' ids.

Cutting before a space is exact for this tokenizer: its pre-tokenizer attaches
one space to the word that follows, so a token never spans the cut, unless the
space belongs to a run of spaces.  Texts with two spaces in a row, or with the
text of a special token, are encoded whole."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dyad.llm.common import ranges

#: id that ends a document
END_ID = 2
#: chunks kept per Python worker (about 200 bytes each); once full, it keeps what it has: frequent chunks come early
CACHE_CHUNKS = 1_000_000
#: text encoded at once
SLICE_BYTES = 4 << 20
#: texts encoded per call when they cannot be split
WHOLE_BATCH = 64

_ENCODERS: dict[str, ChunkEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> ChunkEncoder:
    """The worker's byte-level encoder for a tokenizer file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        _ENCODERS[path] = ChunkEncoder(tokenizer, " ", "|".join(["  ", *special]))
    return _ENCODERS[path]


class ChunkEncoder:
    """Encodes texts by their chunks between single spaces.  ``space`` goes
    before every chunk but a text's first; texts that match ``whole`` are not split."""

    def __init__(self, tokenizer, space: str, whole: str) -> None:
        self._tokenizer, self._space, self._whole = tokenizer, space, whole
        self._cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)``: the concatenated ids of the texts (null: none) and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self._whole).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._split(texts)
        lengths = np.zeros(len(texts), np.int64)
        easy, lengths[~whole] = self._split(texts.filter(pa.array(~whole)))
        hard_texts = texts.filter(pa.array(whole)).to_pylist()
        hard = [ids for at in range(0, len(hard_texts), WHOLE_BATCH) for ids in self._encode(hard_texts[at : at + WHOLE_BATCH])]
        lengths[whole] = [len(x) // 4 for x in hard]
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        out[ranges(starts[~whole], lengths[~whole])] = easy
        out[ranges(starts[whole], lengths[whole])] = np.frombuffer(b"".join(hard), "<u4")
        return out, lengths

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = parts.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        first = offsets[:-1]  # a text's first chunk has no space before it
        ids, lengths = self._chunks(pc.binary_join_element_wise(self._space, coded.dictionary, "").to_pylist())
        starts = np.cumsum(lengths) - lengths
        heads, head_lengths = self._chunks(coded.dictionary.take(pa.array(at[first])).to_pylist())
        piece_lengths = lengths[at]
        piece_lengths[first] = head_lengths
        piece_starts = starts[at]
        piece_starts[first] = len(ids) + np.cumsum(head_lengths) - head_lengths
        every = np.concatenate([ids, heads])[ranges(piece_starts, piece_lengths)]
        ends = np.concatenate([[0], np.cumsum(piece_lengths)])
        return every, ends[offsets[1:]] - ends[offsets[:-1]]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cache = self._cache
        new = [c for c in dict.fromkeys(chunks) if c not in cache]
        made = self._encode(new)
        room = max(CACHE_CHUNKS - len(cache), 0)
        cache.update(zip(new[:room], made))
        if len(new) <= room:
            found = list(map(cache.__getitem__, chunks))
        else:
            rest = dict(zip(new[room:], made[room:]))
            found = [cache[c] if c in cache else rest[c] for c in chunks]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), lengths


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Every document's ids followed by ``end_id``."""
    full = lengths + 1
    out = np.full(int(full.sum()), end_id, np.uint32)
    out[ranges(np.cumsum(full) - full, lengths)] = ids
    return out, full
