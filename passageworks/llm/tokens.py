"""Token ids of a whole corpus under a public byte-level BPE vocabulary.

Method: forced-boundary splitting.  A BPE merge always yields a vocabulary
token, so two neighbouring bytes that occur side by side in no token can never
end up in one token: between them a cut is certain.  Each text is cut at such
places, the fragments are encoded one by one (and remembered), and the ids are
concatenated.

Two kinds of certain cuts are used:

* before a single space that stands between two visible characters.  It is a
  boundary of the vocabulary's splitting pattern, and the pair (byte, space)
  occurs inside no token, which is checked against the vocabulary when the
  encoder is built;
* inside each piece of the splitting pattern, between any two bytes whose pair
  no token contains.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bound of the vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Fragments remembered by one Python worker, and the longest one worth it.
MEMO_FRAGMENTS, MEMO_CHARS = 300_000, 48

_WHITE = frozenset(x for x in map(chr, range(0x3001)) if x.isspace())


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """Where the installed public vocabulary lies."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"{folder}/{name}"


def split_pattern() -> str:
    """The splitting pattern that belongs to the vocabulary (that of the installed package)."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Memo(dict):
    """Packed ids by fragment; ``prefix`` stands before each key.  Forgets everything when full."""

    def __init__(self, encode, prefix: str):
        self._encode, self._prefix = encode, prefix

    def __missing__(self, fragment: str) -> bytes:
        packed = self._encode(self._prefix + fragment)
        if len(fragment) <= MEMO_CHARS:
            if len(self) >= MEMO_FRAGMENTS:
                self.clear()
            self[fragment] = packed
        return packed


class ForcedBoundaryEncoder:
    """Encodes texts by certain cuts; equal to encoding each text at once."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self._core = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._pieces = regex.compile(pattern).findall
        self._ranks = ranks
        #: 1 at a << 8 | b for the pairs of bytes that stand side by side in some token.
        self._pairs = bytearray(1 << 16)
        for token in ranks:
            for a, b in pairwise(token):
                self._pairs[a << 8 | b] = 1
        self.space_cuts = not any(self._pairs[a << 8 | 0x20] for a in range(0x21, 0x7F))
        self._certain = re.compile(r"(?<=\S)(?= \S)").split
        self._plain, self._spaced = _Memo(self._fragment, ""), _Memo(self._fragment, " ")

    def _fragment(self, text: str) -> bytes:
        ids: list[int] = []
        ranks, pairs, encode = self._ranks, self._pairs, self._core.encode_single_piece
        for piece in self._pieces(text):
            raw = piece.encode("utf-8", "replace")
            whole = ranks.get(raw)
            if whole is not None:
                ids.append(whole)
                continue
            start = 0
            for at in [i for i, (a, b) in enumerate(pairwise(raw), 1) if not pairs[a << 8 | b]]:
                ids += encode(raw[start:at])
                start = at
            ids += encode(raw[start:])
        return array("i", ids).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text`` as 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        if not self.space_cuts:
            return self._fragment(text)
        # a space beside any other white space is no certain cut of the pattern
        beside = _WHITE.intersection(text)
        if text[0] != " " != text[-1] and not any(x + " " in text or " " + x in text for x in beside):
            first, *rest = text.split(" ")
            return b"".join([self._plain[first], *map(self._spaced.__getitem__, rest)])
        return b"".join(map(self._plain.__getitem__, self._certain(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


@lru_cache(maxsize=2)
def _encoder(path: str, size: int, pattern: str, vocabulary: _Vocabulary) -> ForcedBoundaryEncoder:
    """An encoder, made once per worker process for each vocabulary and pattern."""
    return ForcedBoundaryEncoder(vocabulary.shared.value, pattern)


class _Vocabulary:
    """The broadcast bytes, which take no part in the key of the cache."""

    def __init__(self, shared: Broadcast):
        self.shared = shared

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Vocabulary)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids array<int>`` of every row of ``df``, without special tokens.

    * null or empty text: an empty list; blank text is encoded as it is;
    * the strings of special tokens in a text are ordinary text;
    * repeated rows each give their row, null keys stay null, an empty table
      gives an empty table; other columns are left out whatever their names;
    * very long texts cost time in proportion, since no fragment spans a
      certain cut.

    No shuffle: one scan of two columns and one Arrow pass.
    """
    path = vocabulary or default_vocabulary()
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary {path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared, name, size = _Vocabulary(df.sparkSession.sparkContext.broadcast(raw)), hashlib.sha256(raw).hexdigest(), len(raw)
    splitting = pattern or split_pattern()
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, size, splitting, shared)
        for batch in batches:
            packed = [encoder.packed(value) for value in batch.column(1).to_pylist()]
            offsets = array("i", [0, *accumulate(len(x) // 4 for x in packed)])
            ids = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())]), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
