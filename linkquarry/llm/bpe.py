"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes places chunk borders, so passages that documents share are cut alike
wherever they stand. A chunk's inside, between its first and last proven token boundary (see ``tokens``), is
encoded once in a worker process and reused by later documents; the two ragged ends that meet at a border are
encoded again as one joint. Where a chunk holds no proven boundary, the joint widens over it to the next one, so
the pieces always begin and end where the whole text's encoding has a boundary, and their ids in sequence are
exactly those of the whole text. Decoding is shared in the same way: every piece is decoded once, when it is
encoded.

Chunks are shared within a worker process and not across the cluster: ids are four bytes for about four of text, so to
shuffle chunks and their ids would move more than the text itself.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns, kept, text_bytes
from linkquarry.llm.tokens import Coder, common_ground, default_vocabulary, spelt_bytes

#: A border stands where this many low bits of the hash are zero: about every 2 KB.
BORDER_BITS = 11
#: Bytes of text whose ids a worker keeps (in each of two generations).
CACHE_BYTES = 4 << 20

_WORDY = np.zeros(256, bool)
_WORDY[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \n\t\r"]] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of it and the 15 before it (fewer at the start), by doubling windows."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    power = 0x01000193
    for width in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] if width < len(h) else h[:0]
        h = h + shifted * np.uint32(power)
        power = power * power & 0xFFFFFFFF
    return h ^ (h >> np.uint32(15))


def piece_borders(data: np.ndarray, at: np.ndarray, bits: int = BORDER_BITS) -> list[np.ndarray]:
    """Byte positions at which each text is cut, its start and end included: proven boundaries around the hash's borders."""
    border = np.flatnonzero((rolling_hash(data) & np.uint32((1 << bits) - 1)) == 0)
    proven = np.flatnonzero(_SPACE[data[1:]] & _WORDY[data[:-1]]) + 1
    k = np.searchsorted(proven, border, side="right")
    near = np.unique(np.concatenate([proven[k[k > 0] - 1], proven[k[k < len(proven)]]])) if len(proven) else proven
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        inside = near[np.searchsorted(near, s, side="right") : np.searchsorted(near, e, side="left")]
        out.append(np.concatenate([[s], inside, [e]]).astype(np.int64))
    return out


class ChunkEncoder:
    """Encodes texts by shared pieces; two generations of a bounded cache."""

    def __init__(self, path: str, bits: int = BORDER_BITS, cache_bytes: int = CACHE_BYTES):
        self.coder, self.bits, self.cache_bytes = Coder(path), bits, cache_bytes
        self.spelling = spelt_bytes(self.coder.tokenizer)
        self.young: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.old: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.held = self.encoded = 0

    def _encode(self, pieces: dict[bytes, tuple[np.ndarray, bytes] | None], odd: set[bytes]) -> None:
        """Fill in the ids and the decoded bytes of each piece; ``odd`` ones are not on common ground (see ``tokens``)."""
        missing = []
        for piece in pieces:
            if (hit := self.young.get(piece) or self.old.get(piece)) is None:
                missing.append(piece)
            else:
                pieces[piece] = hit
        ids = self.coder.encode([p.decode("utf-8") for p in missing], [p not in odd for p in missing])
        for piece, own in zip(missing, ids, strict=True):
            decoded = b"".join(map(self.spelling.__getitem__, own))
            if decoded != piece:  # bytes that are no UTF-8 decode as the library has it
                decoded = decoded.decode("utf-8", "replace").encode("utf-8")
            # Text that decodes as itself is held once.
            pieces[piece] = (np.frombuffer(array("I", own), dtype="<u4"), piece if decoded == piece else decoded)
            self.encoded += len(piece)
            if self.held > self.cache_bytes:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[piece] = pieces[piece]
            self.held += len(piece)

    def run(self, texts: pa.Array) -> list[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text."""
        data, at = text_bytes(texts)
        raw, borders = data.tobytes(), piece_borders(data, at, self.bits)
        cut = [[raw[a:b] for a, b in zip(x[:-1], x[1:], strict=True) if b > a] for x in borders]
        pieces: dict = dict.fromkeys(p for x in cut for p in x)
        cuts = np.unique(np.concatenate([at, *borders]))
        odd = np.flatnonzero(~common_ground(data, cuts))
        self._encode(pieces, {raw[a:b] for a, b in zip(cuts[odd].tolist(), cuts[odd + 1].tolist(), strict=True)})
        none = np.zeros(0, "<u4")
        return [(np.concatenate([pieces[p][0] for p in x]) if x else none, b"".join(pieces[p][1] for p in x)) for x in cut]


def encoder(path: str, bits: int, cache_bytes: int) -> ChunkEncoder:
    """The worker process's own encoder, whose cache outlives a task."""
    return kept(("encoder", path, bits, cache_bytes), lambda: ChunkEncoder(path, bits, cache_bytes))


def encode_decode(docs: DataFrame, path: str | None = None, text_col: str = "text", with_ids: bool = False, with_decoded: bool = False, bits: int = BORDER_BITS, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, where asked for, ``ids`` and ``decoded``.

    ``ids_sha256`` digests the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the decoded text in
    UTF-8. A null or empty text has no ids and decodes to the empty text. No special tokens are added.
    """
    path = path or default_vocabulary()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_decoded:
        fields += [T.StructField("decoded", T.StringType())]

    def make():
        own = encoder(path, bits, cache_bytes)

        def compute(texts: pa.Array) -> list:
            done = own.run(texts)
            out = [[len(i) for i, _ in done], [hashlib.sha256(i.tobytes()).hexdigest() for i, _ in done], [hashlib.sha256(d).hexdigest() for _, d in done]]
            if with_ids:
                at = np.cumsum([0, *(len(i) for i, _ in done)], dtype=np.int32)
                flat = np.concatenate([i for i, _ in done]).astype(np.int32) if done else np.zeros(0, np.int32)
                out += [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            if with_decoded:
                out += [[d.decode("utf-8", "replace") for _, d in done]]
            return out

        return compute

    return append_columns(docs, text_col, T.StructType(fields), make, keeps=True)
