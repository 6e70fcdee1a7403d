"""Tokenizer loading and exact token counts of documents of any length.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a proven
boundary in their overlap: a white-space character behind a letter, a digit or a full stop. The pattern that cuts
text before the merges has no look-behind and lets white space start a piece but never follow other characters in
it, so whatever stands on either side of such a place is tokenised independently of the other side. The place
must also be a token boundary in both encodings. Where an overlap has none, it is doubled and encoded again, up to
the whole chunk, which then joins its neighbour.

Texts of one chunk go to a second library that holds the same ranks and the same pattern and is several times
quicker, wherever the two are proven equal (``Coder``); all others go to the library that the counts are defined by.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns, kept, text_bytes

CHUNK = 16_384
OVERLAP = 256


def load_tokenizer(path: str):
    """A tokenizer as its file describes it, one thread, without truncation or padding; read once in a process, not in each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def read():
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return kept(("tokenizer", path), read)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\v\f\r"]] = True
#: Bytes of a run of white space, or of anything else, up to which the quick library is asked.
RUN = 4096


def common_ground(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which of the UTF-8 texts between the cuts have only characters of up to three bytes, which tests compare one by one in both libraries, and no long run."""
    space = _SPACE[data]
    turns = np.unique(np.concatenate([cuts, np.flatnonzero(space[1:] != space[:-1]) + 1]))
    odd = np.concatenate([turns[:-1][np.diff(turns) > RUN], np.flatnonzero(data >= 0xF0)])
    fine = np.ones(max(0, len(cuts) - 1), bool)
    fine[np.searchsorted(cuts, odd, side="right") - 1] = False
    return fine


def spelt_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, whose tokens spell each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(spelt[c] for c in name) if all(c in spelt for c in name) else name.encode("utf-8") for name in names]


class Coder:
    """Ids of texts as the library of a tokenizer file gives them, by the quicker library where both are the same.

    They are the same for a byte-level BPE whose merges stand in order of their ids, split by the usual pattern without
    prefix space or normalisation, on texts of ``common_ground`` that hold no added token. A file of another kind
    leaves everything to its own library.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        told = json.loads(self.tokenizer.to_str())
        model, split = told["model"], told.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in told["added_tokens"]]
        usual = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not told.get("normalizer")
        usual = usual and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        self.quick = None
        if usual:
            ids, first = model["vocab"], len(model["vocab"]) - len(model["merges"])
            if first == 256 and all(ids["".join(pair if isinstance(pair, list) else pair.split(" "))] == first + i for i, pair in enumerate(model["merges"])):
                import public_tokenizers
                import tiktoken

                spelling = spelt_bytes(self.tokenizer)
                self.quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks={spelling[i]: i for i in ids.values()}, special_tokens={})

    def encode(self, texts: list[str], fine: list[bool]) -> list[list[int]]:
        """Ids of each text; ``fine`` tells which are on common ground."""
        out: list = [None] * len(texts)
        slow = []
        for i, (text, ok) in enumerate(zip(texts, fine, strict=True)):
            if ok and self.quick is not None and not any(a in text for a in self.added):
                out[i] = self.quick.encode_ordinary(text)
            else:
                slow.append(i)
        few = 8  # the library's encodings are large: hold those of a few texts at a time
        for k in range(0, len(slow), few):
            for i, e in zip(slow[k : k + few], self.tokenizer.encode_batch_fast([texts[i] for i in slow[k : k + few]], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


def stable(text: str, p: int) -> bool:
    """Whether what stands before and from p in a text is tokenised independently."""
    return 0 < p < len(text) and text[p] in " \n\t\r" and (text[p - 1].isalnum() or text[p - 1] in ".,;")


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text, from overlapping chunks."""
    chunk = max(1, chunk)

    def encode(start: int, end: int):
        return tokenizer.encode(text[start:end], add_special_tokens=False)

    def token_at(encoding, p: int) -> int | None:
        """The token that begins at a character; asking for single places leaves the offsets of all others inside the library."""
        token = encoding.char_to_token(p)
        return token if token is not None and encoding.token_to_chars(token)[0] == p else None

    # The current chunk: its encoding, the place where that begins, and its tokens in front of the last splice.
    total, start, end = 0, 0, min(chunk, len(text))
    left, origin, before = encode(start, end), start, 0
    while end < len(text):
        joined = False
        width = max(1, overlap)
        while not joined and width <= end - start:
            low, high = end - width, min(len(text), end + chunk)
            right = encode(low, high)
            for p in range(end - 1, max(low, start), -1):
                if stable(text, p) and (i := token_at(left, p - origin)) is not None and (j := token_at(right, p - low)) is not None:
                    total += i - before
                    left, origin, before = right, low, j
                    start, end, joined = p, high, True
                    break
            width *= 2
        if not joined:  # no boundary in the whole chunk: it grows by the next one
            end = min(len(text), end + max(chunk, end - start))
            left, origin, before = encode(start, end), start, 0
    return total + len(left) - before


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    A null or empty text has 0 bytes and 0 tokens. Special strings inside texts are handled as the library does by
    default; no tokens are added at the ends. Equal texts of a slice are encoded once.
    """
    path = path or default_vocabulary()
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        coder = kept(("coder", path), lambda: Coder(path))

        def compute(texts: pa.Array) -> list:
            data, at = text_bytes(texts)
            cuts = np.unique(at)
            fine = dict(zip(cuts[:-1].tolist(), common_ground(data, cuts).tolist(), strict=True))
            first: dict[str, bool] = {"": True}
            texts = [t or "" for t in texts.to_pylist()]
            for t, start in zip(texts, at[:-1].tolist(), strict=True):
                if t not in first:
                    first[t] = fine[start]
            short = [t for t in first if len(t) <= chunk]
            known = dict(zip(short, map(len, coder.encode(short, [first[t] for t in short])), strict=True))
            known |= {t: count_spliced(coder.tokenizer, t, chunk) for t in first if len(t) > chunk}
            n = [known[t] for t in texts]
            return [np.diff(at), n, [x > limit for x in n]]

        return compute

    return append_columns(docs, text_col, schema, make, keeps=True)


def total_tokens(counted: DataFrame) -> DataFrame:
    """Documents, bytes and tokens in all, in one row."""
    return counted.agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
