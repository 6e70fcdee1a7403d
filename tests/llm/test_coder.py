import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from linkquarry.llm import bpe, tokens
from linkquarry.llm.common import text_bytes


def library_ids(texts):
    library = tokens.load_tokenizer(tokens.default_vocabulary())
    return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def fine(texts):
    data, at = text_bytes(pa.array(texts))
    return tokens.common_ground(data, at).tolist()


def test_every_character_of_up_to_three_bytes():
    """Both libraries cut and merge alike around every such character, beside letters, digits, marks, spaces and itself."""
    coder = tokens.Coder(tokens.default_vocabulary())
    assert coder.quick is not None
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c}!{c} {c}{c}  {c}\n{c}'s{c}\t{c}7 {c}" for c in chars]
    assert [t for t, a, b in zip(texts, library_ids(texts), map(coder.quick.encode_ordinary, texts), strict=True) if a != b] == []


def test_random_mixtures():
    rng, coder = random.Random(4), tokens.Coder(tokens.default_vocabulary())
    alphabet = [*"aZ9 \n\t'.,!?_-=\r\v\f\x1c\x00", "'s", "'ll", "é", "ß", "ſ", "Ω", "я", "中", " ", " ", "​", "́", "²", "Ⅷ", "😀", "<|endoftext|>", "<|", "𝔸"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)]
    assert coder.encode(texts, [all(fine([t])) for t in texts]) == library_ids(texts)


def test_common_ground():
    texts = ["plain", "", "emoji 😀", "x" * 5000, " " * 5000, "x y " * 5000, "é" * 2000 + " ", "é" * 2100, "end"]
    data, at = text_bytes(pa.array(texts))
    cuts = np.unique(at)
    assert tokens.common_ground(data, cuts).tolist() == [True, False, False, False, True, True, False, True]
    assert tokens.common_ground(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []


def test_files_of_other_kinds_keep_to_their_library():
    assert tokens.Coder(public_tokenizers.path("word_bpe_49k.json")).quick is None


def test_ids_of_odd_texts():
    rng = random.Random(8)
    texts = [None, "", "<|endoftext|> and <|endoftext|>", "x" * 9000, " " * 9000 + "a", "".join(rng.choices("ab😀 é\n", k=9000)), "word " * 4000, "𝔸𝔹 ℂ" * 700]
    got = bpe.ChunkEncoder(tokens.default_vocabulary()).run(pa.array(texts, pa.string()))
    assert [i.tolist() for i, _ in got] == library_ids([t or "" for t in texts])
