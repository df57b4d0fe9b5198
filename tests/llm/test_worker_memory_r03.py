"""What a worker of the tokenizer holds stays small, however many different words it meets; ids stay the library's."""

import pyarrow as pa

from corpusloom.llm import packing, tokens

LETTERS = str.maketrans("0123456789", "bcdfghjklm")


def test_what_an_encoder_remembers_stays_small():
    enc = tokens.ChunkEncoder(tokens.default_path("byte_bpe_50k.json"), False)
    for k in range(4):
        text = " ".join(f"{chr(97 + k)}{i:05d}".translate(LETTERS) for i in range(70_000))
        ids, sizes = enc.encode(pa.array([text, "same words"]))
    held = enc.chunks.nbytes + enc.pool.nbytes + enc.first.nbytes + enc.size.nbytes + enc.met.nbytes
    assert len(enc.chunks) > 50_000 and held < 9_000_000
    assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + enc.tokenizer.encode("same words", add_special_tokens=False).ids
    assert sizes.sum() == len(ids) and packing.TOKENISED_AT_ONCE <= 2_000_000
