"""Token ids of whole texts, a batch at a time.

The vocabulary pre-tokenises by words, so a text's ids are those of its white-space separated
chunks, one after another, and a chunk's those of its pieces. Natural text repeats its words: a batch
is reduced to its distinct chunks, and these are split into pieces and merged by the vocabulary's ranks
at once, outside of Python. Nothing is kept from batch to batch, so a worker's memory follows the
batch alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Chunks of these characters are cut into pieces here, by the vocabulary's own pattern restricted
#: to them; every other chunk is given to the tokenizer as it is.
PLAIN = r"^[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+$"
LETTERS = r"^[a-zß-öø-ÿ]+$"
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+)"
# How the vocabulary writes the end of a word; and characters that stand for it, and for
# the end of a chunk, here: no plain chunk has them.
WORD_END, END, CHUNK_END = "</w>", "\0", "\1"


def _byte_letters() -> dict[int, str]:
    """For each byte the letter that stands for it in the vocabulary.

    Bytes that print stand for themselves, the others for the letters from 256 on, in order.
    """
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in prints else next(rest)) for b in range(256)}


@cache
def _loaded(path: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    """The tokenizer of a vocabulary; and the same merges on bytes, for pieces that end in ``END``.

    Ids rise in the order of the merges, so they serve as ranks.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte_of = {letter: b for b, letter in _byte_letters().items()}
    ranks = {}
    for token, i in model["vocab"].items():
        body = token.removesuffix(WORD_END) or token
        if all(c in byte_of for c in body):
            ranks[bytes(byte_of[c] for c in body) + (END.encode() if body != token else b"")] = i
    merges = tiktoken.Encoding("merges", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), merges


def vocabulary_size(path: str) -> int:
    """Ids are below this number."""
    return _loaded(path)[0].get_vocab_size()


def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts (without nulls) to the ids of all of them and the number of each one's ids.

    Special tokens are not added.
    """
    tokenizer, merges = _loaded(path)
    mark = merges.encode_ordinary(CHUNK_END + END)[0]

    def of_chunks(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and the number of each one's."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(chunks.filter(plain))
        single = pc.match_substring_regex(low, LETTERS)
        cut = pc.replace_substring_regex(pc.if_else(single, None, low), PIECE, r"\1" + END)
        pieces = pc.if_else(single, pc.binary_join_element_wise(low, END, ""), cut)
        whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        joined = pc.binary_join(whole, CHUNK_END + END)[0].as_py()
        ids = np.array(merges.encode_ordinary(joined + CHUNK_END + END if len(pieces) else ""), dtype=np.uint32)
        ends = np.nonzero(ids == mark)[0]
        odd = chunks.filter(pc.invert(plain)).to_pylist()
        others = [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch(odd, add_special_tokens=False)]
        sizes = np.zeros(len(chunks), dtype=np.int64)
        sizes[is_plain] = np.diff(ends, prepend=-1) - 1
        sizes[~is_plain] = [len(x) for x in others]
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        from_plain = np.repeat(is_plain, sizes)
        out[from_plain] = ids[ids != mark]
        out[~from_plain] = np.concatenate(others) if others else 0
        return out, sizes

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids, sizes = of_chunks(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        before = np.cumsum(each) - each
        flat = ids[np.repeat(starts[codes] - before, each) + np.arange(int(each.sum()))]
        bounds = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]
        return flat, np.diff(bounds)

    return encode
