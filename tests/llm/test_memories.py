"""Ids stay those of the libraries when a worker's memory overflows, and on odd texts."""

import random

import numpy as np
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyhouse.llm import packing, pieces
from tallyhouse.llm.catalog import tokenizer_path


def _texts(signs, seed):
    r = random.Random(seed)
    return ["".join(r.choice(signs) for _ in range(r.choice([0, 3, 20, 200]))) for _ in range(400)]


def test_pieces_with_a_full_memory_and_long_chunks(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 50)
    path = tokenizer_path("piece_bpe_32k.model")
    model, library = pieces.Model(path), SentencePieceProcessor(model_file=path)
    texts = [*_texts("abthe Z9'.,é日\U0001f600ñ\t", 1), "x" * 5000, "日" * 300, "the" * pieces.LONG]
    for at in [*range(0, len(texts), 40), 0]:
        some = texts[at: at + 40]
        assert [np.frombuffer(d, dtype="<u4").tolist() for d in model.encode(some)] == library.encode(some)


def test_packing_ids_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PRETOKENS", 50)
    path = tokenizer_path("byte_bpe_50k.json")
    ids, library = packing.Ids(path), Tokenizer.from_file(path)
    texts = _texts("ab Z9'\n\t\r .,é²ª¼Ā \u0085\u001c<|s€日", 2)
    for at in [*range(0, len(texts), 40), 0]:
        some = texts[at: at + 40]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(d, dtype="<u4").tolist() for d in ids(some)] == want
