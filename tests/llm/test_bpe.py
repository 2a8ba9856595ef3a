import hashlib
import random

import pytest
from tokenizers import Tokenizer

from watchline.llm.bpe import Codec, encode_table
from watchline.llm.queries import VOCABULARY

PATH = VOCABULARY


@pytest.fixture(scope="module")
def pair():
    return Codec(PATH), Tokenizer.from_file(PATH)


def test_same_ids_and_round_trip(pair):
    own, theirs = pair
    rng = random.Random(5)
    alphabet = list("abcdeABC  \n\t 019.,'!?#-_é漢字ßñ \u0085\u001c ​🙂\r") + ["'s", "'ll", "aaaa", "<|endoftext|>", "the ", "\n\n\n"]
    texts = ["", " ", "a" * 3000, "\x00\x01", "don't we'll 'S"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(1500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids).decode() == text == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_forced_cuts_cross_no_token(pair):
    own, _ = pair
    for token in own.token_bytes[:50256]:
        assert all(own.joins[a, b] for a, b in zip(token, token[1:], strict=False))


def test_rows(spark):
    rows = [(1, "x y"), (1, "x y"), (None, None), (3, "")]
    got = encode_table(spark.createDataFrame(rows, "doc_id long, text string"), PATH, with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (None, 0), (3, 0)]
    assert got[2].ids_sha256 == got[3].decoded_sha256 == empty
    assert not encode_table(spark.createDataFrame([], "doc_id long, text string, n_tokens int"), PATH).collect()
