import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import ROWS, documents  # noqa: E402

from kestrel.llm import bpe  # noqa: E402
from kestrel.llm.queries import op1_bpe, tokenizer_path  # noqa: E402

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


PIECES = ["a", "b", "the", " ", "  ", "\n", "'re", "'", "s", "é", "漢字", "🙂", "<|endoftext|>", "<|endo", "1", "23",
          "!", "...", "  x", "ing", "Ün", "​", " ", "zz" * 5]


def test_joined_parts_equal_the_library(library):
    rng = random.Random(5)
    for _ in range(600):
        some = rng.sample(PIECES, rng.choice([2, 5, len(PIECES)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 300)))
        cut = rng.choice([1, 7, 20, 50])
        parts = [bpe.encode_text(text[i:i + cut], PATH) for i in range(0, len(text), cut)]
        got = bpe.join_all(parts, PATH, rng.choice([1, 2, 8, 48]))
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(got.tolist(), PATH) == text


@pytest.mark.parametrize("text", ["a" * 90_000, "ab" * 40_000, " " * 50_000 + "x", "xyzw qq" * 9000, "é" * 30_001])
def test_long_unsplit_texts(library, text):
    parts = [bpe.encode_text(text[i:i + 4096], PATH) for i in range(0, len(text), 4096)]
    assert bpe.join_all(parts, PATH).tolist() == library.encode(text, add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_edge_rows(spark, library):
    got = bpe.round_trip(documents(spark), PATH).drop("ids").collect()
    want = sorted((repr(r[0]), *expected(library, r[1])) for r in ROWS)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_small_leaves_give_the_same_ids(spark, library):
    got = bpe.encode(documents(spark), PATH, leaf_chars=37, window=2).collect()
    want = sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == want


def test_query_on_the_whole_table(spark, sf_small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = op1_bpe(spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, docs[r.doc_id])


def test_decode_replaces_broken_bytes():
    table = bpe.load(PATH)[1]
    half = next(i for i, b in enumerate(table) if b == b"\xe9")
    assert bpe.decode_ids(np.array([half]).tolist(), PATH) == "�"


def test_ids_are_decoded_by_the_worker_that_makes_them(spark):
    got = bpe.round_trip(documents(spark), PATH)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # short texts, leaves and their joins; a worker more to decode made an executor's memory too small
    assert plan.count("MapInArrow") == 3
    coded = bpe.encode(documents(spark), PATH, leaf_chars=37, window=2)
    two = sorted(map(repr, bpe.decode(coded, PATH).collect()))
    one = bpe.encode(documents(spark), PATH, leaf_chars=37, window=2, decoded="decoded")
    assert one.columns == ["doc_id", "ids", "decoded"] and sorted(map(repr, one.collect())) == two
