"""Texts that the tokenizer library can't take whole."""

import hashlib

import pytest

from kbloom.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path(bpe.RANK_FILE), "rb") as held:
        return bpe.Encoder((held.read(), public_tokenizers.PATTERN, True))


RUNS = [" ", "\n", "\n \t", "　", " \x85\r\n", "   "]
PLACES = ["{}", "{}end", "start{}", "start{}'s end", "it's{}42 and{}…", "a {}\x1c b", "{}é{}"]


@pytest.mark.parametrize("run", RUNS)
def test_runs_equal_the_plain_rule(encoder, run):
    for n in (bpe.LONG_RUN - 1, bpe.LONG_RUN, bpe.LONG_RUN + 1, 30_000):
        white = (run * n)[:n]
        for place in PLACES:
            text = place.format(white, white)
            assert encoder.encode(text) == encoder.library.encode_ordinary(text), (n, place)


@pytest.mark.parametrize("run", RUNS[:3])
@pytest.mark.parametrize("place", ["{}", "{}end", "start{}", "start {} end"])
def test_two_million_round_trip(encoder, run, place):
    text = place.format((run * 2_000_000)[:2_000_000])
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text.encode()
    # the tail and the head around the run are those of a shorter run
    short = encoder.encode(place.format((run * 60_002)[:60_002]))
    assert ids[:5] == short[:5] and ids[-1] == short[-1]


def test_other_long_matches(encoder):
    for text in ("a" * 2_000_000, "7" * 1_000_000, "!" * 1_000_000, "é " * 500_000):
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_another_pattern_is_not_cut():
    import public_tokenizers

    with open(public_tokenizers.path(bpe.RANK_FILE), "rb") as held:
        data = held.read()
    plain = bpe.Encoder((data, r"[a-z_]+[ \n]*|\s+|.", False))
    text = "snake_case \n " * 20_000
    assert plain.encode(text) == plain.library.encode_ordinary(text)


def test_query_on_a_white_run(spark, tmp_path):
    text = "word" + " " * 1_200_000
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, None, None)], "doc_id long, text string, token_ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op5_bpe(spark, str(tmp_path)).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted([hashlib.sha256(text.encode()).hexdigest()] * 2 + [hashlib.sha256(b"").hexdigest()])
    encoded = bpe.encode_documents(spark, docs)
    assert encoded.columns == ["token_ids", "doc_id", "_kept_token_ids"]
    assert {bytes(r.data) for r in bpe.decode_documents(spark, encoded).collect()} == {text.encode(), b""}
