"""The encoder against public libraries."""

from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointgate.llm.encode import PATTERN, VOCABULARY, Encoder, encode, load_ranks, merge

if not Path(VOCABULARY).exists():
    pytest.skip("no vocabulary file", allow_module_level=True)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abc '\n\t\u00a0\u2028\u00e9\u65e5", max_size=300)))
def test_same_ids(reference, text):
    assert Encoder(VOCABULARY).encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 30_000, "ab" * 9_999, "<|endoftext|> <|startoftext|>", " \n\n  \t", "\u65e5\u672c\u8a9e" * 500, "a\u200b\u0301\U0001f3c8\U0001f468\u200d\U0001f469\u200d\U0001f467"])
def test_long_and_odd(reference, text):
    e = Encoder(VOCABULARY, memory=2)
    ids = e.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert reference.decode(ids) == text


def test_merge_edges():
    ranks = load_ranks(VOCABULARY)
    assert merge(b"", ranks) == [] and merge(b"a", ranks) == [ranks[b"a"]]


def test_rows(spark):
    df = spark.createDataFrame([(1, "hi there", "k"), (1, "hi there", "k"), (2, None, "l"), (3, "", "m")], "id int, text string, ids string")
    got = encode(df)
    assert got.columns == ["id", "ids"] and dict(got.dtypes)["ids"] == "array<int>"
    rows = sorted((r["id"], r["ids"]) for r in got.collect())
    assert rows[0] == rows[1] and rows[0][1] and rows[2:] == [(2, []), (3, [])]
    assert encode(df.where("false")).count() == 0


def test_too_large_vocabularies_are_refused(spark, tmp_path, monkeypatch):
    from pointgate.llm import encode as module

    df = spark.createDataFrame([(1, "ab")], "doc_id int, text string")
    small = tmp_path / "v"
    small.write_text("".join(f"{__import__('base64').b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    assert [tuple(r) for r in encode(df, vocabulary=str(small)).collect()] == [(1, [97, 98])]
    monkeypatch.setattr(module, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        encode(df, vocabulary=str(small))
