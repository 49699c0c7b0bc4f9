"""What a Python worker holds: new words go to the tokenizer in bounded numbers, and one operator's tables go
when the worker turns to another's."""

import pyarrow as pa
import pytest

from gritstone.llm import common, packing, tokenise


class Spy:
    """A tokenizer that notes how many texts, and how long a one, it is given at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts, self.longest = tokenizer, 0, 0

    def encode_batch_fast(self, texts, **named):
        self.texts, self.longest = max(self.texts, len(texts)), max([self.longest, *map(len, texts)])
        return self.tokenizer.encode_batch_fast(texts, **named)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_words_are_encoded_in_bounded_numbers(name):
    e = tokenise.Encoder(tokenise.vocabulary(name))
    letters = ["".join(chr(97 + k // 26**n % 26) for n in range(4)) for k in range(20_000)]
    text = " ".join(["a", *letters, *(f"{k}x{k}" for k in range(20_000)), "b"])
    whole = e.tokenizer.encode(text, add_special_tokens=False).ids
    e.tokenizer = spy = Spy(e.tokenizer)
    (raw,) = e.encode(pa.array([text]))
    assert memoryview(raw).cast(e.code).tolist() == whole
    assert spy.texts <= tokenise.AT_ONCE and spy.longest <= 6 * tokenise.AT_ONCE


def test_long_pieces_are_not_remembered():
    e = tokenise.Encoder(tokenise.vocabulary("byte_bpe_50k.json"))
    texts = ["a " + "x" * 5000 + " " + "y" * 5000 + "... " + "7" * 5000 + " short" for _ in range(2)]
    for text in texts:
        (raw,) = e.encode(pa.array([text]))
        assert memoryview(raw).cast(e.code).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert "short" in e.known and max(map(len, e.known)) <= tokenise.LONG


def test_workers_drop_the_tables_of_other_operators(spark):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    assert packing.cut_documents(docs).count() == 40

    def held(batches):
        from gritstone.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._tables)] * batch.num_rows, pa.int64())], names=["n"])

    assert {r["n"] for r in common.mapped(docs.select("doc_id"), held, "n long").collect()} == {0}
    path = tokenise.vocabulary("byte_bpe_50k.json")
    first = tokenise.encoder(path)
    common.release(path)
    assert tokenise.encoder(path) is first
    common.release(None)
    assert not common._tables
