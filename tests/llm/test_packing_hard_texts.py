"""Texts that the faster library can't do, against the tokenizers library."""

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from fluxtone.llm.packing import encode, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("blank", [" ", "\n", "\t 　"])
def test_blank_runs_of_several_megabytes(blank):
    text = "before" + blank * (3_000_000 // len(blank)) + "after it"
    assert encode(text, PATH) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_a_document_with_a_long_blank_run_is_packed(spark):
    text = "a" + " " * 3_000_000 + "b"
    got = pack(spark.createDataFrame([(1, text), (2, "short")], SCHEMA).coalesce(1)).collect()
    ids = np.frombuffer(b"".join(r.ids for r in sorted(got, key=lambda r: r.start) if r.doc_id == 1), "<u4").tolist()
    assert ids == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    assert any(r.doc_id == 2 for r in got)


def test_added_tokens_get_their_ids(tmp_path, spark):
    whole = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y\n\n <|endoftext|>", "<|endoftext", "plain text", "<|endoftext|>" + " " * 20_000 + "z"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275] and [encode(t, PATH, added=True) for t in texts] == want
    import corpus_pipeline
    from fluxtone.llm import queries

    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.doc_tokens for r in out.collect()} == {i: len(w) + 1 for i, w in enumerate(want)}
