"""Operator 8 keeps every pair, operator 1 holds few texts as Python objects."""

import pyarrow as pa

from jobsift.llm import minhash as mh
from jobsift.llm import ngram_lm as lm


def test_a_pair_seen_once_is_learnt(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "old fox"), (4, "old hen"), (5, "old cat")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "old cat"), (2, "red cat")], docs.schema)
    got = {r.doc_id: r.score for r in lm.score(asked, lm.train(docs)).collect()}
    assert got[1] > got[2] + 0.1


def test_texts_are_read_in_slices(monkeypatch):
    sizes = []
    found = mh.shingle_set
    monkeypatch.setattr(mh, "ROWS", 3)
    monkeypatch.setattr(mh, "shingle_set", lambda x: sizes.append(x) or found(x))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": [b"a b c d e f %d" % i for i in range(8)]})
    out = list(mh._sign(5)(iter([batch])))
    assert [x.num_rows for x in out] == [3, 3, 2] and len(sizes) == 8
    pairs = pa.RecordBatch.from_pydict({"a": [1, 1, 2, 2], "b": [3, 4, 3, 5], "l": [b"a b"] * 4, "r": [b"a b", b"c", b"a b", b"a b"]})
    assert list(mh._confirm(85)(iter([pairs])))[0].to_pydict() == {"a": [1, 2, 2], "b": [3, 3, 5]}
