"""Operator 8 counts pairs by blocks: one row a shard leaves a block, and a shard adds them up bit by bit."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from jobsift.llm import ngram_lm as lm
from jobsift.llm.elias_fano import EliasFano

TEXTS = [b"a b a b c", b"", None, b"c a b", b"hot x hot y hot z hot w hot x", b"a b"]


def _pairs(texts):
    out = collections.Counter()
    for text in texts:
        tokens = lm.tokens(text).tolist()
        out.update(zip([int(lm._BEGIN[0]), *tokens], [*tokens, int(lm._BEGIN[0])]))
    return out


def test_a_block_leaves_as_one_row_a_shard():
    starts = lm.shard_starts(np.full(1 << lm.BUCKETS, 1.0), 1 << (lm.BUCKETS - 2))
    batch = lm._counted(lm._stream(TEXTS)[0], starts)
    rows, got = batch.to_pylist(), collections.Counter()
    assert len({r["shard"] for r in rows}) == len(rows) <= 4
    for r in rows:
        contexts, sizes = np.frombuffer(r["contexts"], "<u8"), np.frombuffer(r["sizes"], "<u4")
        assert ((contexts >> np.uint64(64 - lm.BUCKETS)) < starts[r["shard"] + 1]).all() and ((contexts >> np.uint64(64 - lm.BUCKETS)) >= starts[r["shard"]]).all()
        for c, w, n in zip(np.repeat(contexts, sizes).tolist(), np.frombuffer(r["words"], "<u8").tolist(), np.frombuffer(r["n"], "<u4").tolist()):
            got[c, w] += n
    assert got == _pairs(TEXTS)


@pytest.mark.parametrize("group", [1, 20, 1 << 22])
def test_a_shard_is_the_same_from_any_number_of_rows(monkeypatch, group):
    monkeypatch.setattr(lm, "GROUP", group)
    starts = np.array([0, 1 << lm.BUCKETS])
    rows = [lm._counted(lm._stream(TEXTS[i : i + 2])[0], starts) for i in (0, 2, 4)] * 3
    (built,) = lm._build(starts, lm.DISCOUNT)(iter(rows))
    want, count = _pairs(TEXTS * 3), collections.Counter()
    for (c, _), n in want.items():
        count[c] += n
    (row,) = built.to_pylist()
    assert row["tokens"] == sum(count.values()) - count[int(lm._BEGIN[0])] and row["words"] == len(count) - 1 and row["size"] == len(row["level"])
    shard = lm.Shard(row["level"])
    assert dict(zip(shard.words.tolist(), shard.counts.tolist())) == dict(count)
    c, w = (np.array(x, dtype=np.uint64) for x in zip(*want))
    p = shard.level.query(shard.count(c)[1], np.searchsorted(shard.next, w))[0]
    exact = np.array([(n - lm.DISCOUNT) / count[a] for (a, _), n in want.items()])
    assert (p <= exact + 1e-12).all() and (p > exact * 0.999).all()
    filled = lm.Shard(lm.Shard.counted(row["level"], shard.next[::-1], np.array([count[x] for x in shard.next.tolist()])[::-1]))
    asked = shard.gain(shard.count(c)[1], w, shard.count(w)[0], 100.0)
    assert np.allclose(asked, filled.gain(shard.count(c)[1], w, np.zeros(len(w), dtype=np.int64), 100.0), atol=1e-12)


@pytest.mark.parametrize("step", [1, 2, 700, 1 << 40])
def test_index_finds_only_the_values_themselves(step):
    rnd = np.random.default_rng(step)
    values = np.unique(rnd.integers(0, 3000 * step, 3000, dtype=np.uint64))
    held = EliasFano(EliasFano.build(values))
    asked = np.concatenate((values, values + np.uint64(1), rnd.integers(0, 9000 * step, 500, dtype=np.uint64), np.array([(1 << 63) + 1], dtype=np.uint64)))
    place = {v: i for i, v in enumerate(values.tolist())}
    assert held.index(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]
    assert EliasFano(EliasFano.build(values[:0])).index(asked[:3]).tolist() == [-1] * 3
    run = EliasFano(EliasFano.build(np.arange(5000, dtype=np.uint64) + np.uint64(77)))
    assert run.index(np.arange(70, 5090, dtype=np.uint64)).tolist() == [-1] * 7 + list(range(5000)) + [-1] * 13
