"""Operator 1: the sketch sets no linked pair aside."""

import numpy as np

from jobsift.llm import minhash as m


def missed(total, both, pairs, seed=0):
    """Share of pairs of sets, ``both`` of ``total`` shingles in common, that the sketch rejects."""
    rng = np.random.default_rng(seed)
    apart = 1 - m.PERCENT / 100
    limit = int(m.SKETCH * apart + m.DEVIATIONS * (m.SKETCH * (apart / 2 + apart * (1 - apart))) ** 0.5)
    out = 0
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, total, dtype=np.uint64) * np.uint64(2)
        cut = both + (total - both) // 2
        a, b = (m.sketch(*m.signature(s)) for s in (x[:cut], np.concatenate((x[:both], x[cut:]))))
        out += int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) > limit
    return out / pairs


def test_sketch_bits_of_one_shingle_sets_are_independent():
    # a set of one shingle: every signature value comes from it
    rng = np.random.default_rng(1)
    differing = []
    for _ in range(300):
        a, b = (m.sketch(*m.signature(rng.integers(0, 1 << 63, 1, dtype=np.uint64) * np.uint64(2))) for _ in "ab")
        differing.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
    # minimum and maximum of a permutation are equal here, so the bits come in twos at most
    assert abs(np.mean(differing) - m.SKETCH) < 10 and np.std(differing) < 2 * m.SKETCH ** 0.5


def test_sketch_rarely_rejects_a_link():
    assert missed(100, 85, 2000) <= 1e-3 and missed(64, 55, 2000) <= 1e-3


def test_small_sets_skip_the_sketch(spark, monkeypatch):
    from test_dedup_ops import brute_near, near_rows
    monkeypatch.setattr(m, "DEVIATIONS", -100.0)     # a sketch that rejects all pairs
    rows = [(i, " ".join((t or "").split()[:60])) for i, t in near_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.minhash_dedup(df).collect()}
    assert got == brute_near(rows, 85)
