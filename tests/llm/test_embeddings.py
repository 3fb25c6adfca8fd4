import numpy as np

from quillspark.llm.embedding_dedup import near_dedup

from .brute import near


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = {}
    for i in range(260):
        if i > 20 and i % 3:
            v = np.array(vectors[int(rng.integers(0, 15))][1]) + rng.normal(0, 0.03, 24)
        else:
            v = rng.normal(0, 0.3, 24)
        vectors[i] = (int(rng.integers(0, 2)) if i % 50 else None, [float(np.float32(x)) for x in v])
    for i in range(300, 330):  # a group of copies
        vectors[i] = vectors[3 if i % 2 else 4]
    vectors |= {400: (1, None), 401: (1, [0.0] * 24), 402: (1, [float("nan")] + [1.0] * 23), 403: (1, [None] + [1.0] * 23), 404: (1, []), 405: (0, [float("inf")] * 24)}
    rows = [(k, v, label) for k, (label, v) in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (8, 512):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(df, 0.98, block=block).collect()}
        assert got == near(vectors, 0.98)


def test_dimensions_without_axes_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = {}
    for i in range(160):
        size = (3, 5, 9)[i % 3]
        near_one = vectors[i - 30][1] if i >= 30 and i % 2 else None
        vectors[i] = (i % 2, [float(x) for x in (np.array(near_one) + rng.normal(0, 0.05, size) if near_one else rng.normal(0, 1, size))])
    want = {}
    for size in (3, 5, 9):
        want |= near({k: x for k, x in vectors.items() if len(x[1]) == size}, 0.98)
    df = spark.createDataFrame([(k, v, label) for k, (label, v) in vectors.items()], "vec_id long, embedding array<double>, label int")
    for most in (2048, 4, 0):
        monkeypatch.setattr("quillspark.llm.embedding_dedup.MAX_TURNED", most)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(df, 0.98, block=8).collect()} == want


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (None, [1.0, 0.0], 1, "b"), (2, [2.0, 0.0], 1, "c"), (3, [1.0, 0.0, 0.0], 1, "d")]
    rows += [(10, [5.0, 0.0, 0.0], 1, "e"), (11, [0.0, 1e200, 0.0], 1, "f"), (12, [0.0, 2e200, 1e190], 1, "g"), (13, [0.0, 1e-200, 0.0], 1, "h"), (14, [3.0], 1, "i"), (15, [1e308], 1, "j"), (16, [-1.0], 1, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = sorted(map(tuple, near_dedup(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False), (3, 1, 3, True)] + [(10, 1, 3, False), (11, 2, 11, True), (12, 2, 11, False), (13, 2, 11, False), (14, 1, 14, True), (15, 1, 14, False), (16, 0, 16, True)], key=repr)
    assert near_dedup(spark.createDataFrame([], df.schema)).collect() == []
