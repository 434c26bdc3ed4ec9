import tracemalloc

import numpy as np

from kumiki.llm import lm_score as M


def _docs(spark, words=3000, seed=5):
    r = np.random.RandomState(seed)
    names = np.array([f"w{k}" for k in range(words)])
    rows = [(k, " ".join(names[(r.rand(r.randint(0, 90)) ** 2 * words).astype(int)])) for k in range(400)] + [(900, ""), (901, None), (None, "w1 w2")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_driver_holds_few_numbers_where_words_are_few(spark):
    docs = _docs(spark)
    M.pseudo_likelihood(docs).count()  # modules are loaded
    tracemalloc.start()
    try:
        assert M.pseudo_likelihood(docs).count() == 403
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20  # 2**CELL_BITS cells of 4 bytes alone are 64 MB


def test_tasks_choose_the_words_that_all_counts_choose(spark):
    for docs in (_docs(spark), _docs(spark, words=300), spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), _docs(spark).limit(0)):
        counts, table = M.cell_counts(docs), M.counted(docs).repartition(5)
        want, got = M.Vocabulary(counts), M.Vocabulary.of(table)
        assert got.used == want.used == np.count_nonzero(counts) and got.outputs == want.outputs
        for a, b in ((got.known, want.known), (got.rank, want.rank), (got.totals, want.totals)):
            assert a.dtype == b.dtype and (a == b).all()
        for used in (got.used, 1 << M.CELL_BITS):  # few cells, and many
            assert (M.CellCounts(table, used).of_all() == counts).all()


def test_counts_beyond_four_bytes(spark):
    rows = [(0, np.array([3, 9], np.uint16).tobytes(), np.array([5, 1 << 40]).tobytes()), (7, np.array([1], np.uint16).tobytes(), np.array([(1 << 32) - 1]).tobytes())]
    table = spark.createDataFrame([(p, bytearray(a), bytearray(b)) for p, a, b in rows], "part int, cells binary, counts binary")
    held = M.CellCounts(table, 3).of_all()
    assert [int(held[k]) for k in (3, 9, (7 << 16) + 1)] == [5, (1 << 32) - 1, (1 << 32) - 1] and np.count_nonzero(held) == 3
