import numpy as np

from rollcall.llm import packing as P


def test_frequencies_count_each_tail_once(spark):
    tails = [np.array(t, "<u2").tobytes() for t in ([5, 5, 7], [7], [7, 9, 9, 9], [0, 49_999])]
    df, n, mean = P.frequencies(spark.createDataFrame([(t, len(t) // 2) for t in tails], "tail binary, length long"), False)
    assert (n, mean) == (4, 2.5) and {i: int(df[i]) for i in np.flatnonzero(df)} == {0: 1, 5: 1, 7: 3, 9: 1, 49_999: 1}


def test_postings_are_in_order_for_both_widths():
    rng = np.random.default_rng(1)
    for size in (60_000, 70_000):
        tails = [rng.integers(0, size, 40) for _ in range(30)]
        index = P.Index(tails, np.ones(size, np.float32), 40.0)
        for term in (int(tails[0][0]), int(tails[9][3]), size - 1):
            at = slice(index.first[term], index.first[term + 1])
            assert index.doc[at].tolist() == [i for i, t in enumerate(tails) if term in t]
