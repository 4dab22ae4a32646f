"""The bounds that leave pairs of texts out: never a pair that reaches the threshold, but most of those far from it."""
import numpy as np
import pytest

from gapcube.operators import similarity as SIM


def corpus(spark):
    rng = np.random.default_rng(3)
    tongues = [["".join(rng.choice(list(letters), 6)) for _ in range(60)] for letters in ("abcdefgh", "ijklmnop", "qrstuvwx")]
    rows = []
    for i in range(90):
        words = list(rng.choice(tongues[i % 3], int(rng.integers(4, 120))))
        rows.append(" ".join(words))
        rows.append(" ".join(words[: max(1, len(words) - 1 - i % 5)]))  # a near copy
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_num long, text_norm string"), rows


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_no_pair_is_left_out_and_far_ones_are(spark, threshold):
    df, rows = corpus(spark)
    weights = SIM.gram_weights(df, SIM.representatives(df))
    scale = SIM.Scale.of(weights, threshold)
    stored = weights.orderBy("rep").toArrow().combine_chunks().to_batches()[0]
    side = scale.side(*SIM.arrays_of(stored))
    dense = np.zeros((len(side["rep"]), len(scale.idf)))
    row, w, g = scale.weights(side, np.arange(len(side["g"])))
    dense[row, g] = w
    sim = dense @ dense.T
    may = SIM.possible(threshold, side, side)
    assert may[sim >= threshold].all() and may.mean() < 0.6
    apart = sim >= threshold
    np.fill_diagonal(apart, False)
    found = np.zeros_like(apart)
    for a, b, bound in SIM.bounded_pairs(scale, dict(side), side):
        assert (bound >= sim[a, b] - 1e-9).all()
        found[a, b] = True
    assert found[apart].all()


def test_pieces_end_where_the_kind_changes():
    import pyarrow as pa
    kinds = [0] * 40 + [1] * 10 + [2] * 50
    b = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([[1]] * 100, pa.list_(pa.int32())), pa.array([[1]] * 100, pa.list_(pa.int32())), pa.array([""] * 100), pa.array(kinds, pa.int32())],
                                   names=["rep", "g", "tf", "grp", "kind"])
    sizes = [p.num_rows for p in SIM.pieces_of(iter([b.slice(0, 33), b.slice(33)]), 160, 1 << 20, 4)]
    assert sizes == [40, 60] and [p.num_rows for p in SIM.pieces_of(iter([b]), 160, 1 << 20)] == [100]
