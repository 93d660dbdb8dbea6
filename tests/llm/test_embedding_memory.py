"""Embedding near-dedup hands on bounded batches, whatever the number of cells that a vector visits."""

import numpy as np
import pyarrow as pa

from strandex.llm import embeddings


def test_visits_are_handed_on_in_bounded_batches():
    rng = np.random.default_rng(3)
    x, centroids = (embeddings.unit(rng.normal(size=(n, 16))) for n in (3000, 40))
    columns = [np.arange(3000), np.ones(3000, np.int64), np.full(3000, 16, np.int32), pa.array([r.tobytes() for r in x], pa.binary()), np.ones(3000, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "label", "dim", "v", "n"])
    out = list(embeddings.visits({(1, 16): centroids}, 0.93)([batch]))
    assert max(b.num_rows for b in out) <= 4096
    rows = pa.Table.from_batches(out).to_pandas()
    assert len(rows) > 3 * 4096 and not rows.duplicated(["rep", "cell"]).any()
    own = rows[rows.owner].sort_values("rep")
    assert own.rep.tolist() == list(range(3000)) and own.cell.tolist() == (x @ centroids.T).argmax(axis=1).tolist()
    assert all(v == x[i].tobytes() for i, v in zip(rows.rep, rows.v, strict=True))


def test_blocks_of_one_dense_group():
    """Every pair of two blocks links: counts are whole and one star holds all."""
    rng = np.random.default_rng(4)
    v = embeddings.unit(np.ones((1, 8)) + 0.01 * rng.normal(size=(600, 8)))
    rows = pa.table({"side": [0] * 300 + [1] * 300, "rep": list(range(600)), "n": [2] * 600, "v": pa.array([r.tobytes() for r in v], pa.binary())})
    got = embeddings.block_product(0.93)(None, rows).to_pandas()
    assert got[got.links > 0].set_index("rep").links.to_dict() == dict.fromkeys(range(300, 600), 600)
    assert set(got[got.links == 0].rep) == set(range(1, 600)) and set(got[got.links == 0].other) == {0}
