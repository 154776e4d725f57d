"""Links between crowded groups of embeddings."""

import numpy as np

from wattloom.llm import embedding_dedup


def brute(rows, threshold=0.93):
    ids = [i for i, _, _ in rows]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([[a == b for _, _, b in rows] for _, _, a in rows])
    near = (x @ x.T >= threshold) & same
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        low = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (low == root).all():
            return {i: (int(n), int(r)) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}
        root = low


def test_crowded_groups_that_hardly_touch(spark):
    def plane(start, label, degrees):
        return [(start + i, [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))], label) for i, d in enumerate(degrees)]

    rows = plane(0, 1, np.linspace(0, 2, 100)) + plane(100, 1, np.linspace(23.5, 25.5, 100))
    rows += plane(200, 2, np.linspace(0, 2, 90)) + plane(300, 2, np.linspace(60, 62, 90)) + plane(400, 1, [90.0, 91.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for i, (_, c) in got.items() if i < 200}) == 1 and len({c for i, (_, c) in got.items() if 200 <= i < 400}) == 2
