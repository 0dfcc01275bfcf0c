import numpy as np
import pytest

from palaver.llm import lattice


def test_decode_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    got = lattice.decode(x)
    twice = np.rint(got * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (got.sum(axis=1) % 2 == 0).all()
    near = ((x[:, None] - got[:, None] - lattice.SHORTEST[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - got) ** 2).sum(axis=1) <= near + 1e-9).all() and lattice.SHORTEST.shape == (240, 8)


def sample(seed=2):
    rng = np.random.default_rng(seed)
    rows = []

    def near(v, c):
        z = rng.normal(size=len(v))
        z -= z @ v * v / (v @ v)
        return c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * z / np.linalg.norm(z)

    for g in range(60):
        v = rng.normal(size=24)
        rows.append((v, g % 3))
        for _ in range(rng.integers(0, 12)):
            rows.append((near(v, rng.choice([0.9, 0.94, 0.96, 0.99])) * rng.uniform(0.1, 9), g % 3 if rng.random() < 0.9 else None))
    rows += [rows[0], rows[0], rows[5], (np.zeros(24), 1), (None, 1), ([1.0, None], 1), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, (v, lab) in enumerate(rows)]


def brute(rows, cosine=0.93):
    ok = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {i: set() for i, _, _ in rows}
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and label[i] == label[j] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i].add(j)
    low = {i: i for i in links}
    for _ in links:
        for i, own in links.items():
            low[i] = min([low[i], *(low[j] for j in own)])
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


@pytest.mark.parametrize("block", [512, 4])
def test_against_brute_force(spark, block):
    rows = sample()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df, block=block).collect()}
    want = brute(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there
    more = lattice.near_duplicates(df, block=block, setting=lattice.Setting(14, 24, 1.0)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in more} == want


@pytest.mark.parametrize("largest", [100, 100_000, 30_000_000])
def test_recall_of_planned_settings(largest):
    """Pairs at the threshold itself, and a little above, meet in some table whatever the size planned for."""
    setting = lattice.plan(largest)
    rng = np.random.default_rng(4)
    for cosine, least in ((0.93, 0.99), (0.95, 0.999)):
        x = rng.normal(size=(1200, 48))
        z = rng.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = np.zeros(len(x), bool)
        for t in range(setting.tables):
            a, b = (lattice.cells(v, t, setting.probes, setting.scale) for v in (x, y))
            met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
        assert met.mean() >= least


def test_cells_get_finer_as_labels_grow():
    plans = [lattice.plan(n) for n in (1_000, 100_000, 10_000_000, 1_000_000_000)]
    assert [p.scale for p in plans] == sorted(p.scale for p in plans) and plans[0].scale < plans[-1].scale
    met = [p.tables * (1 + p.probes) * lattice.simulated(lattice.COSINE, p.scale)[0] * n for p, n in zip(plans, (1e3, 1e5, 1e7, 1e9))]
    assert met[2] / met[1] < 60  # a hundred times the vectors


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 2)], "vec_id long, embedding array<float>, label int, n_links int")
    got = [tuple(r) for r in lattice.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, None)]
    assert lattice.near_duplicates(df.limit(0)).count() == 0
