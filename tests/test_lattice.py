import random

from refweave.operators import lattice as A
from refweave.plans import models


def merged(nodes, edges, stop):
    """(rep, merged) by hand, all edges above the threshold at once."""
    size, obs, group, links = dict(nodes), dict.fromkeys(dict(nodes), 1.0), {r: r for r, _ in nodes}, set(edges)
    for level in range(99, round(stop * 100) - 1, -1):
        car = {g: obs[g] + sum(obs[y] for x, y in links if x == g) for g in obs}
        near = {g: {g} for g in obs}
        for x, y in links:
            if car[y] / car[x] > level / 100:
                both = near[x] | near[y]
                for g in both:
                    near[g] = both
        keep = {g: min(near[g], key=lambda x: (-size[x], x)) for g in obs}
        group = {r: keep[g] for r, g in group.items()}
        links = {(keep[x], keep[y]) for x, y in links if keep[x] != keep[y]}
        obs = {k: sum(obs[g] for g in obs if keep[g] == k) for k in set(keep.values())}
    return group


def test_agglomeration_against_brute_force(spark):
    rng = random.Random(1)
    nodes = [(f"r{i:02}", rng.randrange(1, 5)) for i in range(16)]
    edges = [(x, y) for x, n in nodes for y, m in nodes if n < m and rng.random() < 0.2]
    got = A.agglomerated(spark.createDataFrame([(r, 1.0, n) for r, n in nodes], "rep string, obs double, size int"), spark.createDataFrame(edges, "sub string, sup string"), 0.5)
    assert {r.rep: r.merged for r in got.collect()} == merged(nodes, edges, 0.5)


def test_large_lattices_are_agglomerated_too(spark, tmp_path):
    rows = [(None, 2000, None), ("q", None, None), ("q", 2000, None), *[("q", 2000, f"s{i}") for i in range(3)], *[(None, 2000, f"t{i}") for i in range(2100)]]
    spark.createDataFrame(rows, "a1sur string, year bigint, source string").write.parquet(f"{tmp_path}/refmetas.parquet")
    got = [r.n for r in models.gr22_agglomerated(spark, str(tmp_path)).collect()]
    assert sum(got) == len(rows) and sorted(got)[-1] > 1
