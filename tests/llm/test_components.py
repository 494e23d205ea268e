"""Connected components: the least id however edges come, in few tasks, and none of the old work for new edges."""

import random

import pytest

from gridlens.llm import components


def brute(edges):
    comp = {n: n for e in edges if e[0] != e[1] for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                moved = True
    return comp


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def tasks_of(spark, work):
    """What `work` returns, and the tasks of the stages that ran for it."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"counted-{random.random()}", "counted")
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = {s for job in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(job).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := seen.getStageInfo(s)))


def kinds():
    rng = random.Random(3)
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] * 2  # equal edges, too
    path = list(range(1000, 1200))
    rng.shuffle(path)
    yield list(zip(path, path[1:], strict=False)) + [(5, 5)] + [(9, i) for i in range(20, 60)]


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_components_broadcast_or_shuffled_equal_brute_force(spark, most):
    for edges in kinds():
        got = [(r["node"], r["comp"]) for r in components.connected(frame(spark, edges), most).collect()]
        assert dict(got) == brute(edges) and len(got) == len(dict(got))


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_components_after_further_edges_equal_those_of_all(spark, most):
    for edges in kinds():
        old, new = edges[::2], [*edges[1::2], (7000, 7001), (7002, 7002), (7001, edges[0][0])]
        found = components.connected(frame(spark, old), most)
        again = components.joined(found, frame(spark, new), most)
        got = [(r["node"], r["comp"]) for r in again.collect()]
        assert dict(got) == brute(old + new) and len(got) == len(dict(got))
        assert components.joined(again, frame(spark, []), most) is again


def test_a_round_takes_few_tasks(spark):
    """Counted with partitions that are not coalesced, as where each holds enough."""
    path = list(range(2000, 2200))
    random.Random(4).shuffle(path)
    edges = frame(spark, list(zip(path, path[1:], strict=False)))
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found, tasks = tasks_of(spark, lambda: components.connected(edges))
        assert {r["comp"] for r in found.collect()} == {2000} and found.count() == 200
        assert tasks <= TASKS, tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: 601 when this was written, 1049 with the steps that shuffled edges and minima at each join.
TASKS = 750
