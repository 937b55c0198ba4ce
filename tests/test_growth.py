"""What grows with the input is never broadcast, however small the planner takes it to be."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, resolve
from corpusloom.plans import catalogue

#: The queries that failed over 1 GB by the driver's memory.
OF_RECORDS = """criticality_signals domain_evidence domain_pick domain_top10 imports_raw module_summary modules
    package_usage""".split()
OF_GRAPH = """by_blast contexts dependency_chain dependents endpoint_set hotspots hotspots_domain_page
    hotspots_warned_glob markdown_hotspots mutual_edges orphan_warnings orphans pagerank project_stats
    refactor_candidates reverse_edges""".split()
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def eager(spark):
    """A session whose planner takes everything for small, as it does packed files at size."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "1g")
    yield spark
    spark.conf.set(THRESHOLD, before)


def plans_of(spark, run) -> list[str]:
    """The physical plans of all that ``run`` executes, inner steps too."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def seen() -> dict[int, str]:
        bus.waitUntilEmpty(30_000)
        ran = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in (ran.apply(i) for i in range(ran.size()))}

    old = seen()
    run()
    new = [text for k, text in seen().items() if k not in old]
    assert new
    return new


def broadcasts(plans: list[str]) -> list[str]:
    return [line.strip() for text in plans for line in text.splitlines() if "BroadcastExchange" in line]


@pytest.fixture(scope="module")
def shared(eager, sf_dir):
    """Plans of what the queries share, made anew."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalogue, "_SHARED", {})
        of_records = plans_of(eager, lambda: catalogue.records(eager, sf_dir))
        yield {"records": of_records, "graph": plans_of(eager, lambda: catalogue.full(eager, sf_dir))}


@pytest.mark.parametrize("part", ["records", "graph"])
def test_shared_results_broadcast_nothing(shared, part):
    assert not broadcasts(shared[part])


@pytest.mark.parametrize("name", OF_RECORDS + OF_GRAPH)
def test_query_broadcasts_nothing(eager, sf_dir, shared, name):
    own = plans_of(eager, lambda: catalogue.QUERIES[name](eager, sf_dir).write.format("noop").mode("overwrite").save())
    assert not broadcasts(shared["records"] + (shared["graph"] if name in OF_GRAPH else []) + own)


@pytest.mark.parametrize("bare", [False, True])
def test_resolve_broadcasts_nothing(eager, bare):
    files = eager.range(40).select(F.concat(F.lit("src/a"), "id", F.lit(".py")).alias("path"))
    names = files.select(F.expr("concat('x', path)").alias("name")) if bare else None
    specs = files.select("path", F.lit(0).alias("pos"), F.regexp_extract("path", r"(a\d+)", 1).alias("spec"), F.lit("").alias("base"))
    made = resolve.resolve(specs, files, bare_names=names)
    assert not broadcasts(plans_of(eager, lambda: made.write.format("noop").mode("overwrite").save()))
    assert made.where("rel = path").count() == 40


def test_graph_loops_broadcast_nothing(eager):
    edges = eager.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    nodes = eager.createDataFrame([(x,) for x in "abcde"], "path string")
    got = {}

    def run():
        got["rank"] = graph.pagerank(nodes, edges, local_edges=0).count()
        got["scc"] = sorted(tuple(r) for r in graph.components(nodes, edges, local_edges=0).collect())
        got["chain"] = graph.dependency_chain(edges, "a", "d", local_edges=0)

    assert not broadcasts(plans_of(eager, run))
    assert got == {"rank": 5, "scc": [("a", "a"), ("b", "a"), ("c", "a")], "chain": ["a", "b", "c", "d"]}
