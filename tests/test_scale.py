"""What queries handle on the way grows with their input or result, not with pairs of rows; results stay as they are."""

import re

from pyspark.sql import functions as F

from loomgraph.operators import observe as OB


def joined_rows(spark, made):
    """The most rows that a join gave while made() ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    made()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            for m in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(re.sub(r"\D", "", values.apply(metric.accumulatorId()))))
    return most


def test_function_urls_meet_once(spark):
    n = F.col("id")
    reads = spark.range(500).select(n.alias("node"), F.when(n % 5 > 0, "A").otherwise("B").alias("variable")).union(spark.range(3).selectExpr("id", "'B'")).union(spark.range(4).selectExpr("id + 600", "'none'"))
    urls = spark.range(400).select(F.when(n % 2 == 0, "A").otherwise("B").alias("variable"), n.alias("function"))
    entries = spark.range(400).select(n.alias("function"), F.concat(F.lit("e"), (n % 4).cast("string")).alias("entry")).filter("function <> 7")
    found = []
    most = joined_rows(spark, lambda: found.extend(OB.function_urls(reads, urls, entries).collect()))
    want = {(k, e) for k in range(500) for e in (("e0", "e2") if k % 5 else ("e1", "e3"))} | {(k, e) for k in range(3) for e in ("e1", "e3")}
    assert sorted((r.node, r.entry) for r in found) == sorted(want)
    assert 400 <= most <= 1100


def test_reached_starts_need_no_python(spark):
    from loomgraph.operators import bitmaps as B

    numbers = B.numbered_starts(spark.range(40000).select(F.concat(F.lit("s"), "id").alias("id")))
    n = F.col("id")
    edges = spark.range(40000).select(F.concat(F.lit("s"), n).alias("from_id"), F.concat(F.lit("m"), n % 2).alias("to_id")).union(spark.createDataFrame([("m0", "z"), ("z", "m0"), ("z", "m1"), ("m1", "m1")], "a string, b string"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    bits = B.reach_bits(edges, numbers, 16)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    assert plans and not any("ArrowEval" in p or "MapInPandas" in p or "MapInArrow" in p for p in plans)
    ways = {r.id: r.ways for r in bits.groupBy("id").agg(F.sum(F.bitmap_count("bits")).alias("ways")).filter("id in ('m0', 'm1', 'z', 's7')").collect()}
    assert ways == {"m0": 20000, "m1": 40000, "z": 20000, "s7": 1}
    got = B.unfolded(bits.filter("id in ('z', 'm1')"), ["id"], numbers)
    assert {(r.id, r.n, r.c) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("start").alias("c")).collect()} == {("z", 20000, 20000), ("m1", 40000, 40000)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_sides_of_channels_are_folded_before_they_meet(spark, tmp_path):
    from loomgraph.plans import catalog

    tables = {
        "region": "select 0 r_regionkey, 'ASIA' r_name", "nation": "select 0 n_nationkey, 'N' n_name, 0 n_regionkey", "part": "select 1L p_partkey, 'B' p_brand, 'p' p_name",
        "supplier": "select id s_suppkey, 's' s_name, 0 s_nationkey from range(40)", "customer": "select id c_custkey, 'c' c_name, 0 c_nationkey, 'm' c_mktsegment from range(40)",
        "orders": "select id o_orderkey, id o_custkey, '1' o_orderpriority from range(40)", "lineitem": "select id l_orderkey, 1L l_partkey, id l_suppkey, 1 l_linenumber from range(40)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("join_14_taken_publishes", "join_30_boundaries"):
        found = []
        assert 0 < joined_rows(spark, lambda: found.extend(catalog.queries()[name](spark, str(tmp_path)).collect())) <= 80
        if name == "join_14_taken_publishes":
            takers = sorted(f"customer:{i}" for i in range(40) if i % 3)
            assert sorted((r.from_id, r.to_id, r.takers, r.sure) for r in found) == sorted((f"supplier:{i}", "channel:B.1.1", takers, True) for i in range(40))
        else:
            assert [tuple(r) for r in found] == [("ASIA", "ASIA", "channel:B.1.1", 40 * 26)]


def test_edges_are_folded_by_tasks_of_bounded_rows(spark, monkeypatch):
    from loomgraph import store as ST
    from loomgraph.plans import graph_queries as GQ
    from loomgraph.sources import views as V

    d = "/root/testdata/sf0.001"
    kinds = ["type", "from_type", "to_type", "n"]
    plain = sorted(map(str, GQ.hydrate(spark, d).select(*kinds).collect())), V.edges(spark, d).exceptAll(V.edges(spark, d)).count()
    monkeypatch.setattr(ST, "ROWS_A_TASK", 500)
    lines = V.read(spark, d, "lineitem")
    rows = lines.count()
    dealt = ST.spread(lines, rows, "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey")
    per = dealt.groupBy(F.spark_partition_id().alias("p")).count()
    assert dealt.rdd.getNumPartitions() == -(-rows // 500) and per.agg(F.max("count")).first()[0] < 1000
    assert sorted(map(str, GQ.hydrate(spark, d).select(*kinds).collect())) == plain[0] and plain[1] == 0
    assert joined_rows(spark, lambda: GQ.hydrate(spark, d).collect()) <= V.edges(spark, d).count()


def test_members_of_archives_are_handed_on_together(spark):
    from loomgraph.sources import more_traces as M

    docs = spark.range(0, 500, 1, 1).select(F.concat(F.lit("d"), "id").alias("name"), F.concat(F.lit("é"), "id").alias("document"))
    got = M.unzipped(M.zipped(docs))
    per = got.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), got.schema).count()  # a row a batch
    assert per == 1 and sorted(map(tuple, got.collect())) == sorted((f"d{i}.har", f"é{i}") for i in range(500))


def test_a_channel_survey_joins_no_names(spark):
    from loomgraph.plans import graph_queries as GQ

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    plan = GQ.channel_survey(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3 and lines > 0


def shuffled_rows(spark, made):
    """The rows that all exchanges wrote while made() ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    made()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            for m in range(nodes.apply(k).metrics().size()):
                metric = nodes.apply(k).metrics().apply(m)
                if metric.name() == "shuffle records written" and values.contains(metric.accumulatorId()):
                    rows += int(re.sub(r"\D", "", values.apply(metric.accumulatorId())) or 0)
    return rows


def test_a_long_front_at_few_ids_is_not_shuffled(spark, monkeypatch):
    from loomgraph import store as ST
    from loomgraph.operators import traverse as T

    for m in (ST, T):
        monkeypatch.setattr(m, "BROADCAST_BYTES", 100 * T.ROW_BYTES, raising=False)
    n = F.col("id")
    steps = [(f"p{i}", f"s{(i + 3 * j) % 20}") for i in range(2000) for j in range(5)] + [(f"s{i}", f"n{i % 4}") for i in range(20)] + [("n0", "s0"), ("n0", "p7")]
    edges = spark.createDataFrame(steps, "from_id string, to_id string").withColumns({"type": F.lit("t"), "confidence": F.lit("static")})
    seeds = spark.range(2000).select(F.concat(F.lit("p"), n).alias("id"), F.concat(F.lit("p"), n).alias("seed"))
    ways, want = {}, {}
    for a, b in steps:
        ways.setdefault(a, set()).add(b)
    for i in range(2000):
        front = {f"p{i}"}
        for k in range(4):
            for x in front:
                want[f"p{i}", x] = k
            front = {b for x in front for b in ways.get(x, ()) if (f"p{i}", b) not in want}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.seed, r.id): r.depth for r in T.reach(edges, seeds, "out", None, 3, by="seed").collect()}
        rows = shuffled_rows(spark, lambda: T.reach(edges, seeds, "out", None, 2, by="seed"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and 0 < rows < 48_000


def test_rows_are_dealt_without_being_held(spark):
    from loomgraph import store as ST

    tasks = [ST.spread(spark.range(10), rows * ST.ROWS_A_TASK, "id").rdd.getNumPartitions() for rows in (3, 199, 206, 400, 401)]
    assert tasks == [4, 199, 200, 200, 401]


def test_ranked_findings_keep_ten_rows_a_task(spark, tmp_path, monkeypatch):
    import os

    import duckdb

    from loomgraph import store as ST
    from loomgraph.plans import catalog

    duck, d, name = duckdb.connect(), "/root/testdata/sf0.001", "gra_14_ranked_findings"
    for t in os.listdir(d):
        os.symlink(f"{d}/{t}", tmp_path / t)
    (tmp_path / "lineitem.parquet").unlink()
    n = F.col("id")
    part = F.when(n % 2 == 0, 99).when(n % 28 == 1, None).otherwise(n % 28)  # a hot one, fourteen of equal measure, one of them null
    lines = spark.range(2800).select((n % 1400).alias("l_orderkey"), part.alias("l_partkey"), (n % 25).alias("l_suppkey"), F.lit("R").alias("l_returnflag"))
    lines.unionByName(lines.filter("l_orderkey < 300")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for t in os.listdir(tmp_path):
        at = f"{tmp_path}/{t}/*.parquet" if t == "lineitem.parquet" else f"{tmp_path}/{t}"
        duck.sql(f"create view {t.removesuffix('.parquet')} as select * from '{at}'")
    monkeypatch.setattr(ST, "ROWS_A_TASK", 500)
    found = catalog.queries()[name](spark, str(tmp_path))
    columns = ["kind", "id", "measure", "place"]
    want = duck.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want)) and len(want) == 20
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "WindowGroupLimit" not in plan
