"""Steps that must not grow faster than what they change."""

from pyspark.sql import functions as F

from whygraph.durable import nothing
from whygraph.functions import text
from whygraph.operators import decisions, evidence, link, reason, repair, retrieval, threads, upsert
from whygraph.plans import build
from whygraph.plans.build import split
from whygraph.schema import EDGE, NODE
from whygraph.sources import derived, payloads
from whygraph.streaming import ingest
from whygraph.streaming.ingest import ARTIFACTS

LINKS = "src_id long, dst_id long, edge_type string, extractor string"


def test_only_repeated_keys_are_grouped(spark):
    once, more = upsert.once_or_more(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "x long, y string"), "x")
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (None, "d")} and {tuple(r) for r in more.collect()} == {(2, "b"), (2, "c")}


def test_commits_of_one_pull_request_are_leaves(spark):
    listed = [(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)]  # 11 is in two lists, 13 also closes something
    rows = [(a, b, "implements", "pr_commit_list") for a, b in listed] + [(13, 4, "closes", "x"), (1, 5, "mentions", "x")]
    pairs, leaves = threads.contracted(spark.createDataFrame(rows, LINKS), spark.createDataFrame([], "a long, b long"))
    assert {tuple(r) for r in leaves.collect()} == {(10, 1), (11, 1), (12, 2)}
    assert {tuple(sorted(r)) for r in pairs.collect() if r.a != r.b} == {(1, 2), (4, 13), (3, 13)}


def test_a_step_writes_only_what_it_changes(spark, tmp_path):
    spark.range(10).withColumn("kind", F.col("id") % 2).write.parquet(f"{tmp_path}/before")
    before = spark.read.parquet(f"{tmp_path}/before")
    after = split(before, before.withColumn("id", F.col("id") + 100), F.col("kind") == 1)
    assert sorted(r.id for r in after.collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]
    assert set(before.inputFiles()) < set(after.inputFiles())


def test_labels_come_with_the_walk(spark):
    edge = "edge_id long, src_id long, dst_id long, edge_type string, tag string, tier string, valid_from timestamp, valid_to timestamp"
    t = F.lit("1995-01-01").cast("timestamp")
    edges = spark.createDataFrame([(1, 1, 2, "closes"), (2, 1, 3, "implements"), (3, 3, 2, "deployed_by")], "edge_id long, src_id long, dst_id long, edge_type string")
    edges = edges.select("*", F.lit("explicit").alias("tag"), F.lit("explicit").alias("tier"), t.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")).to(spark.createDataFrame([], edge).schema)
    begun = spark.createDataFrame([("q", 2, "impact", 2)], "question_id string, start_id long, mode string, depth int").withColumn("as_of", F.lit("1996-01-01").cast("timestamp"))
    labels = spark.createDataFrame([(1, "pr"), (2, "issue"), (3, "commit")], "node_id long, label string")
    found = reason.walk(begun, edges, most=2, labels=labels).collect()
    name = {1: "pr", 2: "issue", 3: "commit"}
    assert len(found) == 4 and all([name[n] for n in r.path_nodes] == r.path_labels for r in found)


def test_rows_of_lists_are_those_of_the_payloads(spark):
    source = derived.landed(spark, "/root/testdata/sf0.001")
    for rows, lists in ((source.commit_rows, payloads.commit_rows(source.commits)), (source.review_rows, payloads.review_rows(source.reviews))):
        assert rows.columns == lists.columns and rows.count() == lists.count() > 0 and rows.exceptAll(lists).isEmpty()


def test_joins_with_nothing_are_planned_away(spark):
    row = spark.createDataFrame([(1, "issue", 1, "1", None, "t", None, None, None, None, None, 1)], NODE)
    plan = lambda old: upsert.upsert_nodes(old, row)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan(spark.createDataFrame([], NODE)) and "FullOuter" not in plan(nothing(spark, NODE))


def test_often_sighted_names_keep_first_and_last_values(spark):
    row = lambda title, url, seq: (5, "person", None, "p", None, title, url, None, None, None, None, seq)
    found = upsert.folded(spark.createDataFrame([row("a", None, 1), row("b", "u", 2), row("a", None, 3), row(None, None, 4)], NODE)).first()
    assert (found.title, found.url, found.seq, found.external_id) == ("a", "u", 1, "p")


def test_targets_are_pull_requests_first(spark):
    row = lambda id_, kind, number, seq: (id_, kind, 1, number, None, None, None, None, None, None, None, seq)
    nodes = spark.createDataFrame([row(1, "issue", "7", 1), row(2, "pull_request", "7", 9), row(3, "issue", "8", 5), row(4, "commit", "8", 1), row(5, "pull_request", "9", None)], NODE)
    assert {tuple(r) for r in link.targets(nodes).collect()} == {(1, 7, 2), (1, 8, 3), (1, 9, 5)}


def test_leaves_take_or_give_a_key(spark):
    """Commit 11 has no key, commit 12 an earlier thread's; pull request 3 has neither key nor neighbours with one."""
    key = {1: "thread:1:issue-1", 12: "thread:1:pr-2"}
    kind = lambda n: "commit" if n > 9 else "pull_request"
    nodes = spark.createDataFrame([(n, kind(n), 1, str(n), None, None, None, key.get(n), None, None, None, n) for n in (1, 2, 3, 11, 12, 13, 14)], NODE)
    edges = spark.createDataFrame([(a, b, "implements", "pr_commit_list") for a, b in ((1, 11), (2, 12), (2, 14), (3, 13))], LINKS)
    after = {r.node_id: r.thread_key for r in threads.cluster(nodes, edges).collect()}
    assert after == {1: key[1], 11: key[1], 2: key[12], 12: key[12], 14: key[12], 3: None, 13: None}


def test_tiers_lose_no_edge(spark):
    """Only ids are joined to find what qualifies; an edge whose end is not among the nodes stays as it is."""
    nodes = spark.createDataFrame([(1, "pull_request", 1, "1", None, None, None, "k", None, None, None, 1)], NODE)
    edges = spark.createDataFrame([(9, 1, 77, "closes", "explicit", "explicit", "x_closing_keyword", None, None, None, None, None, 1)], EDGE)
    assert [r.tier for r in evidence.apply_tiers(nodes, edges)[0].collect()] == ["explicit"]


def test_totals_need_no_tiers(spark):
    source = derived.landed(spark, "/root/testdata/sf0.001")
    g = build.Graph(spark, source, F.lit(derived.INGESTED).cast("timestamp"))
    n = g.untiered.count()
    assert "edges" not in g.__dict__ and "tier" not in g.untiered.columns and n == g.edges.count()


def test_payloads_are_read_before_they_are_joined(spark):
    """Rows of a join hold the values found in a payload, not the parsed payload."""
    plan = repair.backfill_from_raw(spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], NODE))._jdf.queryExecution().analyzed().toString()
    assert 0 <= plan.index("Join") < plan.index("variant_get")


def test_new_rows_and_rows_that_stay_pass_a_merge_by(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string"), spark.createDataFrame([(2, "c"), (3, "d"), (4, "e"), (4, "f")], "x long, y string")
    assert [sorted(r.y for r in df.collect()) for df in upsert.met(old, new, "x")] == [["a"], ["b"], ["d"], ["c", "e", "f"]]


def test_leaves_take_keys_without_being_joined_by_components(spark, monkeypatch):
    """A keyless commit of one pull request is looked up; only threads and commits with more edges are joined."""
    key = lambda n: f"thread:1:pr-{n}"
    nodes = spark.createDataFrame([(n, "pull_request", 1, str(n), None, None, None, key(n), None, None, None, n) for n in (1, 2)] + [(n, "commit", 1, str(n), None, None, None, None, None, None, None, n) for n in (11, 12, 13)], NODE)
    pairs = [(1, 11, "implements"), (2, 12, "implements"), (1, 13, "implements"), (2, 13, "implements"), (9, 13, "implements")]
    edges = spark.createDataFrame([(n, a, b, t, "explicit", "explicit", "pr_commit_list", None, None, None, None, None, n) for n, (a, b, t) in enumerate(pairs)], EDGE)
    joined, whole = [], threads.components
    monkeypatch.setattr(threads, "components", lambda df: joined.append(df.filter("a <> b").count()) or whole(df))
    assert {r.node_id: r.thread_key for r in threads.merge_threads(nodes, edges).collect()} == {n: key(1) for n in (1, 2, 11, 12, 13)}
    assert joined == [1]


def test_landed_lines_are_parsed_once_and_missing_resources_are_known_to_be_empty(spark):
    lines = spark.createDataFrame([('{"repo_id": 1, "number": 5, "commits": [{"sha": "a"}, {"sha": "b"}]}', "commits"), ("{", "artifacts"), ("{}", "unknown")], "value string, resource string")
    rows = ingest.taken(lines)
    assert set(rows) == set(ingest.RESOURCES) and sorted(r.sha for r in rows["commits"].collect()) == ["a", "b"] and rows["artifacts"].isEmpty()
    assert "LocalRelation <empty>" in rows["releases"]._jdf.queryExecution().optimizedPlan().toString()


def test_a_decision_does_not_hang_on_the_order_of_rows_seen_at_equal_places(spark):
    nodes = spark.createDataFrame([(n, "issue" if n < 4 else "pull_request", 1, f"t{n}", "k", 0) for n in range(1, 7)], "node_id long, node_type string, repo_id long, title string, thread_key string, seq long")
    links = [(src, dst, "closes", "explicit") for src in (4, 5, 6) for dst in (1, 2, 3)]
    artifacts = nodes.select("node_id", "node_type", F.lit("1995-01-01").cast("timestamp").alias("merged_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    chosen = set()
    for rows in (links, links[::-1]):
        edges = spark.createDataFrame(rows, "src_id long, dst_id long, edge_type string, tag string").coalesce(1).withColumn("valid_to", F.lit(None).cast("timestamp"))
        chosen |= {(r.motivator_id, r.implementer_id) for r in decisions.candidates(nodes, edges, artifacts).collect()}
    assert chosen == {(1, 4)}


def test_traces_of_impact_need_no_grouping_of_paths(spark):
    rows = [(1, 1, 2, "closes", "explicit"), (2, 3, 2, "implements", "explicit"), (3, 1, 4, "deployed_by", "explicit"), (4, 5, 4, "deployed_by", "explicit"), (5, 6, 2, "depends_on", "inferred"), (6, 6, 5, "depends_on", "inferred")]
    edges = spark.createDataFrame(rows, "edge_id long, src_id long, dst_id long, edge_type string, tag string").withColumns({"tier": F.when(F.col("edge_id") == 2, "corroborated").otherwise(F.col("tag")), "extractor": F.lit("x"), "source_ref": F.lit(None).cast("string")})
    edges = edges.withColumns({"valid_from": F.lit("1995-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    nodes = spark.createDataFrame([(n, "issue", str(n), f"t{n}" if n % 2 else None) for n in range(1, 8)], "node_id long, node_type string, external_id string, title string")
    notes = spark.createDataFrame([(3, "said")], "node_id long, note string")
    begun = spark.createDataFrame([(f"q{n}", n, "impact", 2) for n in (2, 4, 6, 7)], "question_id string, start_id long, mode string, depth int").withColumn("as_of", F.lit("1996-01-01").cast("timestamp"))
    paths, _ = reason.reason(begun, nodes, edges, 2)
    expected = sorted(tuple(r) for r in reason.trace(reason.hydrate(paths, nodes, edges, notes)).select("question_id", "trace").collect())
    found = reason.impact_traces(begun, nodes, edges, notes, 2)
    assert sorted(tuple(r) for r in found.collect()) == expected and {q for q, _ in expected} == {"q2", "q4", "q6"}
    assert not any(step in found._jdf.queryExecution().executedPlan().toString() for step in ("Window", "Aggregate", "Generate explode(path"))


def test_trigrams_coded_in_tasks_are_those_of_the_text(spark):
    titles = ["", None, "Low order 12", "  a--b_c  ", "É İstanbul ß 100%", "aaa aaa aaaa", "x", "日本語 テスト", "\U0001f600 \U00010400a b"]
    rows = spark.createDataFrame(list(enumerate(titles)), "n int, title string")
    expected = {r.n: sorted(r.grams) for r in rows.select("n", text.trigram_codes(F.col("title")).alias("grams")).collect()}
    assert {r.n: r.grams for r in retrieval.with_grams(rows, "title").collect()} == expected


def test_the_last_step_looks_for_ends_only(spark):
    rows = [(1, 1, 2, "implements"), (2, 3, 2, "implements"), (3, 3, 4, "implements")]
    edges = spark.createDataFrame(rows, "edge_id long, src_id long, dst_id long, edge_type string").withColumns({"tag": F.lit("explicit"), "tier": F.lit("explicit")})
    edges = edges.withColumns({"valid_from": F.lit("1995-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    begun = spark.createDataFrame([("q", 2, "why", 2)], "question_id string, start_id long, mode string, depth int").withColumn("as_of", F.lit("1996-01-01").cast("timestamp"))
    paths = lambda ends: {tuple(r.path_nodes) for r in reason.walk(begun, edges, most=2, ends=ends).collect()}
    assert paths(None) == {(2, 1), (2, 3), (2, 3, 4)}
    assert paths(spark.createDataFrame([(4,)], "node_id long")) == {(2, 1), (2, 3), (2, 3, 4)} and paths(spark.createDataFrame([(1,)], "node_id long")) == {(2, 1), (2, 3)}
