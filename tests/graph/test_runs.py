"""Runs over all resources: order of landing, replays, crashes, incremental threads, retraction and the ledger."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from whygraph.operators import decisions, evidence, threads, upsert
from whygraph.schema import EDGE, NODE, node_id
from whygraph.streaming import ingest

DAY = "2024-0{}-01T00:00:00Z"
NOW = datetime(2025, 1, 1)


def artifact(number, body="", pr=False, merged=None, day=1, closed=None, state_reason=None):
    row = {"number": number, "title": f"t{number}", "body": body, "user": {"login": "ann"}, "created_at": DAY.format(day), "updated_at": DAY.format(day), "closed_at": closed, "state_reason": state_reason}
    return row | ({"pull_request": {"merged_at": merged and DAY.format(merged)}} if pr else {})


def review(number, who="bob"):
    return {"number": number, "reviews": [{"id": number, "state": "APPROVED", "submitted_at": DAY.format(3), "user": {"login": who}}]}


def commits(number, *shas, parents=()):
    each = [{"sha": s, "commit": {"message": "", "author": {}, "committer": {}}, "parents": [{"sha": p} for p in parents]} for s in shas]
    return {"number": number, "commits": each}


def release(tag, body):
    return {"id": 1, "tag_name": tag, "body": body, "published_at": DAY.format(5)}


def land(folder, wave, **resources):
    for name, rows in resources.items():
        target = folder / f"resource={name}"
        target.mkdir(parents=True, exist_ok=True)
        (target / f"{wave}.json").write_text("\n".join(json.dumps({"repo_id": 1, "repo": "org/repo", "seq": i} | r) for i, r in enumerate(rows)))


@pytest.fixture
def runs(spark, tmp_path):
    """Lands one wave after another, with a run of the stream after each; returns (state, go)."""
    state = ingest.State(spark, f"{tmp_path}/state")
    landing, count = tmp_path / "landing", [0]

    def go(**resources):
        land(landing, count[0], **resources)
        count[0] += 1
        ingest.stream(spark, str(landing), state, f"{tmp_path}/checkpoint", lambda: F.lit(f"2025-01-0{count[0]}").cast("timestamp"), months=600).awaitTermination()
        return state.latest()

    return state, go


def current(state):
    last = state.latest()
    nodes = state.read("nodes", last)
    names = nodes.select(F.col("node_id"), F.concat_ws(":", "node_type", "external_id").alias("name"))
    rows = state.read("edges", last).filter("valid_to is null").join(names.toDF("src_id", "src"), "src_id").join(names.toDF("dst_id", "dst"), "dst_id")
    keys = {r.name: r.thread_key for r in nodes.join(names, "node_id").collect()}
    return keys, {(r.src, r.edge_type, r.dst, r.tier) for r in rows.collect()}, {r.status for r in state.read("decisions", last).collect()}


def test_late_targets_merge_threads_and_replays_change_nothing(spark, runs, tmp_path):
    state, go = runs
    one = {"artifacts": [artifact(5, "fixes #4, see #9", True, 2)], "commits": [commits(5, "a" * 40, parents=["b" * 40])], "repositories": [{"full_name": "org/repo"}]}
    two = {"artifacts": [artifact(7, "closes #5", True, day=2)], "reviews": [review(5)], "workflows": [{"workflows": [{"id": 3, "path": "", "name": "ci", "state": "active"}]}]}
    three = {"artifacts": [artifact(4, "", day=3)], "releases": [release("v1", "Includes #5 and #77")], "proposals": [{"src_type": "issue", "src": "4", "dst_type": "workflow", "dst": "3", "edge_type": "relates_to", "relevance": 0.9}]}
    assert [go(**w) for w in (one, two, three)] == [0, 1, 2]
    keys, edges, statuses = current(state)
    assert {keys[n] for n in ("pull_request:5", "pull_request:7", "issue:4", f"commit:{'a' * 40}", "decision:thread:1:pr-5")} == {"thread:1:pr-5"}
    assert ("pull_request:5", "closes", "issue:4", "corroborated") in edges and ("issue:4", "relates_to", "workflow:3", "inferred") in edges
    assert ("decision:thread:1:pr-5", "deployed_by", "release:v1", "explicit") in edges and statuses == {"explicit"}
    queue = {r.ref_number: r.resolved_at for r in state.read("pending", 2).collect()}
    assert queue[9] is None and queue[4] is not None
    ledger = sorted(state.runs().collect(), key=lambda r: r.batch)
    assert [r.status for r in ledger] == ["ok"] * 3 and ledger[2].counts["resolved"] == 1 and ledger[2].counts["decisions_created"] == 1 and ledger[2].counts["proposals_accepted"] == 1
    assert ledger[0].skips == {"commit parent is not in the graph": 1} and ledger[2].skips == {"release note cites what is not in the graph": 1}
    assert go() == 2  # nothing new
    before = {name: sorted(map(str, state.read(name, 2).collect())) for name in ingest.TABLES}
    lines = spark.read.schema("value string, resource string").text(str(tmp_path / "landing")).filter(F.input_file_name().endswith("/2.json"))
    ingest.apply_batch(state, 2, lines, F.lit("2025-01-03").cast("timestamp"), 600)
    assert before == {name: sorted(map(str, state.read(name, 2).collect())) for name in ingest.TABLES}


def test_one_batch_gives_the_same_graph(spark, runs, tmp_path):
    state, go = runs
    go(artifacts=[artifact(1), artifact(2, "fixes #1, fixes #3", True, 2)], reviews=[review(2)])
    go(artifacts=[artifact(3, day=2), artifact(4, "fixes #3", True, 3, day=3)], commits=[commits(4, "c" * 40)])
    whole = ingest.State(spark, f"{tmp_path}/whole")
    ingest.apply_batch(whole, 0, spark.read.schema("value string, resource string").text(str(tmp_path / "landing")), F.lit("2025-01-02").cast("timestamp"), 600)
    assert current(state) == current(whole)


def test_a_crash_before_the_end_is_repeated(spark, runs, monkeypatch):
    state, go = runs
    go(artifacts=[artifact(1), artifact(2, "fixes #1", True, 2)])
    written = ingest.State.write

    def failing(self, name, batch, df):
        if name == "decisions" and batch == 1:
            raise RuntimeError("disk gone")
        written(self, name, batch, df)

    monkeypatch.setattr(ingest.State, "write", failing)
    with pytest.raises(Exception, match="disk gone"):
        go(artifacts=[artifact(3, "fixes #1", True, 3, day=2)])
    monkeypatch.setattr(ingest.State, "write", written)
    assert state.latest() == 0
    assert go() == 1
    keys, edges, _ = current(state)
    assert keys["pull_request:3"] == "thread:1:pr-2" and ("pull_request:3", "closes", "issue:1", "explicit") in edges
    assert [(r.batch, r.status, "disk gone" in (r.error or "")) for r in state.runs().orderBy("started_at").collect()] == [(0, "ok", False), (1, "failed", True), (1, "ok", False)]


def test_decisions_are_refreshed_superseded_and_retracted(runs):
    """A later, merged pull request takes over from an open commit; a decision whose merge is undone goes."""
    state, go = runs
    go(artifacts=[artifact(1), artifact(2, "fixes #1", True, 2), artifact(8), artifact(9, "fixes #8", True, 2)], reviews=[review(2), review(9)])
    _, edges, _ = current(state)
    assert ("decision:thread:1:pr-2", "implemented_by", "pull_request:2", "explicit") in edges and ("decision:thread:1:pr-9", "motivated_by", "issue:8", "explicit") in edges
    # 2 was reverted and 3 merged instead; 9 was never merged after all.
    go(artifacts=[artifact(2, "fixes #1", True, None, day=2), artifact(3, "fixes #1", True, 3, day=2), artifact(9, "fixes #8", True, None, day=2)])
    keys, edges, _ = current(state)
    assert ("decision:thread:1:pr-2", "implemented_by", "pull_request:3", "explicit") in edges and "decision:thread:1:pr-9" not in keys
    assert ("decision:thread:1:pr-2", "implemented_by", "pull_request:2", "explicit") not in edges
    closed = state.read("edges", 1).filter("valid_to is not null").collect()
    assert [(r.edge_type, r.valid_to) for r in closed] == [("implemented_by", datetime(2025, 1, 2))]
    counts = {r.batch: r.counts for r in state.runs().collect()}
    assert counts[1]["decisions_refreshed"] == 1 and counts[1]["retracted"] == 1 and counts[0]["decisions_created"] == 2


def test_tiers_go_down_when_an_edge_is_withdrawn(spark):
    """Three kinds of signals lift a thread's edges; when the review is withdrawn, two are left."""
    nodes = spark.createDataFrame([(i, kind, 1, str(i), None, "t", None, "thread:1:pr-2", None, None, None, i) for i, kind in ((1, "issue"), (2, "pull_request"), (3, "commit"))] + [(4, "person", None, "bob", None, "bob", None, None, None, None, None, 4)], NODE)
    start = datetime(2024, 1, 1)
    rows = [(1, 2, 1, "closes", "pr_body_closing_keyword"), (2, 2, 3, "implements", "pr_commit_list"), (3, 4, 2, "reviewed", "pr_review")]
    edges = spark.createDataFrame([(e, s, d, t, "explicit", "explicit", x, None, None, None, start, None, e) for e, s, d, t, x in rows], EDGE)
    up, changed = evidence.apply_tiers(nodes, edges)
    assert tuple(changed.first()) == (3, 0)
    down, changed = evidence.apply_tiers(nodes, upsert.withdraw_edges(up, up.filter("edge_id = 3"), F.lit(NOW)))
    assert tuple(changed.first()) == (0, 3) and {r.edge_id: r.tier for r in down.collect()}[1] == "explicit"


def test_incremental_threads_equal_full_clustering(spark):
    draw = random.Random(11)
    kinds = ["issue", "pull_request", "commit"]
    members = [(k, kinds[min(2, k % 4)]) for k in range(40)]
    ids = {k: k + 1 for k, _ in members}
    key = lambda k, kind: None if kind == "commit" else f"thread:1:{'pr' if kind == 'pull_request' else 'issue'}-{k}"
    nodes = spark.createDataFrame([(ids[k], kind, 1, str(k), None, "t", None, key(k, kind), None, None, None, k) for k, kind in members], NODE)
    keyed, plain = [k for k, kind in members if kind != "commit"], [k for k, kind in members if kind == "commit"]
    links = [(draw.choice(keyed), draw.choice(plain), "implements", "pr_commit_list") for _ in range(14)] + [(draw.choice(keyed + plain), draw.choice(keyed), "closes", "x") for _ in range(14)]
    links = [x for x in links if x[0] != x[1]]
    draw.shuffle(links)
    edges = lambda some: spark.createDataFrame([(n, ids[a], ids[b], t, "explicit", "explicit", x, None, None, None, None, None, n) for n, (a, b, t, x) in enumerate(some)], EDGE)
    step = nodes
    for end in range(7, len(links) + 7, 7):
        step = threads.merge_threads(step, edges(links[end - 7 : end]))
        whole = threads.cluster(nodes, edges(links[:end]))
        assert {(r.node_id, r.thread_key) for r in step.collect()} == {(r.node_id, r.thread_key) for r in whole.collect()}


def test_unreadable_lines_and_unknown_resources(spark, tmp_path):
    state = ingest.State(spark, f"{tmp_path}/state")
    lines = spark.createDataFrame([("{", "artifacts"), ("{}", "reviews"), ('{"repo_id": 1}', "unknown"), (None, "artifacts")], "value string, resource string")
    ingest.apply_batch(state, 0, lines, F.lit(NOW))
    assert state.read("nodes", 0).count() == 0 and state.latest() == 0


def test_ids_follow_names(spark):
    assert spark.range(1).select(node_id(F.lit("issue"), F.lit(1), F.lit("4")) != node_id(F.lit("issue"), F.lit(2), F.lit("4"))).first()[0]
    assert decisions.current(spark.createDataFrame([], EDGE), "closes").count() == 0
