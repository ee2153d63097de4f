"""Graph operators on small graphs: every rule, in both directions where it can be undone."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from whygraph import queries
from whygraph.durable import durable
from whygraph.operators import audit, decisions, evidence, gate, link, reason, repair, retrieval, threads, upsert
from whygraph.plans import build
from whygraph.schema import DECISION, EDGE, NODE, PENDING
from whygraph.sources import payloads
from whygraph.streaming import cursors, ingest

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 6, 1), datetime(2025, 1, 1)
def now():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")



def at(time):
    return F.lit(time).cast("timestamp")


class Small:
    """A hand-made graph: nodes by name, edges by the names of their ends."""

    def __init__(self, spark):
        self.spark, self.ids, self.rows, self.links, self.made, self.facts = spark, {}, [], [], [], []

    def node(self, name, kind, thread=None, repo=1, title=None, **detail):
        self.ids[name] = len(self.ids) + 1
        self.rows.append((self.ids[name], kind, repo, name, None, title or name, None, thread, None, None, None, self.ids[name]))
        if kind in ("issue", "pull_request"):
            self.facts.append((self.ids[name], kind, repo, detail.get("merged"), detail.get("closed"), detail.get("reason"), detail.get("body", "")))
        if kind == "decision":
            self.made.append((self.ids[name], detail.get("status", "reconstructed"), title or name, None, self.ids.get(detail.get("source"))))
        return self

    def edge(self, src, dst, kind, extractor="x", tag="explicit", tier=None, start=T0, end=None, relevance=None):
        n = len(self.links) + 1
        self.links.append((n, self.ids[src], self.ids[dst], kind, tag, tier or tag, extractor, None, relevance, None, start, end, n))
        return self

    @property
    def nodes(self):
        return self.spark.createDataFrame(self.rows, NODE)

    @property
    def edges(self):
        return self.spark.createDataFrame(self.links, EDGE.replace("decimal(5,4)", "double")).withColumn("relevance", F.col("relevance").cast("decimal(5,4)"))

    @property
    def decisions(self):
        return self.spark.createDataFrame(self.made, DECISION)

    @property
    def artifacts(self):
        return self.spark.createDataFrame(self.facts, "node_id long, node_type string, repo_id long, merged_at timestamp, closed_at timestamp, state_reason string, body string")

    def name(self, node_id):
        return next(n for n, i in self.ids.items() if i == node_id)


def case(spark, *, merged=T1, impl="pull_request", motive=True, validation=None, keys=("thread:1:pr-2", "thread:1:pr-2"), status="reconstructed"):
    g = Small(spark)
    g.node("issue", "issue", keys[0]).node("change", impl, keys[1], merged=merged).node("pr", "pull_request", keys[1], merged=merged).node("bob", "person", repo=None).node("d", "decision", keys[0], status=status, source="issue")
    if motive:
        g.edge("d", "issue", "motivated_by")
    if impl:
        g.edge("d", "change", "implemented_by")
    if validation == "closes":
        g.edge("pr", "issue", "closes")
    if validation == "reviewed":
        g.edge("bob", "pr", "reviewed")
    return g


def verdict(g):
    r = decisions.rubric(g.decisions, g.edges, g.nodes, g.edges, g.artifacts).first()
    return r.passes, (r.failure_reason or "")[:8]


def test_rubric(spark):
    assert verdict(case(spark)) == (True, "")
    assert verdict(case(spark, motive=False, validation="closes")) == (False, "clause 1")
    assert verdict(case(spark, impl="wiki_page")) == (False, "clause 2")
    assert verdict(case(spark, impl="wiki_page", validation="closes")) == (True, "")
    assert verdict(case(spark, impl="wiki_page", validation="reviewed")) == (True, "")
    assert verdict(case(spark, merged=None, validation="closes")) == (False, "clause 2")
    assert verdict(case(spark, keys=("thread:1:pr-2", "thread:1:pr-3"))) == (False, "clause 3")
    assert verdict(case(spark, keys=("thread:1:pr-2", None))) == (False, "clause 3")
    bare = Small(spark).node("d", "decision")
    assert verdict(bare) == (False, "clause 1")


def test_retraction_keeps_explicit_decisions(spark):
    assert decisions.unsupported(*[getattr(case(spark, merged=None), n) for n in ("nodes", "decisions", "edges", "artifacts")]).count() == 1
    assert decisions.unsupported(*[getattr(case(spark, merged=None, status="explicit"), n) for n in ("nodes", "decisions", "edges", "artifacts")]).count() == 0
    assert decisions.unsupported(*[getattr(case(spark), n) for n in ("nodes", "decisions", "edges", "artifacts")]).count() == 0


def synthesis(g, edges=None, nodes=None, made=None):
    made = decisions.synthesize(nodes or g.nodes, made or g.decisions, edges or g.edges, g.artifacts, now())
    return decisions.Synthesis(*map(durable, (made.nodes, made.decisions, made.edges, made.outcomes)))


def test_synthesis_creates_refreshes_refuses_and_supersedes(spark):
    g = Small(spark)
    g.node("i", "issue", "thread:1:pr-2", title="why").node("late", "pull_request", "thread:1:pr-2", closed=T0).node("good", "pull_request", "thread:1:pr-2", merged=T1)
    g.node("i2", "issue", "thread:1:pr-9").node("p2", "pull_request", "thread:1:pr-9")
    g.edge("late", "i", "closes").edge("good", "i", "closes").edge("p2", "i2", "closes")
    first = synthesis(g)
    assert {r.thread_key: r.outcome for r in first.outcomes.collect()} == {"thread:1:pr-2": "created", "thread:1:pr-9": "refused"}
    made = first.decisions.collect()
    assert [(r.status, r.summary, r.decided_at) for r in made] == [("reconstructed", "why", T1)]
    ends = {(r.edge_type, r.dst_id) for r in first.edges.filter(F.col("src_id") == made[0].node_id).collect()}
    assert ends == {("motivated_by", g.ids["i"]), ("implemented_by", g.ids["good"])}
    again = synthesis(g, first.edges, first.nodes, first.decisions)
    assert {r.outcome for r in again.outcomes.collect()} == {"refreshed", "refused"}
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, first.edges.collect()))
    assert again.nodes.count() == first.nodes.count() == 6
    # Another implementer: the old edge is closed, not deleted.
    moved = synthesis(g, first.edges.withColumn("valid_to", F.when((F.col("src_id") == g.ids["good"]) & (F.col("edge_type") == "closes"), at(T2)).otherwise(F.col("valid_to"))), first.nodes, first.decisions)
    credits = moved.edges.filter("edge_type = 'implemented_by'").collect()
    assert {(r.dst_id, r.valid_to is None) for r in credits} == {(g.ids["good"], False), (g.ids["late"], True)}
    # A merge renamed the thread: the decision is found by its live key, and renamed.
    renamed = first.nodes.withColumn("thread_key", F.when(F.col("thread_key") == "thread:1:pr-2", "thread:1:pr-1").otherwise(F.col("thread_key")))
    after = synthesis(g, first.edges, renamed, first.decisions)
    assert {r.thread_key: r.outcome for r in after.outcomes.collect()}["thread:1:pr-1"] == "refreshed"
    assert after.nodes.filter("node_type = 'decision'").first().external_id == "thread:1:pr-1"


def test_upgrade_to_explicit(spark):
    g = case(spark).node("r2", "release", title="2.0").node("r1", "release", title="1.0")
    g.edge("pr", "r1", "deployed_by").edge("issue", "r2", "deployed_by")
    after, edges, found = map(durable, decisions.upgrade_explicit(g.nodes, g.decisions, g.edges, now()))
    row = after.first()
    assert (row.status, g.name(row.source_artifact_id)) == ("explicit", "r2")
    assert edges.filter("extractor = 'synthesis_release_note'").first().source_ref == "release:2.0 via #issue"
    assert decisions.upgrade_explicit(g.nodes, after, edges, now())[2].count() == 0


def test_credit(spark):
    g = case(spark).node("c", "commit", "thread:1:pr-2").node("old", "pull_request", "thread:1:pr-2").node("empty", "decision")
    g.edge("d", "c", "implemented_by").edge("d", "old", "implemented_by", end=T2)
    notes = {g.name(r.node_id): r.note for r in decisions.credit(g.decisions, g.nodes, g.edges, g.artifacts).collect()}
    assert notes == {"d": "implemented by commit c; PR change, merged 2024-06-01", "empty": "no current implementer"}


def signals(spark, kinds, extra=()):
    g = Small(spark)
    t = "thread:1:pr-2"
    g.node("issue", "issue", t).node("pr", "pull_request", t).node("c", "commit", t).node("r", "release").node("bob", "person", repo=None)
    edges = {"declared": ("pr", "issue", "closes", "pr_body_closing_keyword"), "structural": ("pr", "c", "implements", "pr_commit_list"), "attested": ("bob", "pr", "reviewed", "pr_review"), "published": ("pr", "r", "deployed_by", "release_notes_reference")}
    for k in kinds:
        g.edge(*edges[k])
    for e in extra:
        g.edge(*e[:4], **(e[4] if len(e) > 4 else {}))
    return g


def tiers(g):
    edges, changed = evidence.apply_tiers(g.nodes, g.edges)
    return {(g.name(r.src_id), g.name(r.dst_id), r.edge_type): r.tier for r in edges.collect()}, tuple(changed.first())


def test_corroboration(spark):
    three = ("declared", "structural", "attested")
    up, n = tiers(signals(spark, three, [("bob", "issue", "created", "issue_author"), ("issue", "c", "references", "llm", {"tag": "inferred", "relevance": 0.9})]))
    assert n == (3, 0) and up[("bob", "pr", "reviewed")] == "corroborated"
    assert up[("bob", "issue", "created")] == "explicit" and up[("issue", "c", "references")] == "inferred"
    assert tiers(signals(spark, three[:2], [("pr", "issue", "implements", "synthesis_x")]))[1] == (0, 0)
    assert tiers(signals(spark, three[:2], [("bob", "pr", "reviewed", "pr_review", {"end": T2})]))[1] == (0, 0)
    down, n = tiers(signals(spark, three[:1], [("pr", "c", "implements", "pr_commit_list", {"tier": "corroborated"})]))
    assert n == (0, 1) and down[("pr", "c", "implements")] == "explicit"
    published, _ = tiers(signals(spark, three + ("published",)))
    assert published[("pr", "r", "deployed_by")] == "explicit"
    g = signals(spark, three)
    edges = durable(evidence.apply_tiers(g.nodes, g.edges)[0])
    assert tuple(evidence.apply_tiers(g.nodes, edges)[1].first()) == (0, 0)


def sequential(rows, decided, least, cap, held, base):
    out, count, pairs = {}, Counter(base), set(held)
    for pos, src, dst, kind, relevance in rows:
        if relevance is None or src == dst:
            out[pos] = "invalid"
        elif src in decided or dst in decided:
            out[pos] = "rejected_decision"
        elif round(relevance, 4) < least:
            out[pos] = "rejected_threshold"
        elif (src, dst, kind) in pairs:
            out[pos] = "invalid"
        elif max(count[src], count[dst]) >= cap:
            out[pos] = "rejected_cap"
        else:
            out[pos] = "accepted"
            pairs.add((src, dst, kind))
            count.update((src, dst))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_equals_row_by_row(spark, seed):
    draw = random.Random(seed)
    g = Small(spark)
    for k in range(12):
        g.node(f"n{k}", "issue")
    g.node("d", "decision")
    g.edge("n0", "n1", "relates_to", tag="inferred", relevance=0.8).edge("n2", "n3", "depends_on", tag="inferred", relevance=0.9, end=T2)
    rows = [(k, draw.randint(1, 13), draw.randint(1, 13), draw.choice(["depends_on", "relates_to"]), draw.choice([None, 0.5, 0.74996, 0.75, 0.9, 1.0])) for k in range(90)]
    proposals = spark.createDataFrame(rows, "pos long, src_id long, dst_id long, edge_type string, relevance double")
    found = {r.pos: r.outcome for r in gate.gate(proposals, g.nodes, g.edges).collect()}
    expected = sequential(rows, {13}, 0.75, 4, {(1, 2, "relates_to")}, {1: 1, 2: 1})
    assert found == expected
    edges = gate.accepted_edges(gate.gate(proposals, g.nodes, g.edges), now())
    assert edges.count() == sum(x == "accepted" for x in expected.values())


def test_only_unconnected_pairs_are_proposed(spark):
    g = Small(spark).node("a", "issue").node("b", "pull_request").node("c", "issue").node("bob", "person")
    g.edge("b", "a", "closes").edge("bob", "a", "created").edge("bob", "c", "created").edge("c", "b", "closes", end=T1)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "src_id long, dst_id long")
    assert {tuple(r) for r in gate.unconnected(pairs, g.edges).collect()} == {(1, 3), (3, 2)}


def test_threads_do_not_depend_on_order(spark):
    draw = random.Random(7)
    g = Small(spark)
    for k in range(30):
        g.node(f"p{k}", "pull_request" if k % 2 else "issue", f"thread:1:{'pr' if k % 2 else 'issue'}-{k}")
    for k in range(20):
        g.node(f"c{k}", "commit")
    for _ in range(25):
        a, b = draw.sample(range(30), 2)
        g.edge(f"p{a}", f"p{b}", "closes")
    for k in range(18):
        g.edge(f"p{draw.randrange(30)}", f"c{k}", "implements", "pr_commit_list")
    g.edge("c18", "c19", "closes").edge("p0", "p29", "references")
    root = {i: i for i in g.ids.values()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b, kind, *_ in g.links:
        if kind != "references":
            root[top(a)] = top(b)
    members = defaultdict(list)
    for name, i in g.ids.items():
        if name[0] == "p":
            members[top(i)].append((0 if int(name[1:]) % 2 else 1, int(name[1:])))
    expected = {n: (lambda m: f"thread:1:{'pr' if m[0] == 0 else 'issue'}-{m[1]}")(min(members[top(i)])) if members[top(i)] else None for n, i in g.ids.items()}
    found = {g.name(r.node_id): r.thread_key for r in threads.cluster(g.nodes, g.edges.orderBy(F.rand(3))).collect()}
    assert found == expected
    half = g.edges.filter("seq <= 20")
    step = threads.cluster(g.nodes, half)
    assert {g.name(r.node_id): r.thread_key for r in threads.cluster(step, g.edges.filter("seq > 20")).collect()} == expected
    assert {g.name(r.node_id): r.thread_key for r in threads.merge_threads(step, g.edges.filter("seq > 20")).collect()} == expected


def walk_graph(spark):
    g = Small(spark)
    g.node("d", "decision").node("i", "issue").node("p", "pull_request").node("c", "commit").node("lonely", "commit").node("x", "commit")
    g.edge("d", "i", "motivated_by").edge("d", "p", "implemented_by", tier="corroborated").edge("p", "c", "implements").edge("p", "i", "closes", start=T1).edge("x", "p", "references", tag="inferred", relevance=0.9)
    return g


def ask(g, **starts):
    rows = [(name, g.ids[name], mode, depth, as_of) for name, (mode, depth, as_of) in starts.items()]
    return g.spark.createDataFrame(rows, "question_id string, start_id long, mode string, depth int, as_of timestamp")


def test_reasoning_is_explicit_first(spark):
    g = walk_graph(spark)
    starts = ask(g, c=("why", 3, T2), d=("why", 3, T2), x=("why", 3, T2), lonely=("why", 3, T2), i=("impact", 2, T2))
    paths, summary = reason.reason(starts, g.nodes, g.edges)
    said = {r.question_id: (r.answered, r.used_inferred_fallback, r.paths) for r in summary.collect()}
    found = {(r.question_id, tuple(map(g.name, r.path_nodes)), r.tier_rank) for r in paths.collect()}
    assert said["lonely"] == (False, True, 0) and said["x"] == (True, True, 1) and said["c"] == (True, False, 1)
    assert ("c", ("c", "p", "d"), 1) in found and ("x", ("x", "p", "d"), 2) in found
    assert {p for q, p, _ in found if q == "d"} == {("d", "i"), ("d", "p")}
    assert {p for q, p, _ in found if q == "i"} == {("i", "p"), ("i", "p", "c"), ("i", "p", "d")}
    shown = {(r.question_id, r.number): r for r in reason.hydrate(paths, g.nodes, g.edges, decisions.credit(g.decisions, g.nodes, g.edges, g.artifacts)).collect()}
    c = shown[("c", 1)]
    assert (c.tier, c.depth, c.start, [s.direction for s in c.steps]) == ("corroborated", 2, "commit:c — c", ["reverse", "reverse"])
    assert c.steps[1].to_node == "decision:d — d  [implemented by PR p, NOT MERGED]"
    lines = {r.question_id: r.trace for r in reason.trace(reason.hydrate(paths, g.nodes, g.edges)).filter("question_id = 'c'").collect()}
    assert lines["c"] == "commit:c — c\n==<- implements [explicit] (x)\npull_request:p — p\n++<- implemented_by [corroborated] (x)\ndecision:d — d"


def test_walks_respect_time_depth_and_parallel_edges(spark):
    g = walk_graph(spark).edge("d", "p", "implements")
    early = ask(g, i=("impact", 2, T0))
    assert {tuple(map(g.name, r.path_nodes)) for r in reason.walk(early, g.edges).collect()} == set()
    late = reason.walk(ask(g, p=("why", 1, T2)), g.edges).collect()
    assert Counter(tuple(map(g.name, r.path_nodes)) for r in late) == {("p", "d"): 2, ("p", "c"): 1}
    assert reason.walk(ask(g, p=("why", 0, T2)), g.edges).count() == 0


def test_walks_over_ended_edges_equal_brute_force(spark):
    draw, day = random.Random(11), timedelta(days=1)
    g = Small(spark)
    for i in range(14):
        g.node(f"n{i}", draw.choice(["issue", "pull_request", "commit"]))
    for _ in range(160):
        start = T0 + draw.randint(-9000, 900) * day + timedelta(seconds=draw.choice([0, 1, 43_200]))
        lasts = draw.choice([None, 0, -400, 0.01, 1, 1, 5, 16, 200, 256, 3000, 4096, 9000, 70_000])
        kind = draw.choice(["closes", "implements", "references", "depends_on", "created"])
        g.edge(f"n{draw.choice([0, draw.randint(0, 13)])}", f"n{draw.randint(1, 13)}", kind, start=start, end=None if lasts is None else start + lasts * day, tag=draw.choice(["explicit", "explicit", "inferred"]))
    instants = [T0 + draw.randint(-9000, 900) * day for _ in range(4)] + [g.links[5][10], g.links[9][10], *[e[11] for e in g.links if e[11] is not None][:3], datetime(2100, 1, 1), datetime(1950, 1, 1)]
    asked = [(f"{mode} {start} {n}", g.ids[start], mode, draw.choice([1, 2, 3]), at) for start in ("n0", "n3", "n9") for mode in ("why", "impact") for n, at in enumerate(instants)]
    starts = spark.createDataFrame(asked, "question_id string, start_id long, mode string, depth int, as_of timestamp")
    follows = {"why": reason.WHY_EDGES, "impact": reason.IMPACT_EDGES}

    def paths(here, seen, used, left, mode, at, inferred):
        for edge, src, dst, kind, tag, _, _, _, _, _, begin, end, _ in g.links if left else ():
            held = begin <= at and (end is None or end > at) and kind in follows[mode] and (inferred or tag == "explicit")
            for a, b in ((src, dst), (dst, src)):
                if held and a == here and b not in seen:
                    yield (*seen, b), (*used, edge)
                    yield from paths(b, (*seen, b), (*used, edge), left - 1, mode, at, inferred)

    for inferred in (False, True):
        expected = Counter((q, nodes, edges) for q, start, mode, depth, at in asked for nodes, edges in paths(start, (start,), (), depth, mode, at, inferred))
        found = Counter((r.question_id, tuple(r.path_nodes), tuple(r.path_edges)) for r in reason.walk(starts, g.edges, inferred).collect())
        assert found == expected and len(expected) > 150
    assert reason.walk(starts, g.edges.limit(0)).count() == 0 and reason.walk(starts.limit(0), g.edges).count() == 0


def test_details_are_filled_from_payloads(spark):
    raws = [
        ("pull_request", None, None, '{"pull_request": {"merged_at": "2024-06-01T00:00:00Z"}, "state_reason": "completed"}', T1, None),
        ("pull_request", T0, None, '{"pull_request": {"merged_at": "2024-06-01T00:00:00Z"}}', T0, None),
        ("pull_request", None, None, '{"pull_request": {"merged_at": "soon"}}', None, None),
        ("pull_request", None, None, '{"pull_request": null}', None, None),
        ("pull_request", None, None, '[1, 2]', None, None),
        ("issue", None, None, '{"state_reason": "not_planned", "pull_request": {"merged_at": "2024-06-01T00:00:00Z"}}', None, "not_planned"),
        ("issue", None, "reopened", '{"state_reason": "completed"}', None, "reopened"),
        ("issue", None, None, '{"state_reason": null}', None, None),
        ("issue", None, None, '{"state_reason": "comp', None, None),
        ("issue", None, None, "", None, None),
        ("issue", None, None, None, None, None),
    ]
    details = spark.createDataFrame([(i, kind, merged, why, "kept") for i, (kind, merged, why, *_) in enumerate(raws)] + [(99, "issue", None, None, "kept")], "node_id long, node_type string, merged_at timestamp, state_reason string, raw string")
    nodes = spark.createDataFrame([(i, raw) for i, (_, _, _, raw, _, _) in enumerate(raws)], "node_id long, raw string")
    found = {r.node_id: (r.merged_at, r.state_reason, r.raw) for r in repair.backfill_from_raw(details, nodes).collect()}
    assert found == {i: (merged, why, "kept") for i, (*_, merged, why) in enumerate(raws)} | {99: (None, None, "kept")}
    assert repair.backfill_from_raw(details.limit(0), nodes).count() == 0


def test_retrieval_equals_brute_force(spark):
    draw = random.Random(4)
    g = Small(spark)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Login", "logout", "crash", "100%", "a_b", "é"]
    for k in range(60):
        g.node(str(k), "issue" if k % 3 else "pull_request", repo=k % 2, title=" ".join(draw.choices(vocabulary, k=draw.randint(1, 5))))
    g.rows.append((999, "issue", 1, "none", None, None, None, None, None, None, None, 999))
    asked = [("q1", g.rows[5][5], None, None), ("q2", "#7", None, None), ("q3", "ALPHA", ["issue"], None), ("q4", "login crsh", None, 1), ("q5", "  ", None, None), ("q6", "%eta", None, None), ("q7", "zzzz", None, None), ("q8", "a_", None, None), ("q9", "é gamma", None, None)]
    questions = spark.createDataFrame(asked, "question_id string, question string, node_types array<string>, repo_id long")
    found = defaultdict(list)
    for r in retrieval.find_candidates(questions, g.nodes, 1000).orderBy("question_id", "rank").collect():
        found[r.question_id].append((r.node_id, r.match, round(r.score, 6)))

    import re

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in re.split(r"[^\w]|_", t.lower()) if w for i in range(len(w) + 1)}

    for qid, q, kinds, repo in asked:
        q, best = q.strip(), {}
        like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q) + ".*", re.IGNORECASE | re.DOTALL)
        for i, kind, home, ext, _, title, *_ in g.rows:
            if not q or title is None or (kinds and kind not in kinds) or (repo is not None and home != repo):
                continue
            a, b = grams(title), grams(q)
            share = len(a & b) / len(a | b) if a | b else 0
            tiers = [(1.0, 0, "exact")] * (title.lower() == q.lower()) + [(0.95, 1, "identifier")] * (ext == q.lstrip("#")) + [(0.75, 2, "prefix")] * bool(like.fullmatch(title)) + [(share, 3, "fuzzy")] * (share >= 0.25)
            if tiers:
                score, tier, match = min(tiers, key=lambda t: (-round(t[0], 6), t[1]))
                best[i] = (-round(score, 6), tier, i, match)
        assert found[qid] == [(i, match, -score) for score, _, i, match in sorted(best.values())], qid
    assert found["q7"] == found["q5"] == []
    limited = retrieval.find_candidates(questions, g.nodes, 2)
    assert limited.groupBy("question_id").count().agg(F.max("count")).first()[0] == 2


def test_questions_are_about_every_20th_order(spark, tmp_path):
    spark.createDataFrame([(k, k % 3, "F", T0, f"{k % 5}-X") for k in range(200)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, c) for c in range(3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(c, c) for c in range(3)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    g = Small(spark)
    for k in range(200):
        g.node(str(k), "issue" if k % 4 == 0 else "pull_request", title=f"{k % 5}-X order {k}")
    rows = queries.questions(queries.asked_orders(spark, str(tmp_path)))
    first = {r.question_id: (r.external_id, r.score) for r in retrieval.find_candidates(rows, g.nodes, 3).filter("rank = 1").collect()}
    asked = {r.question_id: r.question.strip() for r in rows.collect()}
    expected = {}
    for k in range(0, 200, 20):
        expected |= {f"title:{k}": f"{k % 5}-X order {k}", f"number:{k}": f"#{k}", f"start:{k}": f"{k % 5}-X order {k}"[:12].strip(), f"swapped:{k}": f"{k} order {k % 5}-X"}
    assert asked == expected
    assert all(first[f"title:{k}"] == (str(k), 1.0) and first[f"number:{k}"] == (str(k), 0.95) and first[f"swapped:{k}"][1] == 1.0 for k in range(0, 200, 20))


def sighted(spark, rows):
    return spark.createDataFrame(rows, "src_id long, dst_id long, edge_type string, extractor string, source_ref string, observed_at timestamp, seq long")


def test_edge_merges(spark):
    none = spark.createDataFrame([], EDGE)
    batch = sighted(spark, [(1, 2, "closes", "a", "r", T1, 1), (1, 2, "closes", "b", None, None, 2), (3, 3, "closes", "a", None, None, 3), (2, 1, "closes", "c", None, None, 4)])
    first = upsert.upsert_edges(none, batch, now())
    rows = {(r.src_id, r.dst_id): r for r in first.collect()}
    assert set(rows) == {(1, 2), (2, 1)} and all(r.created for r in rows.values())
    assert (rows[1, 2].extractor, rows[1, 2].source_ref, rows[1, 2].valid_from) == ("b", "r", T1)
    assert rows[2, 1].valid_from == datetime(2025, 6, 1)
    again = upsert.upsert_edges(first.drop("created"), batch, now())
    assert not any(r.created for r in again.collect())
    assert sorted(map(str, again.drop("created").collect())) == sorted(map(str, first.drop("created").collect()))
    closed = upsert.withdraw_edges(first.drop("created"), first.filter("src_id = 1").select("edge_id"), now())
    reopened = upsert.upsert_edges(closed, batch.filter("src_id = 1"), at(T2)).filter("src_id = 1")
    assert reopened.count() == 2 and reopened.filter("valid_to is null and created").count() == 1


def test_node_and_detail_merges(spark):
    row = lambda title, key, updated, seq, created=None: (1, "issue", 1, "5", None, title, None, key, created, updated, None, seq)
    first = upsert.upsert_nodes(spark.createDataFrame([], NODE), spark.createDataFrame([row("a", "k1", T1, 1, T0), row(None, "k2", T0, 2, T2)], NODE))
    one = first.first()
    assert (one.title, one.thread_key, one.source_updated_at, one.source_created_at) == ("a", "k1", T1, T0)
    two = upsert.upsert_nodes(first, spark.createDataFrame([row("b", "k9", T0, 7, T2)], NODE)).first()
    assert (two.title, two.thread_key, two.source_updated_at, two.source_created_at, two.seq) == ("b", "k1", T1, T0, 1)
    details = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "node_id long, body string, seq long")
    after = upsert.upsert_details(details, spark.createDataFrame([(1, "z", 3), (1, None, 4), (3, "w", 5)], "node_id long, body string, seq long"))
    assert {(r.node_id, r.body) for r in after.collect()} == {(1, None), (2, "y"), (3, "w")}


def test_ledger(spark):
    counts = spark.createDataFrame([("nodes", 3), ("edges", 4)], "name string, n long")
    skips = spark.createDataFrame([("late",), ("late",), ("self",)], "reason string")
    row = upsert.run_row("r1", "ok", counts, skips).first()
    assert (row.status, row.counts, row.skips) == ("ok", {"edges": 4, "nodes": 3}, {"late": 2, "self": 1})


def test_queue_and_drain(spark):
    g = Small(spark).node("10", "pull_request").node("11", "issue").node("12", "issue", repo=2)
    refs = "repo_id long, src_id long, ref_number long, edge_type string, extractor string, source_ref string, observed_at timestamp, seq long"
    rows = [(1, 1, 11, "closes", "x", None, T1, 1), (1, 1, 12, "closes", "x", None, None, 2), (1, 1, 12, "closes", "y", None, None, 3), (1, 1, 10, "references", "x", None, None, 4), (1, 1, 99, "references", "x", None, None, 5)]
    found, unresolved = link.resolve(spark.createDataFrame(rows, refs), g.nodes)
    assert {(r.src_id, r.dst_id) for r in found.collect()} == {(1, 2), (1, 1)} and unresolved.count() == 3
    queue = link.enqueue(spark.createDataFrame([], PENDING), unresolved)
    assert sorted(r.ref_number for r in queue.collect()) == [12, 99]
    assert link.enqueue(queue, unresolved).count() == 2
    g.node("99", "issue")
    status = link.pending_status(queue, g.nodes).orderBy("edge_type").collect()
    assert [(r.edge_type, r.open_refs, r.resolvable_now, r.target_outside_window) for r in status] == [("closes", 1, 0, 1), ("references", 1, 1, 0)]
    drained, edges = link.drain(queue, g.nodes, now())
    assert [(r.src_id, r.dst_id) for r in edges.collect()] == [(1, 4)]
    assert {(r.ref_number, r.attempts, r.resolved_at is not None, r.resolved_edge_id is not None) for r in drained.collect()} == {(12, 1, False, False), (99, 1, True, True)}
    assert link.drain(drained, g.nodes, now())[1].count() == 0


def test_projections(spark):
    def table(rows, schema):
        return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))

    base = {"repo_id": 1, "repo": "org/repo"}
    feed = table([
        base | {"seq": 1, "number": 4, "title": "I", "state": "", "user": {"login": "ann"}, "created_at": "2024-01-01T00:00:00Z", "state_reason": "completed"},
        base | {"seq": 2, "number": 5, "title": "P", "body": "fixes #4", "user": {"login": ""}, "pull_request": {"merged_at": "2024-02-01T00:00:00Z"}, "merged_at": "2020-01-01T00:00:00Z"},
    ], payloads.ARTIFACT)
    nodes, details, created = payloads.artifacts(feed)
    assert {(r.node_type, r.external_id, r.thread_key) for r in nodes.collect()} == {("issue", "4", "thread:1:issue-4"), ("pull_request", "5", "thread:1:pr-5")}
    assert {(r.state, r.body, r.state_reason, r.merged_at) for r in details.collect()} == {("unknown", "", "completed", None), ("unknown", "fixes #4", None, datetime(2024, 2, 1))}
    assert created.count() == 1 and payloads.people(feed, "user").count() == 1
    reviews = table([base | {"seq": 1, "number": 5, "reviews": [{"id": 9, "state": "CHANGES_REQUESTED", "user": {"login": "bob"}}, {"id": 10, "state": "APPROVED", "user": None}]}], payloads.REVIEWS)
    people, reviewed = payloads.reviews(reviews)
    assert [r.source_ref for r in reviewed.collect()] == ["review:9:CHANGES_REQUESTED"] and people.count() == 1
    lists = table([base | {"seq": 1, "number": 5, "commits": [{"sha": "a" * 40, "commit": {"message": "T" * 250 + "\nbody", "author": {"date": "2024-01-02T00:00:00Z"}}, "author": {"login": "ann"}, "parents": [{"sha": "b" * 40}, {"sha": "c" * 40}]}, {"sha": "b" * 40}]}], payloads.COMMITS)
    each = payloads.commit_rows(lists)
    nodes, details, edges = payloads.commits(each)
    assert {len(r.title) for r in nodes.collect()} == {200, 0}
    assert Counter(r.edge_type for r in edges.collect()) == {"created": 1, "implements": 2}
    linked, outside = payloads.parents(each, nodes)
    assert linked.count() == 1 and [r.parent for r in outside.collect()] == ["c" * 40]
    release = table([base | {"seq": 1, "id": 7, "tag_name": "", "name": "", "body": "Includes #4, fixes #5, #99"}], payloads.RELEASE)
    nodes, details = payloads.releases(release)
    assert (nodes.first().external_id, nodes.first().title) == ("7", "7")
    deployed, missed = link.release_links(details, payloads.artifacts(feed)[0])
    assert deployed.count() == 2 and [r.ref_number for r in missed.collect()] == [99]
    pages = table([base | {"seq": 1, "total_count": 1, "workflows": [{"id": 3, "path": "", "name": "ci"}]}], payloads.WORKFLOWS)
    nodes, details = payloads.workflows(payloads.unwrapped(pages, "workflows"))
    assert (nodes.first().external_id, details.first().path) == ("3", "3")
    import base64 as b64

    files = table([base | {"seq": k, "path": p, "content": b64.b64encode(c).decode()} for k, (p, c) in enumerate([("docs/CODEOWNERS", b"* @x"), ("CODEOWNERS", b"* @org/a/b @ann\n/y \xff @zed"), ("other", b"* @no")])], payloads.OWNERS)
    nodes, rules, owns = payloads.owners(files)
    assert {(r.node_type, r.external_id) for r in nodes.collect()} == {("codeowners_scope", "CODEOWNERS:1"), ("codeowners_scope", "CODEOWNERS:2"), ("team", "org/a/b"), ("person", "ann"), ("person", "�"), ("person", "zed")}
    assert {(r.org, r.slug) for r in payloads.teams(nodes).collect()} == {("org", "a/b")} and owns.count() == 4
    root, detail = payloads.repositories(table([base | {"seq": 0, "full_name": "org/repo"}], payloads.REPOSITORY))
    assert root.first().repo_id is None and (detail.first().owner, detail.first().name) == ("org", "repo")


def test_buckets_and_details(spark):
    g = Small(spark)
    g.node("1", "pull_request", "t1", body="fixes #9").node("2", "issue", "t2").node("3", "issue", "t3").node("4", "pull_request", "t3")
    g.node("5", "issue", "t4", reason="completed").node("6", "pull_request", "t4").node("7", "issue", "t5").node("8", "pull_request", "t5", merged=T1).node("9", "issue", "t6").node("d", "decision", "t6")
    g.edge("6", "5", "closes").edge("8", "7", "closes")
    facts = audit.thread_facts(g.nodes, g.edges, g.artifacts)
    assert {r.bucket[0]: r.threads for r in audit.recall_buckets(facts).collect()} == {"A": 1, "D": 1, "C": 1, "B": 1, "F": 1}
    assert [tuple(r) for r in audit.unmerged_detail(facts, g.nodes, g.artifacts).collect()] == [("t4", "5", "completed", 1, 0)]
    assert tuple(audit.issueless_detail(facts, g.nodes, g.artifacts).first()) == (1, 0, 1, 1)
    assert audit.cross_thread_closes(g.nodes, g.edges.unionByName(Small.edges.fget(SimpleNamespace(spark=spark, links=[(99, 1, 2, "closes", "explicit", "explicit", "x", None, None, None, T0, None, 99)])))).first()[0] == 1


def test_violations_are_found(spark):
    g = case(spark, merged=None).node("d2", "decision", "thread:9:pr-1").node("odd", "planet")
    g.edge("pr", "pr", "closes").edge("pr", "issue", "closes", tier="inferred").edge("pr", "issue", "closes").edge("issue", "pr", "closes", start=T1, end=T0)
    pending = spark.createDataFrame([(1, 1, 5, "closes", "x", None, None, 0, None, T1, None, 1)], PENDING)
    people = spark.createDataFrame([("a",), ("a",)], "login string")
    repositories = spark.createDataFrame([("o", "n")], "owner string, name string")
    found = {r.rule for r in audit.violations(g.nodes, g.edges, g.decisions, pending, g.artifacts, people, repositories).filter("violations > 0").collect()}
    assert found == {
        "a decision's key names its repository", "node types are known", "no edge to itself", "edges end after they begin", "tag and tier agree", "one current edge a pair and type",
        "reconstructed decisions pass the rubric", "resolution has its time and its edge", "logins are unique",
    }


def test_contracts_and_summary(spark):
    rows = [("a", "q", "why", "No answer", False, True, 1, 0), ("b", "q", "why", "no candidates", True, False, 0, 3), ("c", "r", "why", "fewer paths than a", True, False, 2, 1), ("e", "r", "why", None, False, True, 2, 4), ("f", "s", "why", "no answer", True, False, 1, 1)]
    table = spark.createDataFrame(rows, "id string, query string, mode string, contract string, answered boolean, used_inferred_fallback boolean, n long, paths long")
    checked = table.withColumn("contract_check", audit.contract_check(F.col("contract"), F.col("answered"), F.col("n")))
    assert [r.contract_check for r in checked.orderBy("id").collect()] == ["HELD", "HELD", "COMPARE", None, "VIOLATED: an answer was returned"]
    assert tuple(audit.evaluation_summary(checked).first()) == (5, 3, 2, 2, 2, 2)
    assert [tuple(r) for r in audit.sibling_compare(checked).collect()] == [("c", "e", 1, 4)]


def test_repairs(spark):
    g = Small(spark)
    g.node("r", "repository", repo=1).node("a", "decision", "thread:1:pr-1", repo=1).node("b", "decision", "thread:1:pr-1", repo=1).node("c", "decision", "thread:1:pr-1", repo=2).node("e", "decision", "thread:3:pr-4", repo=2).node("i", "issue").node("k", "commit")
    assert repair.unscope_repositories(g.nodes).filter("node_type = 'repository'").first().repo_id is None
    assert [g.name(r.node_id) for r in repair.duplicate_decisions(g.nodes).collect()] == ["b"]
    assert [g.name(r.node_id) for r in repair.misplaced_twins(g.nodes).collect()] == ["c"]
    assert {r.external_id: r.repo_id for r in repair.rehome(g.nodes).collect()}["e"] == 3
    assert {r.external_id for r in repair.sync_names(g.nodes).filter("node_type = 'decision'").collect()} == {"thread:1:pr-1", "thread:3:pr-4"}
    g.edge("i", "r", "closes", "body_closing_keyword").edge("k", "r", "references", "body_issue_mention").edge("k", "i", "closes", "other")
    assert [r.extractor for r in repair.split_provenance(g.edges, g.nodes).orderBy("seq").collect()] == ["pr_body_closing_keyword", "commit_message_issue_mention", "other"]
    left = upsert.delete_nodes({"nodes": g.nodes, "edges": g.edges, "decisions": g.decisions}, g.nodes.filter("external_id in ('i', 'b')"))
    assert (left["nodes"].count(), left["edges"].count(), left["decisions"].count()) == (5, 1, 3)


def test_cursors(spark):
    wanted = spark.createDataFrame([(1, "issues"), (1, "commits"), (1, "releases")], "repo_id long, resource string")
    start = cursors.start_cursors(spark.createDataFrame([], cursors.CURSOR), wanted, at(T2), 1)
    assert {(r.resource, r.phase) for r in start.collect()} == {("issues", "backfill"), ("commits", "backfill"), ("releases", "steady")}
    times = [datetime(2024, 11, 1), datetime(2024, 12, 10), datetime(2024, 12, 20)]
    rows = spark.createDataFrame([(1, s, t) for s in ("issues", "commits", "releases") for t in times], "repo_id long, resource string, updated_at timestamp")
    assert Counter(r.resource for r in cursors.due(rows, start).collect()) == {"issues": 2, "commits": 2, "releases": 3}
    none = spark.createDataFrame([], "repo_id long, resource string")
    one = cursors.advance(start, rows.filter("updated_at > '2024-12-15'"), none)
    two = cursors.advance(one, rows.filter("updated_at < '2024-12-15' and updated_at > '2024-12-01'"), none)
    by = {r.resource: r for r in two.collect()}
    assert by["commits"].backfill_cursor == times[1] and {r.steady_watermark for r in by.values()} == {times[2]}
    assert Counter(r.resource for r in cursors.due(rows, two).collect()) == {"issues": 1, "commits": 1, "releases": 3}
    done = {r.resource: r.phase for r in cursors.advance(two, rows.limit(0), wanted).collect()}
    assert done == {"issues": "backfill", "commits": "steady", "releases": "steady"}
    assert cursors.start_cursors(two, wanted, at(T0), 9).count() == 3


def test_a_derived_graph_follows_its_files(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for t in build.TABLES:
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    one = build.derived_graph(spark, str(tmp_path))
    assert build.derived_graph(spark, str(tmp_path)) is one
    spark.read.parquet(f"{source}/orders.parquet").filter("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    two = build.derived_graph(spark, str(tmp_path))
    assert two is not one
    assert 0 < two.artifacts.count() < spark.read.parquet(f"{source}/orders.parquet").count()
