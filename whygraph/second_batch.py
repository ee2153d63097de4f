"""A second batch derived from the order database, and the queries over what it changes, with their SQL.

The first batch only adds to an empty graph. Here rows are seen again, edges are withdrawn, targets come
late, and stored tables are wrong in the ways that repairs mend. Every query covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import link, repair, upsert
from .plans.build import derived_graph
from .schema import EDGE, NODE, PENDING, edge_id, node_id
from .sources import derived, payloads
from .streaming import cursors as cursor_rules

LATER = "2099-01-01 00:00:00"


def filled(rows: DataFrame, schema: str) -> DataFrame:
    """`rows` with the columns of `schema`, null where they are missing."""
    fields = [f.strip().split(" ", 1) for f in schema.replace("decimal(5,4)", "decimal(5;4)").split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind.replace(";", ",")).alias(n) for n, kind in fields])


def name(k: Column) -> Column:
    return k.cast("string")


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes of the first batch: every fourth without a URL, every second without a key."""
    k, kind = F.col("k"), F.when(F.col("is_issue"), "issue").otherwise("pull_request")
    rows = derived.order_rows(spark, sf_dir).select(
        node_id(kind, F.col("repo_id"), name(k)).alias("node_id"), kind.alias("node_type"), "repo_id", name(k).alias("external_id"), "title", F.when(k % 4 != 0, F.concat(F.lit("u"), name(k))).alias("url"),
        F.when(k % 2 != 0, F.lit("old")).alias("thread_key"), F.col("ordered").alias("source_created_at"), F.col("ordered").alias("source_updated_at"), k.alias("seq"),
    )
    return filled(rows, NODE)


def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third node is seen again twice, first with a title and a key, then older and with a URL; some are new."""
    old = stored_nodes(spark, sf_dir)
    again = old.filter("seq % 3 = 0")
    one = again.withColumns({"title": F.concat(F.lit("First "), "external_id"), "url": F.lit(None).cast("string"), "thread_key": F.lit("new"), "source_updated_at": F.col("source_updated_at") + F.expr("interval 1 day")})
    two = again.withColumns({"title": F.lit(None).cast("string"), "url": F.concat(F.lit("v"), "external_id"), "thread_key": F.lit(None).cast("string"), "source_updated_at": F.col("source_updated_at") - F.expr("interval 2 days"), "seq": F.col("seq") + 1_000_000_000})
    new = old.filter("seq % 50 = 0").withColumn("external_id", F.concat(F.lit("n"), "external_id")).withColumn("node_id", node_id(F.col("node_type"), F.col("repo_id"), F.col("external_id")))
    merged = upsert.upsert_nodes(old, one.unionByName(two).unionByName(new))
    return merged.select("node_type", "external_id", "title", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("thread_key", F.lit("")).alias("thread_key"), F.to_date("source_updated_at").alias("updated"), "seq")


def merged_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third detail row is replaced by the last of two; where that one has no body, the body goes."""
    old = stored_nodes(spark, sf_dir).select("node_id", F.col("title").alias("body"), "seq")
    again = old.filter("seq % 3 = 0")
    last = again.withColumns({"body": F.when(F.col("seq") % 6 != 0, F.concat(F.lit("again "), "body")), "seq": F.col("seq") + 1_000_000_000})
    first = again.withColumns({"body": F.lit("passing"), "seq": F.col("seq") + 500_000_000})
    return upsert.upsert_details(old, first.unionByName(last)).select(F.coalesce("body", F.lit("")).alias("body"), "seq")


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from every order to the next number; every fifth is closed."""
    k = F.col("k")
    rows = derived.order_rows(spark, sf_dir).select(
        k.alias("src_id"), (k + 1).alias("dst_id"), F.lit("references").alias("edge_type"), F.lit("explicit").alias("tag"), F.lit("explicit").alias("tier"), F.lit("first").alias("extractor"),
        F.concat(F.lit("r"), name(k)).alias("source_ref"), F.col("ordered").alias("observed_at"), F.col("ordered").alias("valid_from"), F.when(k % 5 == 0, F.col("ordered") + F.expr("interval 1 day")).alias("valid_to"), k.alias("seq"),
    )
    return filled(rows.withColumn("edge_id", edge_id(F.col("src_id"), F.col("dst_id"), F.col("edge_type"), F.col("valid_from"))), EDGE)


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second edge is seen again, by another extractor and without a reference; then every seventh is withdrawn."""
    now = F.lit(LATER).cast("timestamp")
    old = stored_edges(spark, sf_dir)
    seen = old.filter("src_id % 2 = 0").select("src_id", "dst_id", "edge_type", F.lit("second").alias("extractor"), F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("timestamp").alias("observed_at"), "seq")
    loops = seen.withColumn("dst_id", F.col("src_id"))
    merged = upsert.upsert_edges(old, seen.unionByName(loops), now)
    created = merged.select("edge_id", "created")
    after = upsert.withdraw_edges(merged.drop("created"), merged.filter("src_id % 7 = 0"), now).join(created, "edge_id")
    return after.select(F.col("src_id").alias("k"), "extractor", F.coalesce("source_ref", F.lit("")).alias("source_ref"), F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "created")


def deleted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of nodes and edges once every eleventh node is deleted."""
    nodes = stored_nodes(spark, sf_dir).withColumn("node_id", F.col("seq"))
    left = upsert.delete_nodes({"nodes": nodes, "edges": stored_edges(spark, sf_dir)}, nodes.filter("seq % 11 = 0"))
    return left["nodes"].select(F.lit("nodes").alias("table"), "seq").unionByName(left["edges"].select(F.lit("edges").alias("table"), "seq"))


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger row of a run that skipped every returned line, and its skip reasons by number, most frequent first."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    skips = read("lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("returned line "), F.col("l_linenumber").cast("string")).alias("reason"))
    counts = read("orders").groupBy(F.concat(F.lit("orders "), "o_orderstatus").alias("name")).agg(F.count("*").alias("n"))
    row = upsert.run_row("run-2", "finished", counts, skips)
    each = lambda kind: row.select("run_id", "status", F.lit(kind).alias("kind"), F.explode(kind).alias("name", "n"))
    found = each("counts").unionByName(each("skips"))
    more = found.groupBy("kind").agg(F.sort_array(F.collect_list("n"), asc=False).alias("all"))
    return found.join(more, "kind").select("run_id", "status", "kind", "name", "n", F.array_position("all", F.col("n")).alias("place"))


def coauthor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-authors of messages made of order lines, one line each, and a second one, oddly spelled, of returned lines."""
    line = F.concat(F.lit("Ship part "), F.col("l_partkey").cast("string"), F.lit("\n\nCo-authored-by: Supplier "), F.col("l_suppkey").cast("string"), F.lit(" <s"), F.col("l_suppkey").cast("string"), F.lit("@example.org>"))
    odd = F.when(F.col("l_returnflag") == "R", F.lit("\nCO-authored-BY:  Return Desk  <returns@example.org>  ")).otherwise("\nnot Co-authored-by: Nobody <n@example.org>")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.posexplode(text.coauthors(F.concat(line, odd))).alias("place", "who"))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"), F.col("place").cast("long").alias("place"), "who.name", "who.email")


def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's parent is the line before it; a first line's is the first line of the order before it, mostly elsewhere."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    sha = lambda k, n: F.concat(F.lit("c-"), name(k), F.lit("-"), n.cast("string"))
    before = F.when(F.col("n") > 1, sha(F.col("k"), F.col("n") - 1)).otherwise(sha(F.col("k") - 1, F.lit(1)))
    commits = lines.join(derived.order_rows(spark, sf_dir).select("k", "repo_id", "ordered"), "k")
    each = commits.select("repo_id", sha(F.col("k"), F.col("n")).alias("sha"), F.col("ordered").alias("committed_at"), F.col("k").alias("seq"), F.array(F.struct(before.alias("sha"))).alias("parents"))
    known = each.select(F.lit("commit").alias("node_type"), payloads.commit_id().alias("node_id"))
    edges, missing = payloads.parents(each, known)
    names = each.select(payloads.commit_id().alias("src_id"), "sha")
    found = edges.join(names, "src_id").select("sha", F.col("source_ref").alias("parent"), F.lit(True).alias("known"))
    return found.unionByName(missing.select("sha", "parent", F.lit(False).alias("known")))


def workflow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as workflows; those without a path go by their number."""
    n = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_regionkey").cast("long").alias("repo_id"), F.when(n % 3 != 0, F.concat(F.lit(".github/"), F.lower("n_name"))).otherwise("").alias("path"), n.cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("active").alias("state"),
        none.alias("node_id"), none.alias("html_url"), none.alias("created_at"), none.alias("updated_at"), n.cast("long").alias("seq"),
    )
    nodes, details = payloads.workflows(rows)
    return nodes.join(details.select("node_id", "path", "state"), "node_id").select("node_type", "repo_id", "external_id", "title", "path", "state")


def late_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order closes the next number but one. Odd orders come first, even ones late, and the queue is drained once before and once after."""
    nodes, now = stored_nodes(spark, sf_dir), F.lit(LATER).cast("timestamp")
    bodies = nodes.select("repo_id", F.lit("org/any").alias("repo"), F.col("node_id").alias("src_id"), "node_type", F.concat(F.lit("Fixes #"), (F.col("seq") + 2).cast("string")).alias("text"), F.lit("ref").alias("source_ref"), F.col("source_updated_at").alias("observed_at"), "seq")
    early = nodes.filter("seq % 2 = 1")
    _, waiting = link.resolve(link.reference_rows(bodies), early)
    queue = link.enqueue(spark.createDataFrame([], PENDING), waiting)
    tried, _ = link.drain(queue, early, now)
    after, _ = link.drain(tried, nodes, now)
    return after.select(F.col("seq").alias("k"), "ref_number", "edge_type", "extractor", "attempts", F.col("resolved_at").isNotNull().alias("resolved"), F.col("resolved_edge_id").isNotNull().alias("linked"))


def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as earlier rules left them: stale names, keys of another repository, and twins."""
    k, home = F.col("k"), F.col("repo_id")
    orders = derived.order_rows(spark, sf_dir).filter("not is_issue")
    key = F.concat(F.lit("thread:"), home.cast("string"), F.lit(":pr-"), name(k))
    base = orders.select(k.alias("seq"), F.lit("decision").alias("node_type"), F.when(k % 10 == 1, (home + 1) % 5).otherwise(home).alias("repo_id"), key.alias("thread_key"), F.when(k % 3 == 0, F.concat(F.lit("stale "), key)).otherwise(key).alias("external_id"))
    twins = base.filter("seq % 20 = 1").withColumns({"seq": F.col("seq") + 1_000_000_000, "repo_id": F.split_part("thread_key", F.lit(":"), F.lit(2)).cast("long")})
    again = base.filter("seq % 7 = 0").withColumn("seq", F.col("seq") + 2_000_000_000)
    homes = spark.read.parquet(f"{sf_dir}/region.parquet").select((F.col("r_regionkey") + 3_000_000_000).cast("long").alias("seq"), F.lit("repository").alias("node_type"), F.col("r_regionkey").cast("long").alias("repo_id"), F.lit(None).cast("string").alias("thread_key"), F.col("r_name").alias("external_id"))
    rows = base.unionByName(twins).unionByName(again).unionByName(homes)
    return filled(rows.withColumn("node_id", F.col("seq")), NODE)


def repaired_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins in the wrong repository and repeats go, the others move home, names follow keys, repositories belong to none."""
    nodes = stored_decisions(spark, sf_dir)
    left = upsert.delete_nodes({"nodes": nodes}, repair.misplaced_twins(nodes))["nodes"]
    left = repair.rehome(left)
    left = upsert.delete_nodes({"nodes": left}, repair.duplicate_decisions(left))["nodes"]
    done = repair.unscope_repositories(repair.sync_names(left))
    return done.select("seq", "node_type", F.coalesce("repo_id", F.lit(-1)).alias("repo_id"), "external_id")


def repaired_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels of edges take the kind of their source: pull requests and issues have bodies, order lines messages."""
    orders = stored_nodes(spark, sf_dir).select("node_id", "node_type", "seq")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("seq")).distinct()
    commits = lines.select(F.xxhash64(F.lit("line"), "seq").alias("node_id"), F.lit("commit").alias("node_type"), (F.col("seq") + 1_000_000_000).alias("seq"))
    nodes = filled(orders.unionByName(commits), NODE)
    old = F.when(F.col("seq") % 3 == 0, "body_closing_keyword").when(F.col("seq") % 3 == 1, "body_issue_mention").otherwise("manual")
    edges = filled(nodes.select(F.col("node_id").alias("src_id"), old.alias("extractor"), "seq"), EDGE)
    return repair.split_provenance(edges, nodes).select("seq", "extractor")


def backfilled_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third merge time and every fifth closing reason is lost and filled from payloads, some of which are gone or cut short."""
    g = derived_graph(spark, sf_dir)
    n = F.col("number")
    lost = g.artifacts.withColumns({"merged_at": F.when(n % 3 != 0, F.col("merged_at")), "state_reason": F.when(n % 5 != 0, F.col("state_reason"))})
    k = F.col("external_id").cast("long")
    nodes = g.sighted_nodes.filter("node_type in ('issue', 'pull_request')").withColumn("raw", F.when(k % 21 == 0, F.substring("raw", 1, 9)).when(k % 33 != 0, F.col("raw")))
    done = repair.backfill_from_raw(lost, nodes)
    return done.select(n.alias("k"), F.to_date("merged_at").alias("merged"), F.coalesce("state_reason", F.lit("")).alias("state_reason"))


def cursor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of each user's resources (the event types) after a run over the days before the middle, and how much of the rest is due."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.when(F.col("event_type") == "click", "issues").when(F.col("event_type") == "purchase", "commits").otherwise("releases")
    rows = events.select(F.col("user_id").cast("long").alias("repo_id"), kinds.alias("resource"), F.col("ts").alias("updated_at"))
    middle = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("middle"))
    dated = rows.crossJoin(F.broadcast(middle))  # one row
    first = dated.filter("updated_at < middle").drop("middle")
    wanted = rows.select("repo_id", "resource").distinct()
    cursors = cursor_rules.start_cursors(spark.createDataFrame([], cursor_rules.CURSOR), wanted, F.lit("2100-01-01").cast("timestamp"), 12_000)
    after = cursor_rules.advance(cursors, first, wanted.filter("repo_id % 2 = 0"))
    due = cursor_rules.due(rows, after).groupBy("repo_id", "resource").agg(F.count("*").alias("due"))
    return after.join(due, ["repo_id", "resource"], "left").select("repo_id", "resource", "phase", "backfill_cursor", "steady_watermark", F.coalesce("due", F.lit(0)).alias("due"))


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts, long and short, and the parts that a label is taken apart into."""
    k = F.col("p_partkey")
    title = F.when(k % 5 != 0, F.concat("p_name", F.lit(" "), F.repeat(F.lit("x"), (k % 60).cast("int"))))
    note = F.when(k % 3 == 0, F.lit("implemented by PR 1, NOT MERGED")).when(k % 3 == 1, F.lit("implemented by PR 2"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), text.node_label(F.lit("part"), k, title, note).alias("label"), text.short_label(F.lit("part"), k, title).alias("short"))
    parts = text.label_parts(F.col("label"))
    return rows.select("k", "label", "short", parts["head"].alias("head"), F.coalesce(parts["note"], F.lit("")).alias("note"), F.coalesce(parts["warn"], F.lit(False)).alias("warn"))


QUERIES = {
    f.__name__: f
    for f in (merged_nodes, merged_details, merged_edges, deleted_nodes, run_ledger, coauthor_lines, commit_parents, workflow_nodes, late_targets, repaired_decisions, repaired_provenance, backfilled_details, cursor_states, node_labels)
}

_ORDERS = """
WITH o AS (
  SELECT o_orderkey AS k, o_orderpriority || ' order ' || o_orderkey AS title, o_orderdate::DATE AS day, n_regionkey::BIGINT AS g,
         CASE WHEN o_orderkey % 4 = 0 THEN 'issue' ELSE 'pull_request' END AS kind
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

ORACLE_SQL = {
    "merged_nodes": _ORDERS + """
SELECT kind AS node_type, k::VARCHAR AS external_id, CASE WHEN k % 3 = 0 THEN 'First ' || k ELSE title END AS title,
       CASE WHEN k % 3 = 0 THEN 'v' || k WHEN k % 4 <> 0 THEN 'u' || k ELSE '' END AS url,
       CASE WHEN k % 2 <> 0 THEN 'old' WHEN k % 3 = 0 THEN 'new' ELSE '' END AS thread_key,
       CASE WHEN k % 3 = 0 THEN day + 1 ELSE day END AS updated, k AS seq FROM o
UNION ALL SELECT kind, 'n' || k, title, CASE WHEN k % 4 <> 0 THEN 'u' || k ELSE '' END, CASE WHEN k % 2 <> 0 THEN 'old' ELSE '' END, day, k FROM o WHERE k % 50 = 0""",
    "merged_details": _ORDERS + """
SELECT CASE WHEN k % 3 <> 0 THEN title WHEN k % 6 <> 0 THEN 'again ' || title ELSE '' END AS body, CASE WHEN k % 3 = 0 THEN k + 1000000000 ELSE k END AS seq FROM o""",
    "merged_edges": _ORDERS + """
SELECT k, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'second' ELSE 'first' END AS extractor, 'r' || k AS source_ref, day AS valid_from,
       CASE WHEN k % 5 = 0 THEN day + 1 WHEN k % 7 = 0 THEN DATE '2099-01-01' END AS valid_to, false AS created FROM o
UNION ALL SELECT k, 'second', '', DATE '2099-01-01', NULL, true FROM o WHERE k % 10 = 0""",
    "deleted_nodes": _ORDERS + """
SELECT 'nodes' AS table, k AS seq FROM o WHERE k % 11 <> 0 UNION ALL SELECT 'edges', k FROM o
WHERE NOT (k % 11 = 0) AND NOT ((k + 1) % 11 = 0 AND k + 1 IN (SELECT k FROM o))""",
    "run_ledger": """
WITH found AS (
  SELECT 'counts' AS kind, 'orders ' || o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'skips', 'returned line ' || l_linenumber, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
)
SELECT 'run-2' AS run_id, 'finished' AS status, kind, name, n, rank() OVER (PARTITION BY kind ORDER BY n DESC) AS place FROM found""",
    "coauthor_lines": """
SELECT l_orderkey AS k, l_linenumber::BIGINT AS line, 0::BIGINT AS place, 'Supplier ' || l_suppkey AS name, 's' || l_suppkey || '@example.org' AS email FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1, 'Return Desk', 'returns@example.org' FROM lineitem WHERE l_returnflag = 'R'""",
    "commit_parents": _ORDERS + """
, c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, g FROM lineitem JOIN o ON o.k = l_orderkey
), p AS (SELECT k, n, g, CASE WHEN n > 1 THEN k ELSE k - 1 END AS pk, CASE WHEN n > 1 THEN n - 1 ELSE 1 END AS pn FROM c)
SELECT 'c-' || p.k || '-' || p.n AS sha, 'c-' || pk || '-' || pn AS parent, c.k IS NOT NULL AS known FROM p LEFT JOIN c ON c.k = pk AND c.n = pn AND c.g = p.g""",
    "workflow_nodes": """
SELECT 'workflow' AS node_type, n_regionkey::BIGINT AS repo_id, p AS external_id, n_name AS title, p AS path, 'active' AS state
FROM (SELECT *, CASE WHEN n_nationkey % 3 <> 0 THEN '.github/' || lower(n_name) ELSE n_nationkey::VARCHAR END AS p FROM nation)""",
    "late_targets": _ORDERS + """
SELECT a.k, a.k + 2 AS ref_number, 'closes' AS edge_type, 'pr_body_closing_keyword' AS extractor, 2 AS attempts, b.k IS NOT NULL AS resolved, b.k IS NOT NULL AS linked
FROM o a LEFT JOIN o b ON b.k = a.k + 2 AND b.g = a.g WHERE NOT (b.k IS NOT NULL AND b.k % 2 = 1)""",
    "repaired_decisions": _ORDERS + """
SELECT k + CASE WHEN k % 20 = 1 THEN 1000000000 ELSE 0 END AS seq, 'decision' AS node_type, g AS repo_id, 'thread:' || g || ':pr-' || k AS external_id FROM o WHERE kind = 'pull_request'
UNION ALL SELECT r_regionkey + 3000000000, 'repository', -1, r_name FROM region""",
    "repaired_provenance": """
WITH rows AS (
  SELECT o_orderkey AS k, 'pr_body' AS source FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT DISTINCT l_orderkey + 1000000000, 'commit_message' FROM lineitem WHERE l_linenumber = 1
)
SELECT k AS seq, CASE k % 3 WHEN 0 THEN source || '_closing_keyword' WHEN 1 THEN source || '_issue_mention' ELSE 'manual' END AS extractor FROM rows""",
    "backfilled_details": """
WITH a AS (
  SELECT o_orderkey AS k, o_orderdate::DATE AS day, o_orderstatus AS st, o_orderkey % 4 = 0 AS is_issue, o_orderkey % 21 <> 0 AND o_orderkey % 33 <> 0 AS readable
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)
SELECT k, CASE WHEN NOT is_issue AND st = 'F' AND (k % 3 <> 0 OR readable) THEN day + 1 END AS merged,
       CASE WHEN is_issue AND st <> 'O' AND (k % 5 <> 0 OR readable) THEN 'completed' ELSE '' END AS state_reason FROM a""",
    "cursor_states": """
WITH e AS (
  SELECT user_id::BIGINT AS repo_id, CASE event_type WHEN 'click' THEN 'issues' WHEN 'purchase' THEN 'commits' ELSE 'releases' END AS resource, ts FROM events
), m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events
), c AS (
  SELECT repo_id, resource, min(ts) FILTER (ts < middle) AS oldest, max(ts) FILTER (ts < middle) AS newest FROM e, m GROUP BY ALL
), s AS (
  SELECT *, CASE WHEN resource = 'releases' THEN 'steady' WHEN resource = 'commits' AND repo_id % 2 = 0 THEN 'steady' ELSE 'backfill' END AS phase, CASE WHEN resource = 'commits' THEN oldest END AS cursor FROM c
)
SELECT s.repo_id, s.resource, phase, cursor AS backfill_cursor, newest AS steady_watermark, count_if(CASE resource
         WHEN 'issues' THEN newest IS NULL OR ts >= newest WHEN 'releases' THEN true
         ELSE CASE WHEN phase = 'backfill' THEN cursor IS NULL OR ts <= cursor ELSE newest IS NULL OR ts >= newest END END)::BIGINT AS due
FROM s JOIN e USING (repo_id, resource) GROUP BY ALL""",
    "node_labels": """
WITH p AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN trim(p_name || ' ' || repeat('x', (p_partkey % 60)::INT)) ELSE '' END AS title,
         CASE p_partkey % 3 WHEN 0 THEN 'implemented by PR 1, NOT MERGED' WHEN 1 THEN 'implemented by PR 2' ELSE '' END AS note FROM part
), h AS (SELECT *, 'part:' || k || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END AS head FROM p)
SELECT k, head || CASE WHEN note <> '' THEN '  [' || note || ']' ELSE '' END AS label,
       'part:' || k || CASE WHEN title = '' THEN '' WHEN length(title) > 58 THEN ' "' || substr(title, 1, 55) || '..."' ELSE ' "' || title || '"' END AS short,
       head, note, k % 3 = 0 AS warn FROM h""",
}
