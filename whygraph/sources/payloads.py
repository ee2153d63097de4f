"""Landed payload tables of a code forge, and their projection to nodes, details and edges.

Every payload table has `repo_id` (the repository's number), `repo` (owner/name) and `seq` (the order in
which it was landed). Projections give NODE and sighting rows; ids are hashes of identities, so a
projection needs no join to name the nodes that it links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import text
from ..schema import node_id

PERSON = "struct<login:string,node_id:string,html_url:string>"
LANDED = "repo_id long, repo string, seq long"
REPOSITORY = f"{LANDED}, node_id string, full_name string, html_url string, default_branch string, visibility string, created_at string, updated_at string"
ARTIFACT = f"{LANDED}, number long, node_id string, title string, html_url string, body string, state string, state_reason string, created_at string, updated_at string, closed_at string, user {PERSON}, pull_request struct<merged_at:string>"
REVIEWS = f"{LANDED}, number long, reviews array<struct<id:long,state:string,submitted_at:string,user:{PERSON}>>"
COMMIT_FIELDS = f"sha:string,node_id:string,html_url:string,commit:struct<message:string,author:struct<date:string>,committer:struct<date:string>>,author:{PERSON},parents:array<struct<sha:string>>"
COMMITS = f"{LANDED}, number long, commits array<struct<{COMMIT_FIELDS}>>"
RELEASE = f"{LANDED}, id long, tag_name string, name string, body string, node_id string, html_url string, prerelease boolean, created_at string, published_at string"
WORKFLOWS = f"{LANDED}, total_count long, workflows array<struct<id:long,path:string,name:string,state:string,node_id:string,html_url:string,created_at:string,updated_at:string>>"
OWNERS = f"{LANDED}, path string, sha string, content string"

#: Where an ownership file may stand, the first one found counting.
OWNERS_PATHS = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def read_landed(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Landed JSON pages, one object a line, with a fixed schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a query-set file: one JSON document with a list `queries`."""
    fields = "id:string,category:string,mode:string,query:string,depth:int,as_of:string,intent:string,verify:string,contract:string"
    rows = spark.read.option("multiLine", True).schema(f"queries array<struct<{fields}>>").json(path)
    return rows.select(F.inline("queries"))


def unwrapped(pages: DataFrame, items: str) -> DataFrame:
    """The items of envelope pages, as rows with the landed columns."""
    return pages.select("repo_id", "repo", "seq", F.inline(items))


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def nodes_of(rows: DataFrame, node_type: Column, repo_id: Column, external_id: Column, *, forge_id=None, title=None, url=None, key=None, created=None, updated=None, raw=None) -> DataFrame:
    some = lambda c, kind="string": null(kind) if c is None else c.cast(kind)
    return rows.select(
        node_id(node_type, repo_id, external_id).alias("node_id"), node_type.alias("node_type"), repo_id.cast("long").alias("repo_id"), external_id.cast("string").alias("external_id"),
        some(forge_id).alias("forge_id"), some(title).alias("title"), some(url).alias("url"), some(key).alias("thread_key"), some(created, "timestamp").alias("source_created_at"),
        some(updated, "timestamp").alias("source_updated_at"), some(raw).alias("raw"), F.col("seq"),
    )


def sightings(rows: DataFrame, src: Column, dst: Column, edge_type: str, extractor, *, source_ref=None, observed=None) -> DataFrame:
    """Edges as sighted, to be merged by `upsert_edges`."""
    extractor = F.lit(extractor) if isinstance(extractor, str) else extractor
    return rows.select(
        src.alias("src_id"), dst.alias("dst_id"), F.lit(edge_type).alias("edge_type"), extractor.alias("extractor"),
        (null() if source_ref is None else source_ref.cast("string")).alias("source_ref"), (null("timestamp") if observed is None else observed).alias("observed_at"), F.col("seq"),
    )


def person_id(login: Column) -> Column:
    return node_id(F.lit("person"), null("long"), login)


def artifact_type() -> Column:
    return F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue")


def artifact_id() -> Column:
    return node_id(artifact_type(), F.col("repo_id"), F.col("number").cast("string"))


def people(rows: DataFrame, person: str) -> DataFrame:
    """Person nodes of a struct column; people belong to no repository; those without a login are passed over."""
    who = F.col(person)
    some = rows.filter(F.length(who["login"]) > 0)
    return nodes_of(some, F.lit("person"), null("long"), who["login"], forge_id=who["node_id"], title=who["login"], url=who["html_url"])


def repositories(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, details); a repository's own node belongs to no repository."""
    nodes = nodes_of(rows, F.lit("repository"), null("long"), F.col("repo"), forge_id=F.col("node_id"), title=F.col("full_name"), url=F.col("html_url"), created=text.timestamp(F.col("created_at")), updated=text.timestamp(F.col("updated_at")))
    owner, name = F.split_part("repo", F.lit("/"), F.lit(1)), F.split_part("repo", F.lit("/"), F.lit(2))
    details = rows.select(node_id(F.lit("repository"), null("long"), F.col("repo")).alias("node_id"), "repo_id", owner.alias("owner"), name.alias("name"), "default_branch", "visibility", "seq")
    return nodes, details


def artifacts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, details, created edges) of the feed of issues and pull requests, told apart by `pull_request`."""
    kind, number = artifact_type(), F.col("number").cast("string")
    nodes = nodes_of(
        rows, kind, F.col("repo_id"), number, forge_id=F.col("node_id"), title=F.col("title"), url=F.col("html_url"), key=text.thread_key(F.col("repo_id"), kind, F.col("number")),
        created=text.timestamp(F.col("created_at")), updated=text.timestamp(F.col("updated_at")), raw=F.to_json(F.struct("state_reason", "body", "pull_request")),
    )
    details = rows.select(
        artifact_id().alias("node_id"), kind.alias("node_type"), "repo_id", "repo", "number", F.coalesce(text.present(F.col("state")), F.lit("unknown")).alias("state"), F.coalesce("body", F.lit("")).alias("body"),
        text.timestamp(F.col("closed_at")).alias("closed_at"), text.timestamp(F.col("pull_request.merged_at")).alias("merged_at"), F.when(F.col("pull_request").isNull(), F.col("state_reason")).alias("state_reason"),
        "html_url", text.timestamp(F.col("updated_at")).alias("updated_at"), "seq",
    )
    some = rows.filter(F.length("user.login") > 0)
    created = sightings(some, person_id(F.col("user.login")), artifact_id(), "created", "issue_author", source_ref=F.col("html_url"), observed=text.timestamp(F.col("created_at")))
    return nodes, details, created


def review_rows(rows: DataFrame) -> DataFrame:
    """A row for each review of pull requests' lists."""
    return rows.select("repo_id", "seq", "number", F.explode("reviews").alias("review")).select("repo_id", "seq", "number", "review.*")


def reviews(rows: DataFrame, each: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(people, reviewed edges) of lists, or of `each` review of them: a review in any state counts."""
    each = (review_rows(rows) if each is None else each).filter(F.length("user.login") > 0)
    pull = node_id(F.lit("pull_request"), F.col("repo_id"), F.col("number").cast("string"))
    ref = F.concat(F.lit("review:"), F.coalesce(F.col("id").cast("string"), F.lit("None")), F.lit(":"), F.coalesce("state", F.lit("None")))
    return people(each, "user"), sightings(each, person_id(F.col("user.login")), pull, "reviewed", "pr_review", source_ref=ref, observed=text.timestamp(F.col("submitted_at")))


def commit_rows(rows: DataFrame) -> DataFrame:
    """A row for each commit of pull requests' commit lists (`number` null for commits outside of one)."""
    each = rows.select("repo_id", "repo", "seq", "number", F.explode("commits").alias("one")).select("repo_id", "repo", "seq", "number", "one.*")
    return each.withColumn("message", F.coalesce("commit.message", F.lit(""))).withColumn("authored_at", text.timestamp(F.col("commit.author.date"))).withColumn("committed_at", text.timestamp(F.col("commit.committer.date")))


def commit_id(sha: str = "sha") -> Column:
    return node_id(F.lit("commit"), F.col("repo_id"), F.col(sha))


def commits(each: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, details, edges) of `commit_rows`: created by the author, implemented by a pull request."""
    title = F.substring(F.split_part("message", F.lit("\n"), F.lit(1)), 1, 200)
    nodes = nodes_of(each, F.lit("commit"), F.col("repo_id"), F.col("sha"), forge_id=F.col("node_id"), title=title, url=F.col("html_url"), created=F.col("authored_at"), updated=F.col("committed_at"))
    details = each.select(commit_id().alias("node_id"), "repo_id", "repo", "sha", "message", "authored_at", "committed_at", "seq")
    created = sightings(each.filter(F.length("author.login") > 0), person_id(F.col("author.login")), commit_id(), "created", "commit_author", source_ref=F.col("sha"), observed=F.col("authored_at"))
    pull = node_id(F.lit("pull_request"), F.col("repo_id"), F.col("number").cast("string"))
    listed = sightings(each.filter("number is not null"), pull, commit_id(), "implements", "pr_commit_list", source_ref=F.col("sha"))
    return nodes, details, created.unionByName(listed)


def parents(each: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depends_on edges to parents among the `known` nodes, parents that are not among them)."""
    pairs = each.select("repo_id", "sha", "committed_at", "seq", F.explode("parents.sha").alias("parent"))
    joined = durable(pairs.withColumn("parent_id", commit_id("parent")))
    ids = known.filter("node_type = 'commit'").select(F.col("node_id").alias("parent_id")).join(joined.select("parent_id").distinct(), "parent_id", "left_semi")
    edges = sightings(joined.join(ids, "parent_id", "left_semi"), commit_id(), F.col("parent_id"), "depends_on", "commit_parent", source_ref=F.col("parent"), observed=F.col("committed_at"))
    return edges, joined.join(ids, "parent_id", "left_anti").select("repo_id", "sha", "parent")


def release_tag() -> Column:
    return F.coalesce(text.present(F.col("tag_name")), F.col("id").cast("string"))


def releases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, details) of releases."""
    published = text.timestamp(F.col("published_at"))
    nodes = nodes_of(rows, F.lit("release"), F.col("repo_id"), release_tag(), forge_id=F.col("node_id"), title=F.coalesce(text.present(F.col("name")), release_tag()), url=F.col("html_url"), created=text.timestamp(F.col("created_at")), updated=published)
    details = rows.select(node_id(F.lit("release"), F.col("repo_id"), release_tag()).alias("node_id"), "repo_id", "repo", release_tag().alias("tag"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("prerelease", F.lit(False)).alias("is_prerelease"), published.alias("published_at"), "seq")
    return nodes, details


def workflows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, details) of unwrapped workflow rows."""
    path = F.coalesce(text.present(F.col("path")), F.col("id").cast("string"))
    nodes = nodes_of(rows, F.lit("workflow"), F.col("repo_id"), path, forge_id=F.col("node_id"), title=F.col("name"), url=F.col("html_url"), created=text.timestamp(F.col("created_at")), updated=text.timestamp(F.col("updated_at")))
    return nodes, rows.select(node_id(F.lit("workflow"), F.col("repo_id"), path).alias("node_id"), path.alias("path"), "name", "state", "seq")


def owners(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, rules, owns edges) of ownership files: of each repository, the first of OWNERS_PATHS that it has.

    An owner with a slash is a team, named by what stands before and after the first slash; others are people.
    """
    place = F.array_position(F.array(*map(F.lit, OWNERS_PATHS)), F.col("path"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(place, F.desc("seq")))
    chosen = files.filter(place > 0).withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
    plain = chosen.withColumn("plain", F.make_valid_utf8(F.unbase64(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s", "")).cast("string")))
    rules = text.owner_rules(plain.select("repo_id", "path", "sha", "seq", "plain"), "plain")
    name = F.concat("path", F.lit(":"), F.col("line_number").cast("string"))
    scope = node_id(F.lit("codeowners_scope"), F.col("repo_id"), name)
    scopes = nodes_of(rules, F.lit("codeowners_scope"), F.col("repo_id"), name, title=F.col("pattern"))
    each = rules.select("repo_id", "path", "line_number", "seq", F.explode("owners").alias("owner")).filter(F.length("owner") > 0)
    kind = F.when(F.col("owner").contains("/"), "team").otherwise("person")
    holders = nodes_of(each, kind, null("long"), F.col("owner"), title=F.col("owner"))
    edges = sightings(each, node_id(kind, null("long"), F.col("owner")), scope, "owns", "codeowners_parse", source_ref=name)
    details = rules.select(scope.alias("node_id"), F.col("pattern").alias("path_pattern"), F.col("path").alias("source_path"), F.col("sha").alias("source_sha"), "line_number", "seq")
    return scopes.unionByName(holders), details, edges


def teams(nodes: DataFrame) -> DataFrame:
    """Team details of team nodes: organisation, and all that follows the first slash."""
    cut = F.split("external_id", "/", 2)
    return nodes.filter("node_type = 'team'").select("node_id", cut[0].alias("org"), cut[1].alias("slug"), "seq")
