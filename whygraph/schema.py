"""Vocabularies, constants and table schemas of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed vocabularies, in the order in which they sort.
NODE_TYPES = ("repository", "commit", "pull_request", "branch", "issue", "release", "person", "team", "codeowners_scope", "workflow", "wiki_page", "decision")
EDGE_TYPES = (
    "references", "created", "reviewed", "owns", "depends_on", "discussed_in", "implements", "closes", "deployed_by", "supersedes",
    "mentions", "relates_to", "motivated_by", "implemented_by", "superseded_by",
)
TAGS = ("explicit", "inferred")
TIERS = ("explicit", "corroborated", "inferred")
STATUSES = ("explicit", "reconstructed")
WHY_EDGES = ("motivated_by", "implemented_by", "implements", "discussed_in", "references", "supersedes", "superseded_by")
IMPACT_EDGES = ("depends_on", "implements", "closes", "deployed_by", "implemented_by")
CORROBORATED_EDGES = ("closes", "implements", "reviewed", "motivated_by", "implemented_by", "deployed_by")
#: What synthesis asserts of a decision.
RUBRIC_EDGES = ("motivated_by", "implemented_by")
PERSON_EDGES = ("created", "reviewed", "owns")

#: Least relevance of an inferred edge, and most current ones at a node.
LEAST_RELEVANCE, INFERRED_CAP = 0.75, 4
#: Scores of the retrieval tiers, least trigram similarity, candidates of a question.
SCORES = {"exact": 1.0, "identifier": 0.95, "prefix": 0.75}
FUZZY_FLOOR, CANDIDATES = 0.25, 10
MAX_DEPTH = 3
CORROBORATING = 3

NODE = "node_id long, node_type string, repo_id long, external_id string, forge_id string, title string, url string, thread_key string, source_created_at timestamp, source_updated_at timestamp, raw string, seq long"
EDGE = "edge_id long, src_id long, dst_id long, edge_type string, tag string, tier string, extractor string, source_ref string, relevance decimal(5,4), observed_at timestamp, valid_from timestamp, valid_to timestamp, seq long"
DECISION = "node_id long, status string, summary string, decided_at timestamp, source_artifact_id long"
PENDING = "repo_id long, src_id long, ref_number long, edge_type string, extractor string, source_ref string, observed_at timestamp, attempts int, last_attempt_at timestamp, resolved_at timestamp, resolved_edge_id long, seq long"


def node_id(node_type: Column, repo_id: Column, external_id: Column) -> Column:
    """The id of a node: a hash of its identity (type, repository or 0, external id)."""
    return F.xxhash64(node_type, F.coalesce(repo_id.cast("long"), F.lit(0).cast("long")), external_id)


def edge_id(src: Column, dst: Column, edge_type: Column, valid_from: Column) -> Column:
    return F.xxhash64(src, dst, edge_type, valid_from)


def ordinal(value: Column, vocabulary: tuple[str, ...]) -> Column:
    """The place of a value in its vocabulary, from 1; 0 if it is not in it."""
    return F.array_position(F.array(*map(F.lit, vocabulary)), value)
