"""Type catalogs and weights. All are fixed values of the data model."""

from __future__ import annotations

# Fixed values.
OBSERVED_ENTITY_TYPES = ["SERVICE", "MODULE", "FUNCTION", "API_ENDPOINT", "DATABASE_TABLE", "TEAM", "SCHEMA", "CLASS"]
# Fixed values.
OBSERVED_RELATIONSHIP_TYPES = ["DEPENDS_ON", "CALLS", "IMPORTS", "OWNS", "EXPOSES", "RUNTIME_CALLS", "READS_FROM", "WRITES_TO",
    "CHANGE_COUPLED_WITH", "AUTHORED_BY", "DEPLOYED_TO"]
# Fixed values.
STORED_ENTITY_TYPES = [
    "SERVICE", "DEPLOYMENT", "INFRASTRUCTURE_RESOURCE", "CONTAINER", "REPOSITORY", "MODULE", "FILE", "FUNCTION", "CLASS", "API_ENDPOINT", "EVENT_TOPIC",
    "DATABASE_TABLE", "DATABASE_SCHEMA", "TEAM", "DEVELOPER", "ORGANIZATION", "COMMIT", "PULL_REQUEST", "DEPLOYMENT_EVENT", "INCIDENT", "EXTERNAL_LIBRARY", "EXTERNAL_SERVICE",
]
# Fixed values.
STORED_RELATIONSHIP_TYPES = [
    "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "EXPOSES", "RUNTIME_CALLS", "PRODUCES", "CONSUMES", "READS_FROM", "WRITES_TO", "DEPENDS_ON", "TRANSITIVELY_DEPENDS_ON",
    "USES_LIBRARY", "CALLS_EXTERNAL", "OWNS", "CONTRIBUTED_TO", "REVIEWS", "ON_CALL_FOR", "DEPLOYED_ON", "DEPLOYED_IN", "RUNS_IN", "CHANGE_COUPLED_WITH",
    "DEPLOYMENT_COUPLED_WITH", "DATA_COUPLED_WITH", "FAILURE_CORRELATED_WITH", "INTRODUCED_IN", "MODIFIED_IN", "DEPRECATED_BY", "REPLACED_BY",
]
# Question words by archetype, in order of precedence, with confidences.
QUESTION_WORDS = [
    ("GOVERNANCE", 0.9, ["circular", "cycle", "supernode", "hub-and-spoke", "smell", "audit", "health"]),
    ("IMPACT", 0.9, ["blast radius", "what breaks", "what would break", "impact of", "if i delete", "if we delete", "if i remove"]),
    ("TEMPORAL", 0.8, ["change", "evolution", "history", "diff", "between commit", "since ", "last month", "last week", "past month", "yesterday", " ago"]),
    ("RUNTIME", 0.8, ["latency", "slow", "slowest", "p99", "p50", "error rate", "throughput"]),
]
# Older names and the names they are stored under.
RENAMED_TYPES = {"SCHEMA": "DATABASE_SCHEMA", "AUTHORED_BY": "CONTRIBUTED_TO", "DEPLOYED_TO": "DEPLOYED_ON"}
# How much of an impact an edge passes on.
IMPACT_DECAY = {"IMPORTS": 0.95, "RUNTIME_CALLS": 0.80, "DATA_COUPLED_WITH": 0.70, "DEPENDS_ON": 0.50}
IMPACT_DECAY_OTHER, IMPACT_FLOOR = 0.40, 0.10
# How relevant a neighbour is.
RELEVANCE_WEIGHT = {"EXPOSES": 1.0, "RUNTIME_CALLS": 0.9, "IMPORTS": 0.7, "OWNS": 0.6, "DEPENDS_ON": 0.5, "CHANGE_COUPLED_WITH": 0.4,
    "CALLS": 0.2}
RELEVANCE_OTHER, RELEVANCE_FLOOR, RELEVANCE_NODES = 0.3, 0.15, 200
MAX_DEPTH = 5
