"""The fixed, versioned schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# The vocabularies of the event model.
HARNESSES = ("claude", "codex", "opencode", "cursor", "cursor-cli", "grok", "grokbot", "native")
ACTORS = ("user", "assistant", "system", "tool", "harness")
EVENT_TYPES = ("message", "tool_call", "tool_result", "usage", "compaction", "meta", "error", "unknown", "unreadable")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()

EVENT = _struct(
    ("schema_version", I), ("event_id", S), ("session_id", S), ("parent_session_id", S), ("harness", S), ("harness_version", S),
    ("recorded_at", S), ("ingested_at", S), ("cwd_hash", S), ("project_id", S),
    ("git", _struct(("branch", S), ("commit", S), ("dirty", B))),
    ("actor", S), ("event_type", S), ("role", S), ("model", _struct(("provider", S), ("id", S))),
    ("content_text", S), ("content_ref", S), ("tool", _struct(("name", S), ("call_id", S), ("is_error", B))),
    ("usage", _struct(("input", L), ("output", L), ("cache_read", L), ("cache_write", L), ("cost_usd", D))),
    ("raw_type", S), ("redaction", _struct(("status", S), ("ruleset", S))), ("extra", S),
)

#: A search document: an event's typed columns with its text, addressed by (session_uid, pos).
DOCS = _struct(
    ("session_uid", S), ("pos", L), ("sig", S), ("harness", S), ("project_id", S), ("event_type", S), ("actor", S), ("tool_name", S), ("tool_error", B),
    ("raw_type", S), ("recorded_ns", L), ("content_bytes", L), ("call_id", S), ("model_id", S), ("input_tokens", L), ("output_tokens", L),
    ("cache_read_tokens", L), ("cache_write_tokens", L), ("content", S),
)

STATS = _struct(("session_uid", S), ("harness", S), ("hour", L), ("kind", S), ("name", S), ("n", L), ("input", L), ("output", L), ("cache_read", L), ("cache_write", L))
