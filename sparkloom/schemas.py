"""Record schemas: raw and parsed logs, graph tables."""
from pyspark.sql import types as T

RAW_LOG = T.StructType().add("id", "string").add("source_collection", "string").add("line", "string").add("metadata", T.MapType(T.StringType(), T.StringType()))

PARAM = (
    T.StructType().add("char_start", "integer").add("char_end", "integer").add("token_start", "integer").add("token_end", "integer").add("entity", "string").add("value", "string")
    .add("prev_token", "string").add("next_token", "string")
)

PARSED_LOG = (
    T.StructType().add("log_id", "string").add("line", "string").add("message", "string").add("log_key", "string").add("event_ord", "integer").add("event_id", "string")
    .add("id", "string").add("source_collection", "string").add("metadata", T.MapType(T.StringType(), T.StringType())).add("params", T.ArrayType(PARAM))
)

VERTEX = T.StructType().add("collection", "string").add("key", "string").add("name", "string").add("props", T.MapType(T.StringType(), T.StringType()))
EDGE = T.StructType().add("collection", "string").add("key", "string").add("src", "string").add("dst", "string").add("name", "string")

#: The entity of a parameter, its vertex collection and its edge collection from a log.
ENTITY_COLLECTIONS = {
    "ip_address": ("ip_addrs", "has_ip_addr"),
    "file": ("filenames", "has_filename"),
    "uri": ("uris", "has_uri"),
    "url": ("urls", "has_url"),
    "email": ("emails", "has_email"),
    "device": ("devices", "has_device"),
    "process": ("procs", "has_proc"),
    "memory_address": ("mem_addrs", "has_mem_addr"),
    "uuid": ("uuids", "has_uuid"),
    "user": ("users", "has_user"),
    "PERSON": ("people", "has_person"),
    "ORG": ("organizations", "has_organization"),
    "GPE": ("locations", "has_location"),
    "LOC": ("locations", "has_location"),
}
VERTEX_COLLECTIONS = ("collections", "logs", "log_keys", *dict.fromkeys(v for v, _ in ENTITY_COLLECTIONS.values()))
EDGE_COLLECTIONS = ("has_log", "has_log_key", *dict.fromkeys(e for _, e in ENTITY_COLLECTIONS.values()))
