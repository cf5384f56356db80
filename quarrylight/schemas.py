"""Tables of the code index."""

FILES = "path string, language string, system string, purpose string, exports array<string>, imports array<string>, used_by array<string>, used_by_count long, summary string, danger string, last_change string, semantic_hash string, content_hash string, confidence double, is_stale boolean, updated_at timestamp, indexed_at timestamp, mtime double, file_size long, error string"
FUNCTIONS = "id string, file string, class_name string, name string, signature string, summary string, summary_long string, mutates array<string>, danger string, line_start int, line_end int, semantic_hash string, is_tainted boolean, taint_source string, confidence double, is_stale boolean, updated_at timestamp"
CALL_GRAPH = "caller_id string, pos int, callee_id string, callee_name string, callee_file string, is_ambiguous boolean, candidates array<string>"
#: What extraction found, kept so that resolution needs no second parse.
EXTRACTED = "path string, language string, exports array<string>, imports_raw array<struct<module:string,names:array<string>,level:int,alias:string>>, supers array<struct<class_name:string,super:string>>, calls array<struct<id:string,class_name:string,name:string,calls:array<struct<name:string,object:string>>>>"
DANGERS = "id string, scope string, description string, reason string, added_by string, created_at timestamp"
DECISIONS = "id string, scope string, decision string, alternatives string, reason string, added_by string, created_at timestamp"
CHANGES = "file string, commit_hash string, summary string, author string, timestamp timestamp"
TAINT_QUEUE = "function_id string, taint_source string, queued_at timestamp, priority long"
SESSIONS = "id string, entry string, files_touched string, timestamp timestamp"
#: The columns of files that the full-text index holds.
SEARCHED = ["path", "purpose", "summary"]
DIRECTORIES = "path string, system string, summary string, file_count long, updated_at timestamp"

TABLES = {
    "files": FILES,
    "functions": FUNCTIONS,
    "call_graph": CALL_GRAPH,
    "extracted": EXTRACTED,
    "dangers": DANGERS,
    "decisions": DECISIONS,
    "changes": CHANGES,
    "taint_queue": TAINT_QUEUE,
    "session_log": SESSIONS,
    "directories": DIRECTORIES,
}
#: What tells the rows of a table apart.
KEYS = {
    "files": ["path"],
    "functions": ["id"],
    "call_graph": ["caller_id", "pos"],
    "extracted": ["path"],
    "dangers": ["id"],
    "decisions": ["id"],
    "changes": ["file", "commit_hash"],
    "taint_queue": ["function_id"],
    "session_log": ["id"],
    "directories": ["path"],
}
VERSION = 3
