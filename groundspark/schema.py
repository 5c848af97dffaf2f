"""Schemas of the engine's tables."""

SOURCES = "url string, scheme string, doc_type string, notes string"
MANIFEST = (
    "url string, scheme string, doc_type string, kind string, http_status int, bytes_downloaded long, text_chars int, pages int, "
    "fetch_seconds double, fetched_at string, raw_file string, status string, error string"
)
BLOCKS = "doc_id string, kind string, block_pos int, block string"
CHUNKS = "chunk_id string, scheme string, doc_type string, source_url string, page_title string, section string, fetched_at string, text string"
MESSAGES = "conv_id long, turn long, role string, text string"
CACHE = "key string, text string, model string"
