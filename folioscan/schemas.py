"""Schemas of the relations, as DDL. Every relation carries its own ordinal, since rows have no order."""

TEX_DOCS = "doc_path string, source string"
SOURCE_LINES = "doc_path string, combined_line int, text string, origin_file string, origin_line int"
PARAGRAPHS = "doc_path string, para_idx int, text string, start_line int, end_line int, file string"
SECTIONS = "doc_path string, sec_idx int, title string, text string, start_line int, end_line int, file string"
CITATIONS = "doc_path string, cite_idx int, key string, line int"
BIB_ENTRIES = "doc_path string, bib_idx int, key string, entry_type string, file string, line int, title string, author string, eprint string, doi string"
FLOATS = "doc_path string, float_idx int, env_type string, content string, start_line int, end_line int, caption string, labels array<string>"
PAPERS = "title string, authors array<string>, year int, abstract string, url string"
VERIFICATIONS = "key string, exists boolean, detail string"
REQUESTS = "request_id string, system string, user string"
REPLIES = "request_id string, raw string"
FINDINGS = "doc_path string, seq bigint, checker string, severity string, line int, message string, suggestion string, excerpt string, file string"
SEVERITIES = ("info", "warning", "error")
