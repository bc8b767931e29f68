"""Column expressions. Every function returns a ``Column`` and runs inside the JVM."""

from corpuskit.functions.html import collapse_newlines, decode_entities, html_links, html_text, html_title, strip_text
from corpuskit.functions.ids import chunk_id, file_doc_id, mail_doc_id, mail_fallback_id, page_label, web_doc_id
from corpuskit.functions.text import (canonical_collection, clip_snippet, default_score, render_mail_text,
                                      render_web_text, scalar_metadata, size_gb, source_kind, source_label,
                                      url_slug)
from corpuskit.functions.tokens import chunk_tokens, terms, with_hash_vector

__all__ = [
    "collapse_newlines", "decode_entities", "html_links", "html_text", "html_title", "strip_text",
    "chunk_id", "file_doc_id", "mail_doc_id", "mail_fallback_id", "page_label", "web_doc_id",
    "canonical_collection", "clip_snippet", "default_score", "render_mail_text", "render_web_text",
    "scalar_metadata", "size_gb", "source_kind", "source_label", "url_slug",
    "chunk_tokens", "terms", "with_hash_vector",
]
