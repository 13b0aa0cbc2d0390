"""Row types of the relations that conversion gives."""

from __future__ import annotations

IMAGE = "page_number: INT, name: STRING, width: BIGINT, height: BIGINT, components: INT, data: BINARY, format: STRING, embedded_text: STRING"
PAGE = (
    "page_ordinal INT, page_number INT, text STRING, page_width DOUBLE, page_height DOUBLE, body_font_size DOUBLE, "
    f"tables ARRAY<ARRAY<ARRAY<STRING>>>, images ARRAY<STRUCT<{IMAGE}>>, degraded_images INT, error STRING"
)
MEMBER = "member_path STRING, format STRING, markdown STRING, error STRING, error_code STRING, uncompressed_size BIGINT"
ENTRY = "member_path STRING, format STRING, content BINARY, error STRING, error_code STRING, uncompressed_size BIGINT"
CELL = "page_ordinal INT, table_no INT, row_no INT, column_no INT, value STRING"
MIME_PART = "path STRING, content_type STRING, charset STRING, filename STRING, disposition STRING, size BIGINT, body STRING"
