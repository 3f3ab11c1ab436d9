"""Schemas of the tables that the sources give and the operators take; none is ever inferred."""

INVENTORY = "filename string, extension string, size_bytes bigint, relative_path string, sha256 string"
ARCHIVE_INVENTORY = "archive string, member_path string, extension string, size_bytes bigint, year_hint string, sha256 string"
CANDIDATE = "sha256 string, source_type string, filename string, extension string, size_bytes bigint, source_path string"
UNIFIED = "sha256 string, canonical_source_type string, canonical_filename string, canonical_extension string, canonical_path string, size_bytes bigint, source_count bigint, all_sources string"

IMAGES = "array<struct<relationship_id: string, target: string>>"
PARAGRAPH = f"struct<type: string, text: string, style: string, images: {IMAGES}>"
BLOCK = f"struct<type: string, text: string, style: string, images: {IMAGES}, rows: array<struct<cells: array<struct<text: string, paragraphs: array<{PARAGRAPH}>>>>>>"
SOURCE = "struct<source_type: string, canonical_path: string, canonical_filename: string, extension: string>"
DOCUMENT = (
    f"document_id string, sha256 string, document_type string, source {SOURCE}, blocks array<{BLOCK}>, "
    "headers_footers struct<headers: map<string, array<string>>, footers: map<string, array<string>>>, "
    "media array<struct<path: string, size_bytes: bigint>>, "
    "statistics struct<paragraphs: int, tables: int, media_files: int, paragraphs_with_images: int, tables_anywhere: int>, "
    "metadata_hints struct<years_from_path: array<string>>"
)

QUESTION_METADATA = "struct<year: int, contest: int, round: string, subject: string>"
QUESTION_SOURCE = "struct<document_id: string, start_block: int, end_block: int>"
QUESTION = (
    f"question_id string, competition string, question_type string, metadata {QUESTION_METADATA}, prompt string, question_text string, "
    f"answer string, solution string, images {IMAGES}, source {QUESTION_SOURCE}"
)
SAMPLE_QUESTION = "id string, competition string, year int, stage string, round string, subject string, topic string, subtopic string, question_type string, difficulty int, question string, answer string, tags array<string>"
QUIZ_RESULT = "question string, topic string, difficulty int, student_answer string, correct_answer string, correct boolean"
LINE = f"document_id string, block int, text string, images {IMAGES}"
