"""Explicit types of the domain tables and of the JSON they hold; nothing is inferred from data."""

PAYLOAD = (
    "question string, options array<string>, correct_option_index int, answer string, accepted_answers array<string>, "
    "left_items array<string>, right_items array<string>, pairs map<string, string>, source_revision string"
)
SCOPE = "scope_type string, sub_units array<string>"
QUESTIONS = (
    "question_id string, class string, subject string, chapter string, topic string, difficulty string, type string, text string, "
    "payload string, source_chunk_id string, text_hash string, embedding array<float>, concept_cluster_id string, "
    "explanation string, created_at timestamp, batch_no int"
)
CHUNKS = (
    "chunk_id string, class string, subject string, source_file string, chapter string, chapter_number int, topic string, "
    "topic_number string, chunk_index int, text string, has_table boolean, figure_dependent_spans array<string>, "
    "images array<struct<image_file: string, caption: string>>"
)
ATTEMPTS = (
    "attempt_id string, user_id string, class string, subject string, scope string, difficulty string, score_correct int, "
    "score_total int, created_at timestamp"
)
ANSWERS = "attempt_id string, question_id string, user_answer string, is_correct boolean"
CORPUS = "id string, class string, subject string, chapter string, topic string, question string, answer string, source string"
GLYPHS = "doc string, page int, block int, pos int, c string, x0 double, y0 double, x1 double, y1 double, size double"
LINES = "doc string, page int, line_no int, block int, text string, size double, x0 double, y0 double, x1 double, y1 double"
COUNTER_KEY = ("user_id", "class", "subject", "chapter", "topic", "question_type")
