"""Fixed values that results depend on, in one place."""

from __future__ import annotations

# Chunking: size and overlap in characters, and pieces a section is cut into.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
SECTION_PLAN = (("introduction", 2, 3), ("method", 3, 5), ("results", 2, 4))
SMALLEST_RESPLIT = 128

# Embedding and retrieval.
EMBED_BATCH = 100
TOP_K, CANDIDATES, VECTOR_CHUNKS = 5, 40, 15
CONTEXT_PATHS = 12

# Fusion.
RRF_K = 60
GRAPH_WEIGHT = VECTOR_WEIGHT = 0.5

# Name and title matching.
NAME_MATCH = 0.85
CONFIDENCE_MIN, TITLE_MIN, INSTITUTION_MIN = 0.7, 0.75, 0.85
HOMONYM_MIN, HOMONYM_GAP = 0.9, 0.05
SAME_PAPER_FLOOR, TITLE_FLOOR, JOINT_FLOOR, INSTITUTION_BONUS = 0.92, 0.80, 0.85, 0.05

# Points of each graph signal.
AUTHOR_POINTS, CRITICISES_POINTS, PROPOSES_POINTS = 100, 50, 40
TOPIC_METHOD_POINTS, TOPIC_TITLE_POINTS, YEAR_POINTS = 20, 10, 5

# Relations of the graph, as stored in its edges.
WROTE, WORKS_AT, PROPOSES, CRITICISES, PUBLISHED = "YAZDI", "ÇALIŞIYOR", "ÖNERİYOR", "ELEŞTİRİYOR", "YAYINLANDI"

# Evaluation.
RECALL_KS = (5, 10)
STAGE_HITS = 10
STAGES = ("naive", "grobid", "metadata", "graph", "hybrid")

# Sections that a filter may name.
FILTER_SECTIONS = ("abstract", "introduction", "method", "results")

# Dollars for a million tokens, in and out.
CHAT_MODEL, EMBED_MODEL = "gpt-4o-mini", "text-embedding-3-small"
PRICES = {CHAT_MODEL: (0.15, 0.60), EMBED_MODEL: (0.02, 0.0)}

ABSTAIN = "Bu bilgi verilen makalelerde yok."
EMPTY_CATALOG = "(boş)"
NO_HEADING = "(başlıksız)"
