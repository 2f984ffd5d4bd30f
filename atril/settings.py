"""Default parameters of the operators, in one place."""

# The observable defaults every operator must agree on.
CHUNK_SIZE_TOKENS = 512
CHUNK_OVERLAP_TOKENS = 77
CHARS_PER_TOKEN = 4
TOP_K = 10
CANDIDATE_MULTIPLIER = 3
SCORE_THRESHOLD = 0.35
WEIGHT_SEMANTIC = 0.80
WEIGHT_KEYWORD = 0.20
NEAR_DUP_JACCARD = 0.70
NEAR_DUP_HEAD_CHARS = 300
MAX_CHUNKS_PER_TITLE = 10
TEXT_CONFIG = "spanish"
AMBIGUITY_MARGIN = 0.15
ENTITY_OVERLAP = 0.5
CACHE_THRESHOLD = 0.90
CACHE_TTL_SECONDS = 2_592_000
CACHE_CAPACITY = 1000
RETRIEVAL_TTL_SECONDS = 1800
HISTORY_TURNS = 10
HISTORY_CHARS = 600
GRADING_CONTEXT_CHARS = CHUNK_SIZE_TOKENS * CHARS_PER_TOKEN * TOP_K
MAX_MESSAGE_CHARS = 4000
MAX_TITLE_CHARS = 100
TOKEN_BUDGET = 27_000
TOKEN_WINDOW_SECONDS = 60
GUEST_TTL_HOURS = 2
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
EMBED_BATCH = 20
VERIFICATION_MAX_ATTEMPTS = 2
BLOCK_SEPARATOR = "\n\n---\n\n"
UNTITLED = "Nueva conversación"
REFUSAL_MARKER = "No tengo esa información disponible en mi base de conocimientos"
CLARIFICATION_MARKER = "Tu pregunta puede aplicar a varios"
SUMMARY_OPEN = "=== RESUMEN DE MATERIAS POR SEMESTRE ==="
SUMMARY_CLOSE = "=== FIN DEL RESUMEN ==="

# Size bounds behind every explicit broadcast (see operators/scale.py).
QUERY_BLOCK_ROWS = 4096
QUERY_BLOCK_BYTES = 64 * 1024 * 1024

# Chunks per salted part of a frequent anchor word (full-text search).
ANCHOR_ROWS = 20_000

# Chunks with equal marks that are matched as one, and marks in one row of a text (full-text search).
CLASS_ROWS = 256
MARK_ROWS = 1000
