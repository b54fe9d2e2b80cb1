"""Word lists, patterns and constants that results depend on."""

# Words that carry no meaning of their own in retrieval.
STOPWORDS = """
a about above after again against all am an and any are aren as at be because been before being below between both but by
can cannot could couldn did didn do does doesn doing don down during each few for from further had hadn has hasn have haven
having he her here hers herself him himself his how i if in into is isn it its itself just let ll me more most mustn my
myself no nor not of off on once only or other ought our ours ourselves out over own re same shan she should shouldn so some
such than that the their theirs them themselves then there these they this those through to too under until up ve very was
wasn we were weren what when where which while who whom why will with won would wouldn you your yours yourself yourselves
also using used use e.g i.e etc via within upon among across
""".split()

# Words that never name a concept.
CONCEPT_STOPWORDS = """
nothing else something anything everything thing things true false null given means makes make need needs take takes comes
goes gives based way ways case cases point points kind sort part parts time times number numbers test tests result results
value values term terms example examples note notes here there this that these those every each same different following
above below less least most more many much often always never without within whether rather enough still even just only both
either neither
""".split()

# Words of retrieval and of surface text.
RAW_WORD = "[a-z0-9]+(?:['’-][a-z0-9]+)*"
SURFACE_WORD = "[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
SENTENCE = r"[^.!?]+[.!?]+[\])'\"]*\s*|[^.!?]+\z"
LEAD_SENTENCE = "[^.!?]{40,240}[.!?]"

# Fixed values: (scheme, priority, names), in order of search, and what may stand between name and number.
UNIT_SCHEMES = (
    ("Week", 0, "(?:week|wk)"),
    ("Week", 0, "w"),
    ("Module", 1, "module"),
    ("Topic", 2, "topic"),
    ("Unit", 3, "unit"),
    ("Lecture", 4, "(?:lecture|lec)"),
    ("Session", 5, "session"),
    ("Tutorial", 6, "(?:tutorial|tute|lab)"),
    ("Chapter", 7, "chapter"),
)
UNIT_GAP = r"\s*[-–—:.]?\s*"
UNIT_NAMES = "week|wk|lecture|lec|topic|module|unit|session|tutorial|lab|chapter"
UNIT_NUMBERS = (1, 52)
EXPLICIT_WITHIN = 200

# Chunk sizes in characters.
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP, CHUNK_LEAST = 1200, 1800, 180, 40
DOCUMENT_LEAST = 40

# The hashed embedding.
DIMENSIONS = 512
FNV_SEED, FNV_PRIME = 0x811C9DC5, 0x01000193
WORD_SALT, GRAM_SALT, PAIR_SALT = 1, 2, 3
WORD_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT = 1.0, 0.35, 0.6

# Ranking.
BM25_K1, BM25_B = 1.5, 0.75
SEMANTIC_WEIGHTS = {"dense": 0.5, "lexical": 0.35, "concept": 0.15}
LOCAL_WEIGHTS = {"dense": 0.35, "lexical": 0.5, "concept": 0.15}
DIVERSITY = 0.35
CONCEPT_THRESHOLD, MATCHED_CONCEPTS = 0.25, 6
TOP_K, MAX_K, STUDY_K, KEY_POINTS, CARDS = 8, 30, 14, 8, 12

# Uploads and connectors.
EXTENSIONS = (".pdf", ".docx", ".md", ".markdown", ".txt", ".html", ".htm")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
KINDS = ("upload", "notion", "gdocs")
EMBED_BATCH = 128
"""Texts in one call of a remote embedder."""

# Code points that browsers take for white space.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
