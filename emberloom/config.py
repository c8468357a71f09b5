"""Fixed values of the analytics: weights, thresholds, limits. Operators take them as parameters by default."""

RRF_K = 60
OVERSAMPLE, POOL_CAP = 4, 100
DECAY_DAYS = 30.0  # an e-folding time: the decay is exp(-age / 30)
SATURATION = 20
REINFORCEMENT = 0.01
TITLE_BONUS, CONTENT_BONUS = 0.016, 0.008
LEXICAL_DUPLICATE = 0.8
COSINE_DUPLICATE = 0.92
COSINE_BAND = 0.82
NEIGHBORS = 5
THEME_COSINE = 0.7
THEME_SIZE = 3
MAX_EPISODES = 200
SHIP_DATE = "2026-06-08"
WINDOW_SAMPLES = 240
ONSET_RUN = 3
FREE_FLOOR_BYTES = 2 * 1024**3
TURN_BUDGET_CHARS, MIN_TURNS = 30_000, 3
INJECT_CHARS = 1_600
MAX_FILE_BYTES = 1_048_576
BM25_K1, BM25_B = 1.2, 0.75
#: Kinds of observations, and the two files of a watched project by kind. Fixed values.
SOURCE_TYPES = ("context", "learning", "decision", "project_claude_md", "project_readme", "agent", "episode")
#: Files of a project below the memory root, by name.
OWN_FILES = {"CLAUDE": "project_claude_md", "learnings": "learning", "decisions": "decision"}
PROJECT_FILES = {"CLAUDE.md": "project_claude_md", "README.md": "project_readme"}
