"""Fixed values of the engine's contract: lists and numbers that results depend on."""

# Words of a question that carry no meaning.
STOP_WORDS = frozenset(
    "about after and are before can como con cómo del does donde dónde esta está for from had has have hay how into las los para por que qué should son that the this una uno was were what when where which who whom whose why will with would".split()
)
# File name extensions that are never text.
BINARY_EXTENSIONS = (
    "7z avi bin bmp bz2 class dat dll dylib eot exe flac gif gz ico jar jpeg jpg lockb mkv mov mp3 mp4 node obj otf pdf png psd pyc rar so tar tgz tiff ttf war wasm wav webp woff woff2 xz zip".split()
)
# Globs that are always left out.
EXCLUDED_GLOBS = (
    "**/.DS_Store **/.env **/.env.* **/.git/** **/.gradle/** **/.hg/** **/.idea/** **/.mypy_cache/** **/.next/** **/.pytest_cache/** **/.ruff_cache/** **/.svn/** **/.terraform/** **/.venv/** **/.vscode/** **/__pycache__/** **/build/** **/coverage/** **/dist/** **/node_modules/** **/target/** Cargo.lock Gemfile.lock bun.lockb composer.lock flake.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock yarn.lock".split()
)
# Prose files score a third, project metadata a half.
PROSE_EXTENSIONS = "adoc markdown md mdc org rst txt".split()
PROSE_STEMS = "authors changelog changes codeowners contributing contributors copying history licence license notice readme".split()
METADATA_NAMES = (
    "biome.json build.gradle build.gradle.kts cargo.toml deno.json deno.jsonc go.mod go.work jsr.json lerna.json nx.json package.cjs.json package.json pom.xml pyproject.toml settings.gradle settings.gradle.kts setup.cfg turbo.json".split()
)
# Names of failures, with what a lower-case message holds; the first that fits. None stands for "worker http" and a status.
FAILURES = [
    ("fallback_exhausted", ["fallback exhausted"]),
    ("timeout", ["timed out", "timeout"]),
    ("http", None),
    ("transport", ["worker request failed", "error sending request"]),
    ("non_json_response", ["non-json"]),
    ("empty_content", ["no message content"]),
    ("free_route_blocked", ["free model routes"]),
    ("size_limit", ["exceeds"]),
    ("credential", ["credential", "api key"]),
    ("no_results", ["no relevant source"]),
]

MAX_TERMS = 12
ENVELOPE_TOKENS = 40
LINE_WEIGHT, NAME_FACTOR, EXACT_NAME_FACTOR = 4, 2, 8
CLIFF_PERCENT, CLIFF_FILES, MAX_FILES = 30, 3, 30
BLOCK_LINES, CHUNK_TOKENS, CHUNKS_PER_FILE = 48, 600, 6
BUDGET_TOKENS, CONTEXT_LINES, MAX_HITS = 12000, 8, 200
MMR_LAMBDA, SAME_PATH_SIMILARITY, FLOOR_PERCENT = 0.7, 0.5, 15
DENSE_TOP, DENSE_MARGIN, WINDOW_LINES = 24, 0.02, 80
RERANK_HEAD, GAP_LINES = 20, 16
SCOPE_FACTOR, UNTRACKED_FACTOR = 3, 2
PRF_FILES, PRF_TERMS = 3, 5
HITS_PER_FILE = 2000
# Bounds of what is asked: bytes of a question, characters of changed text and question together.
QUESTION_BYTES, DIFF_TEXT = 16_000, 100_000
# Bytes of a request to a model; a budget is a token for four of them at most.
REQUEST_BYTES = 4_000_000
# Milliseconds of all attempts at a reply, what is kept for each model still to come, and what an attempt has at least.
TIMEOUT_MS, FALLBACK_MS, ATTEMPT_MS = 60_000, 20_000, 5_000
