"""Word lists, patterns and formats that define the corpus semantics. Results depend on each of them."""

from __future__ import annotations

# fixed values: what normalisation drops: fenced and inline code, URLs; then white space collapses
NOT_PROSE = (r"(?s:```.*?```)", r"`[^`\n]+`", r"https?:\/\/\S+", r"\s+")

# fixed values: tags of a prompt
FILES = (
    r"\b\w+\.(?:js|ts|jsx|tsx|py|go|rs|java|cpp|c|h|md|json|yaml|yml|toml|sql|sh)\b",
    r"\b(?:src|lib|app|components|utils|tests?|api|pages|server|client)\/[\w/-]+",
    r"\*\.[\w]+",
    r"(?i:\b(?:file|files|path|paths)\b)",
)
TESTS = (r"(?i:\btest(?:s)?\b)", r"(?i:\bspec\b)", r"(?i:\bvalidation\b)", r"(?i:\bverify\b)", r"(?i:\bshould\s+\w+)", r"(?i:\bmust\s+\w+)")
CRITERIA = (r"(?i:\b(?:should|must|needs? to)\s+\w+)", r"(?i:\bgoal\b)", r"(?i:\bsuccess\b)", r"(?i:\bcriteria\b)", r"(?i:\bhandle\s+\d+)", r"(?i:\bpass\b)")
CONSTRAINTS = (r"(?i:\b(?:don't|do not|never)\s+\w+)", r"(?i:\bavoid\b)", r"(?i:\blimit\b)", r"(?i:\bmax\b)", r"(?i:\bconstraint\b)", r"(?i:\bwithout\s+breaking\b)")
HOME_PATHS = r"\/Users\/\w+|\/home\/\w+|C:\\Users\\\w+"
LOCAL_PORT = r"localhost:\d{4,5}"
MACHINE = r"(?i:\b(?:my mac|my laptop|my machine|my computer)\b)"
SOURCE_PATH = r"(?i:\/[a-z]+\/[a-z]+\/[^\s]+\.(?:js|ts|json))"
LOCAL_ENV = (HOME_PATHS, LOCAL_PORT, MACHINE, SOURCE_PATH)
SHAPE = r"(?i:\b(?:type|interface|schema|columns|fields|model|enum)\b)"
UI = r"(?i:\b(?:color|colour|spacing|font|alignment|layout|padding|margin|hover|click|button|modal|tooltip)\b)"
# the tags above in forms that find the same texts in less time: what only lengthens a match is left out, and a boundary is looked for behind or
# ahead only where a word of the list can begin or ends
QUICK_TAGS = {
    "files": (
        r"\w\.(?:jsx?|tsx?|py|go|rs|java|cpp|c|h|md|json|ya?ml|toml|sql|sh)(?!\w)",
        r"\*\.\w",
        r"(?=[slacutpFfP])(?<!\w)(?:(?:src|lib|app|components|utils|tests?|api|pages|server|client)\/[\w/-]|(?i:(?:file|path)s?)(?!\w))",
    ),
    "tests": (r"(?=[tTsSvVmM])(?i:(?<!\w)(?:(?:tests?|spec|validation|verify)(?!\w)|(?:should|must)\s+\w))",),
    "criteria": (r"(?=[sSmMnNgGcChHpP])(?i:(?<!\w)(?:(?:should|must|needs? to)\s+\w|(?:goal|success|criteria|pass)(?!\w)|handle\s+\d))",),
    "constraints": (r"(?=[dDnNaAlLmMcCwW])(?i:(?<!\w)(?:(?:don't|do not|never)\s+\w|(?:avoid|limit|max|constraint|without\s+breaking)(?!\w)))",),
    "local_env": (
        r"\/(?:Users\/\w|home\/\w|(?i:[a-z]+\/[a-z]+\/[^\s]+\.(?:js|ts)))",
        r"(?=[ClmM])(?:C:\\Users\\\w|localhost:\d{4}|(?i:(?<!\w)my (?:mac|laptop|machine|computer)(?!\w)))",
    ),
    "shape": (r"(?=[tTiIsScCfFmMeE])(?i:(?<!\w)(?:type|interface|schema|columns|fields|model|enum)(?!\w))",),
    "ui": (r"(?=[cCsSfFaAlLpPmMhHbBtT])(?i:(?<!\w)(?:colou?r|spacing|font|alignment|layout|padding|margin|hover|click|button|modal|tooltip)(?!\w))",),
}
LOCAL_ENV_LABELS = ("absolute paths (/Users/..., /home/...)", "localhost ports", "machine-specific references", "absolute file paths")

# fixed values: what a later prompt adds
FILE_NAME = r"\b\w+\.(?:js|ts|jsx|tsx|py|go|rs|java|cpp|c|h|md|json|yaml|yml|sql|sh)\b"
DIRECTORY = r"\b(?:src|lib|app|components|utils|tests?|api|pages|server|client)\/[\w/-]+"
CRITERIA_PHRASE = r"(?i:\b(?:should|must|needs? to)\s+[^.;\n]{3,80})"
CONSTRAINT_PHRASE = r"(?i:\b(?:don't|do not|never|avoid|without\s+breaking)\s+[^.;\n]{3,80})"
SHAPE_PHRASE = r"(?i:\b(?:type|interface|schema|columns|fields|enum)\s+[^.;\n]{3,80})"
UI_PHRASE = r"(?i:\b(?:color|colour|spacing|font|alignment|layout|padding|margin|hover|click|button|modal|tooltip)[^.;\n]{0,80})"
TESTS_PHRASE = r"(?i:\b(?:test|spec|verify|coverage|assertion)[^.;\n]{0,80})"
PAIR_SHAPE = r"(?i:\b(?:type|interface|schema|columns|fields|enum)\b)"
PAIR_UI = r"(?i:\b(?:color|spacing|font|alignment|layout|padding|margin|hover|click|button|modal|tooltip)\b)"
CONFIDENCE = {"files": 0.6, "criteria": 0.5, "constraints": 0.55, "tests": 0.45, "shape": 0.5, "ui": 0.5}
KINDS = ("file-scope", "success-criteria", "constraint", "data-shape", "ui-detail", "domain-context", "other")

# fixed values: machine-made prompts
HARNESS = ("This session is being continued from a previous", "<scheduled-task", "Base directory for this skill:", "Note from skill:")
CAVEAT, CAVEAT_LENGTH = "Caveat:", 200
LOGIN = "Last login:"
SHELL_MAIN = r"^main@\S+\s"
SHELL_ROOT = r"^root@\S+:"
SHELL_DOLLAR = r"^\$\s"
SHELL_PATH = r"[\\/]\w+"
REPORT = r"(?i:(?:smoke[\s\-]?test|audit|re[\s\-]?test|test)\s+report\b)"
REPORT_OPENER = r"(?i:^(?:Here's|here is|attached|see|results?|the\s))"
TEST_REPORT = r"(?i:^(?:RE-)?TEST REPORT\b)"
SMOKE_REPORT = r"(?i:^(?:Round\s+\d+\s+)?Smoke[\s\-]Test\s+(?:Report|Round))"
APP_SCRAPE = r"^[A-Z]\w+(?:\s+[A-Z]\w+){1,3}\s+(?:AI Suite|Dashboard|Console|Admin|Operations)"
CAPS_HEADER = r"^[A-Z][A-Z\- ]{2,}\s+[A-Z][A-Z\- ]{1,}"
COMPILED = r"(?i:^Here's\s+(?:the|a|my|some)?\s*(?:list|tips?|summary|recap|notes?|update|breakdown|guide|stuff|things)\b)"
OPENERS = (r"(?i:^The goal with\s)", r"(?i:^I'm thinking\b)", r"(?i:^I want to understand\b)")

# fixed values: words without weight in search and in scoring
SEARCH_STOP = tuple(
    "the and for are but not can has had how was this that with have will your from they been were into over just like when make some "
    "than them what their about should could would".split()
)
SCORE_STOP = SEARCH_STOP + tuple("use used using one two three new old".split())
KEYWORD_STOP = tuple(
    "the and for are but not you all can had her was one our out day get has him his how man new now old see two way who boy did its let put "
    "say she too use with have this will your from they know want been good much some time very when come here just like long make many over "
    "such take than them well were".split()
)

# fixed values: instrumentation of an evaluation
VAGUE_VERB = (
    r"(?i:\b(?:set\s+up|fix(?:\s+the)?|improve|handle|build(?:\s+the)?|audit|look\s+(?:at|better)|make\s+(?:it\s+)?(?:better|look\s+(?:better|good)?|work)"
    r"|do\s+(?:that|them|it)(?:\s+all)?)\b)"
)
DISAMBIGUATION = (
    r"(?i:\([a-c]\).+\([a-c]\).+\([a-c]\))",
    r"(?i:\bdoes\s+['\"]?\w+['\"]?\s+mean\b)",
    r"(?i:—\s+(?:write|wire|add|deploy|create|set up|configure|catch|log|retry).+?,\s+or\s+)",
)
LIVE = r"(?i:https?://|\blive\b|\bdeployed\b|\bproduction\b|\bdroplet\b)"
LOCAL = r"(?i:\blocal\b|\.py\b|\.ts\b|\.js\b|src/|/sessions/|/mnt/)"
KIND_FLOOR = 0.5
REJECTED = "__rejected__"

# fixed values: context files, budgets and prices
CONTEXT_FILES = {"PROJECT.md": 1.0, "CONTEXT.md": 0.9, "AGENTS.md": 0.8, "SOUL.md": 0.7, "README.md": 0.6}
KEPT_PORTS = ("3000", "3001", "8080", "8000")
# fixed values: what sanitising replaces, in this order
SANITISED = (
    (HOME_PATHS, "<USER_HOME>"),
    (rf"localhost:(?!(?:{'|'.join(KEPT_PORTS)})(?!\d))\d{{4,5}}", "localhost:<PORT>"),
    (r"(?i:(api[_-]?key|token|secret|password)\s*[:=]\s*['\"\w-]+)", "$1: <REDACTED>"),
    (r"\/\w+\/\w+\/[^\s]+\.(?:js|ts|json|md)", "<LOCAL_PATH>"),
    (r"(?i:(hostname|computer name|machine|device):\s*\w+)", "$1: <MACHINE>"),
)
PRICE_PER_MILLION = {"fresh": 3.0, "cached": 0.3, "out": 15.0}

# fixed values: snapshots
SKIPPED_DIRS = tuple("node_modules .git __pycache__ .venv venv dist build .next .cache .pytest_cache .mypy_cache .ruff_cache .tox".split())
SKIPPED_EXTENSIONS = tuple(
    ".png .jpg .jpeg .gif .webp .svg .ico .pdf .zip .tar .gz .tgz .7z .pyc .pyo .so .dylib .dll .exe .mov .mp4 .mp3 .wav .ogg "
    ".woff .woff2 .ttf .otf .eot .lock".split()
)
MOST_FILE_BYTES = 1_000_000
GZIP_ABOVE = 1024
TRASH_OVERLAP = 0.5

# fixed values: defaults of the configuration
CONTEXT_ORDER = ("PROJECT.md", "SOUL.md", "AGENTS.md", "CONTEXT.md", "README.md")
ENABLED_CHECKS = ("files-mentioned", "tests-mentioned", "success-criteria", "constraints", "local-env", "context-window")
MOST_CONTEXT_TOKENS = 4000

# fixed values: titles
TITLE_PREFIX = r"(?i:^(?:test:|update:|run:|apr|may|jun|jul|aug|sep|oct|nov|dec|jan|feb|mar)[\s\-—:]+)"
SCHEDULED = r"^<scheduled-task\s+name=\"([^\"]+)\""
TRASH_TIME = r"\s+\d{1,2}\.\d{2}\.\d{2}\s+(?:am|pm)\z"
