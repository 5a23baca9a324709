"""Word lists, patterns, weights and limits that results depend on.

Everything here is data. Patterns are regular expressions understood by Spark; weights are added by
``operators.predicates.score_by_rules``. Callers may pass their own lists instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

# == limits ===================================================================================

MAX_FILES_PER_REPO = 25_000
MAX_FILE_BYTES = 512_000
MAX_BODY_CHARS = 10_000_000
MAX_LINKS_PER_INDEX = 600
MAX_HEADINGS_PER_PAGE = 600
MAX_ENTRIES_PER_SOURCE = 1_000
MAX_HEADINGS_PER_FILE = 16
MAX_FALLBACK_FILES = 80
MAX_HEADINGS_PER_FALLBACK_FILE = 400
MAX_SOURCE_MAP_FILES = 48
MAX_URLS_PER_REPO = 40
MAX_CANDIDATES = 120
MAX_CANDIDATES_KEPT = 100
MAX_PER_ORIGIN = 28
MAX_PRIMARY_PER_ORIGIN = 18
MAX_SNIPPETS_PER_PAGE = 4
MAX_SNIPPET_CHARS = 5_000
MIN_SNIPPET_CHARS = 200
MAX_CONTEXT_CHARS = 8_000
MAX_PAGE_SOURCE_FILES = 12
MAX_PAGES_SCHEMA = 128
MAX_PAGES_RUNTIME = 52
MAX_MAP_GROUPS = 30
MAX_MAP_EXAMPLES = 5
MAX_DOCS_TREE_PATHS = 140
MAX_DOCS_TREE_GROUPS = 32
MAX_DOCS_TREE_EXAMPLES = 8
MAX_GROUP_ENTRIES = 40
MAX_REPORTED_FAILURES = 6

SCAN_LIMIT = 100
ENQUEUE_LIMIT = 3
CATCH_UP_LIMIT = 12
COOLDOWN_HOURS = 24
STALE_BEFORE_SESSION_MINUTES = 20
STALE_ACTIVE_MINUTES = 15
STALE_METADATA_HOURS = 6

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
GENERATION_LIMITS = {
    "client_hour": 10,
    "client_day": 50,
    "global_hour": 120,
    "cooldown_us": 10 * 60_000_000,
}
CHAT_LIMITS = {"client_hour": 40, "client_day": 200, "global_hour": 600, "cooldown_us": 0}

# == words ====================================================================================

SLUG_ACRONYMS = [
    "api", "cli", "sdk", "ui", "ssr", "ssg", "jsx", "tsx", "css", "html", "http", "url", "json", "sql",
    "orm",
]
OUTLINE_ACRONYMS = ["api", "cli", "css", "dom", "html", "jsx", "mcp", "mdx", "openapi", "sdk", "ui", "url"]
NAV_ACRONYMS = [
    "api", "cli", "css", "dom", "html", "jsx", "mcp", "mdx", "openapi", "pwa", "rsc", "sdk", "ui", "url",
]
TOPIC_ACRONYMS = ["api", "cli", "css", "dom", "html", "jsx", "mdx", "pwa", "rsc", "sdk", "ui", "url"]

USEFUL_SHORT_TERMS = ["act", "api", "ci", "cli", "css", "dom", "jsx", "rsc", "sdk", "tsx"]
GENERIC_TITLE_WORDS = (
    [
    "api", "app", "and", "components", "documentation", "guide", "guides", "or", "overview", "reference",
    "router", "the",
]
)
PAGE_KEYWORD_STOP_WORDS = [
    "and", "are", "component", "components", "example", "examples", "for", "from", "guide", "guides", "how",
    "integration", "integrations", "into", "overview", "page", "pattern", "patterns", "reference", "the",
    "this", "to", "using", "with",
]
DESCRIPTION_STOP_WORDS = [
    "and", "apps", "build", "building", "for", "framework", "javascript", "native", "node", "open",
    "platform", "project", "react", "server", "source", "the", "tool", "tools", "typescript", "web", "with",
]
STOP_TOPICS = [
    "api", "app", "apps", "cli", "code", "compiler", "css", "framework", "go", "golang", "html",
    "javascript", "language", "library", "node", "nodejs", "react", "server", "tool", "tools", "typescript",
    "web",
]
STOP_PATH_SEGMENTS = [
    "assets", "bench", "benches", "build", "cmd", "common", "docs", "examples", "internal", "lib", "misc",
    "node_modules", "package", "packages", "pkg", "scripts", "src", "test", "tests", "tools", "vendor",
    "website",
]
GENERIC_SOURCE_TERMS = [
    "about", "adding", "advanced", "api", "apis", "built", "compiler", "component", "components", "concept",
    "concepts", "data", "doc", "docs", "documentation", "example", "examples", "file", "files", "from",
    "getting", "guide", "guides", "html", "http", "https", "introduction", "learn", "overview", "page",
    "pages", "quick", "reference", "removing", "start", "started", "tutorial", "tutorials", "using", "your",
]
GENERIC_MATCH_WORDS = ["api", "apis", "docs", "documentation", "learn", "overview", "reference"]
GENERIC_TOPIC_WORDS = ["and", "api", "app", "docs", "documentation", "guide", "guides", "learn", "overview", "reference", "the"]

HTML_ENTITIES = [
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]

# == files ====================================================================================

LANGUAGE_BY_EXTENSION = {
    "css": "css",
    "go": "go",
    "js": "javascript",
    "jsx": "javascript",
    "json": "json",
    "md": "markdown",
    "mdx": "markdown",
    "py": "python",
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "yml": "yaml",
    "yaml": "yaml",
}
UNUSED_PATH = r"node_modules/|/dist/|/build/|/coverage/|\.lock$"
NAMED_SOURCE_FILES = ["readme", "license", "copying", "changelog", "dockerfile"]
SOURCE_EXTENSION = r"(?i)\.(ts|tsx|js|jsx|py|go|rs|md|mdx|json|yaml|yml|toml|css)$"

REPO_URL = r"(?i)^https://github\.com/([^/\s]+)/([^/\s#?]+?)(?:\.git)?/?$"
SAFE_REPO_PART = r"^[A-Za-z0-9_.-]+$"

PLANNING_README = r"^(?:docs|documentation)/readme\.(?:md|mdx|mdoc|txt)$"
PLANNING_DIRECTORY = (
    r"^(?:docs|documentation)/(?:active|completed|drafts?|notes?|plans?|planning|research|scratch"
    r"|scratchpad|tmp|todo)/"
)
PLANNING_FILE = (
    r"^(?:docs|documentation)/.*(?:feedback|deep-dive|harness-gaps?|gap-analysis|quality-runs?"
    r"|research-plan|implementation-plan|workflow-plan|auto-update-plan|porting-notes?|scratchpad"
    r"|todo).*\.(?:md|mdx|mdoc|txt)$"
)

_DOCS_ROOTS = r"(docs|content/docs|site/docs|website/docs)"
_DOCS_ROOTS_LONG = r"(docs|documentation|content/docs|site/docs|website/docs)"
_DOCS_INDEX_FILES = (
    r"(^|/)(llms\.txt|sitemap\.md|meta\.json|mint\.json|navigation\.(json|ts|tsx|js|jsx))$"
)
_ANY_README = r"(^|/)readme(\.mdx?)?$"
DOCS_SOURCE_PATTERNS = {
    "prompt": [
        _ANY_README,
        _DOCS_INDEX_FILES,
        rf"^{_DOCS_ROOTS_LONG}/",
        rf"(^|/){_DOCS_ROOTS_LONG}/.+\.(md|mdx|mdoc|txt|json|yaml|yml)$",
    ],
    "count": [
        _ANY_README,
        _DOCS_INDEX_FILES,
        rf"^{_DOCS_ROOTS}/",
        rf"(^|/){_DOCS_ROOTS}/.+\.(md|mdx|mdoc|txt|json|yaml|yml)$",
    ],
    "fallback": [
        r"(^|/)(docs?|documentation|developer-docs|content|website|site)(/|$)",
        r"^apps/docs/",
        r"^apps/(?:web|www)/docs/",
        r"^apps/(?:web|www)/src/(?:app|pages)/docs/",
        r"^packages/(?:docs|documentation)/",
        r"^\d{2,3}-[a-z0-9-]+/readme\.(md|mdx|rst)$",
        r"^translations/en/\d{2,3}-[a-z0-9-]+/readme\.(md|mdx|rst)$",
    ],
}
MARKDOWN_FILE = r"\.(md|mdx|rst)$"
UNUSABLE_MARKDOWN = [
    r"(^|/)(?:_navbar|_sidebar|navbar|sidebar|enhanced_features_roadmap|security_guidelines)"
    r"\.(md|mdx|rst)$",
    r"(^|/)(?:404|not-found)\.(md|mdx|rst)$",
    r"(^|/)(?:license|code_of_conduct|security|contributing|changelog|changes)\.(md|mdx|rst)$",
    r"/(?:blog|posts|news|changelog|changesets?|release-notes?|licenses?)/",
]
TRANSLATION_ROOT = r"^translations/[a-z]{2}(?:-[a-z]{2})?/"
ENGLISH_TRANSLATION_ROOT = r"^translations/en/"
GUIDE_README_FILE = r"(^|/)(?:readme|index)\.(md|mdx|rst)$"
GUIDE_README_EXCLUDED = (
    r"^(?:dist|build|coverage|vendor|node_modules|test|tests|__tests__|fixtures?|examples?/fixture)"
)
GUIDE_README_CHANGESET = r"^\.changeset/"
GUIDE_README_PLACES = [
    r"^(?:readme|index)\.(md|mdx|rst)$",
    r"^(?:examples?|samples?|templates?|demo|demos|evaluation|eval|evals|finetune|data|packages?"
    r"|apps?|tools?|cli)/",
]
ROOT_README = r"(?i)^readme\.(md|mdx|rst)$"
DOCS_PATH_ORDER = [
    (
        r"(?i)/(get-started|getting-started|quickstart|tutorial|overview|introduction|index)\.mdx?$",
        0,
    ),
    (r"(?i)/(fundamentals|core)/", 1),
    (r"(?i)/(standard|api|reference)/", 2),
]
DOCS_ROOT_SEGMENT = r"(?i)^(docs?|documentation|developer-docs|content|website|site)$"
ROUTE_PAGE_FILE = r"(?i)^(page|index)\.(md|mdx|rst)$"
INDEX_FILE = r"(?i)^(readme|index)\.(md|mdx|rst)$"

REPRESENTATIVE_FILE = (
    r"(^|/)readme(\.mdx?)?$|(^|/)package\.json$|(^|/)cargo\.toml$"
    r"|(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|rs)$"
    r"|(^|/)(next|vite|turbo|jest|vitest|eslint|biome|tsconfig|taskfile)\."
)
MAP_GROUP_ROOTS = ["packages", "apps", "services", "crates"]
MAP_GROUP_PRIORITY = [
    (r"^root files$", 1_000),
    (r"^docs$", 900),
    (r"^packages/", 850),
    (r"^apps/", 820),
    (r"^crates/", 800),
    (r"^turbopack/", 780),
    (r"^src$", 760),
    (r"^tests?$", 720),
    (r"^\.github$", 680),
]
DOCS_TREE_ROOTS = ["docs", "documentation", "content/docs", "site/docs", "website/docs"]
DOCS_TREE_NESTED = r"^(content|pages|src|app)$"
DOCS_TREE_EXTENSION = r"(?i)\.(mdx?|mdoc|txt|json|ya?ml)$"

DOCS_CONTENT_PREFIXES = [
    "apps/docs/content",
    "apps/docs/src/content",
    "apps/web/content",
    "apps/www/content",
    "content/docs",
    "content",
    "docs/source",
    "docs/cpp/source",
    "site/docs",
    "site/content",
    "website/docs",
    "website/content",
    "docs",
]
DOCS_CONTENT_PATH = (
    r"(?i)^(?:apps/docs/content|apps/docs/src/content|apps/web/content|apps/www/content"
    r"|content(?:/docs)?|docs(?:/source)?|site/(?:docs|content)|website/(?:docs|content))/"
)
COMPARABLE_EXTENSION = r"(?i)\.(md|mdx|mdoc|txt|json|ya?ml|tsx?|jsx?)$"

# == scored rules =============================================================================


@dataclass(frozen=True)
class RuleSet:
    """Additive scoring rules over one text column.

    ``rules`` all add up; of ``first_of`` only the first hit counts (``otherwise`` if none);
    ``fixed`` short-circuits to a final score; ``per_slash`` is added for each slash.
    ``penalty`` is (weight, cap): subtracted per path segment up to the cap.
    """

    rules: list[tuple[str, int]]
    lower: bool = True
    first_of: list[tuple[str, int]] = field(default_factory=list)
    otherwise: int = 0
    fixed: list[tuple[str, int]] = field(default_factory=list)
    per_slash: int = 0
    penalty: tuple[int, int] | None = None
    floor: int | None = None
    any_of: list[str] | None = None
    max_bytes: int | None = None
    limit: int | None = None
    descending: bool = True


_VENDOR = r"(^|/)(node_modules|dist|build|coverage|\.next|compiled|vendor|vendored)(/|$)"
_TESTS = r"(^|/)(test|tests|__tests__|fixtures|__fixtures__|testdata)(/|$)"
_SOURCE_MAP_ROOT = (
    r"^(?:package\.json|pnpm-workspace\.yaml|turbo\.json|vercel\.json|next\.config\.(?:js|mjs|ts)"
    r"|tsconfig\.json)$"
)
_SOURCE_MAP_CONFIG = r"(^|/)(?:package\.json|next\.config\.(?:js|mjs|ts)|vercel\.json|tsconfig\.json)$"
_DOCS_TOPIC_DIRS = (
    r"(^|/)(api-reference|reference|guides?|tutorials?|concepts?|foundations?|examples?|cookbook"
    r"|troubleshooting|migration|upgrade)(/|$)"
)
_DOCS_SOURCE_RULES = [
    (r"^readme(\.mdx?)?$", 2_000),
    (r"^(docs|documentation)/(llms\.txt|sitemap\.md|meta\.json)$", 1_900),
    (_DOCS_INDEX_FILES, 1_700),
    (
        rf"(^|/){_DOCS_ROOTS_LONG}/(index|introduction|overview|get-started|getting-started"
        r"|quickstart)\.(md|mdx|mdoc)$",
        1_550,
    ),
    (rf"(^|/){_DOCS_ROOTS_LONG}/.+\.(md|mdx|mdoc)$", 1_200),
    (rf"(^|/){_DOCS_ROOTS_LONG}/", 900),
    (_DOCS_TOPIC_DIRS, 450),
    (_TESTS, -600),
]
_PRIORITY_CONTEXT = [
    r"(^|/)readme(\.mdx?)?$",
    r"(^|/)package\.json$",
    r"(^|/)cargo\.toml$",
    r"(^|/)taskfile\.[jt]s$",
    r"^(pnpm-workspace\.yaml|pnpm-lock\.yaml|lerna\.json|turbo\.json|\.cargo/config\.toml"
    r"|jest\.config\.[jt]s|jest\.config\.turbopack\.js|tsconfig\.json)$",
    r"(^|/)index\.[jt]sx?$",
    r"(^|/)main\.(ts|tsx|js)$",
    r"(^|[/.])test\.(js|ts|tsx)$",
    r"^(docs|content/docs|examples|cookbook|templates|\.github/workflows)/",
    r"/src/",
]
_CHAT_FILES = [r"(^|/)readme\.md$", r"(^|/)package\.json$", r"^tsconfig\.json$", r"(^|/)(index|main)\.tsx?$"]
_CHAT_HIDDEN = [(r"^\.", 90), (r"^(\.github|\.agents|\.claude-plugin)(/|$)", 80)]
_CHAT_TESTS = r"(^|/)__tests__(/|$)|[^/]*\.test\.[^/]*$|[^/]*\.spec\.[^/]*$"

RULE_SETS: dict[str, RuleSet] = {
    "context": RuleSet(
        rules=[
            (r"^readme(\.mdx?)?$|^package\.json$", 1_000),
            (r"(^|/)readme(\.mdx?)?$", 950),
            (r"(^|/)package\.json$", 900),
            (
                r"^(pnpm-workspace\.yaml|lerna\.json|turbo\.json|cargo\.toml|\.cargo/config\.toml"
                r"|taskfile\.[jt]s|jest\.config)",
                900,
            ),
            (r"^packages/[^/]+/package\.json$", 820),
            (r"^packages/[^/]+/readme(\.mdx?)?$", 820),
            (r"^rspack/package\.json$", 760),
            (r"^crates/[^/]+/cargo\.toml$", 720),
            (r"^turbopack/crates/[^/]+/cargo\.toml$", 700),
            (r"^(docs|content/docs|site/docs|website/docs)/", 760),
            (r"^(examples|cookbook|templates)/", 560),
            (r"^packages/[^/]+/src/(index|main|mod|lib)\.(ts|tsx|js|jsx|rs)$", 520),
            (r"^packages/[^/]+/src/", 260),
            (r"^crates/next-core/", 220),
            (r"^turbopack/crates/", 200),
            (r"(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|rs)$", 120),
            (
                r"(^|/)(migration|migrate|upgrade|troubleshoot|troubleshooting|error|faq|reference"
                r"|api)\.(mdx?|tsx?)$",
                180,
            ),
            (_VENDOR, -500),
            (r"(^|/)(__fixtures__|fixtures|__testfixtures__|test-fixtures|testdata)(/|$)", -400),
            (r"(^|/)(__tests__|test|tests|spec)(/|$)|(\.|-)(test|spec|test-d)\.", -80),
            (r"^\.github/actions/", -120),
        ],
        any_of=_PRIORITY_CONTEXT,
        max_bytes=160_000,
        limit=100,
    ),
    "inventory": RuleSet(
        rules=[
            (r"^readme(\.mdx?)?$|^package\.json$", 2_000),
            (r"^(pnpm-workspace\.yaml|lerna\.json|turbo\.json|cargo\.toml|taskfile\.[jt]s)", 1_900),
            (r"^packages/[^/]+/package\.json$", 1_600),
            (r"^apps/[^/]+/package\.json$", 1_450),
            (r"^crates/[^/]+/cargo\.toml$", 1_350),
            (r"^turbopack/crates/[^/]+/cargo\.toml$", 1_300),
            (r"^docs/", 900),
            (r"^packages/[^/]+/src/", 700),
            (r"^crates/[^/]+/src/", 650),
            (r"^test(s)?/", 350),
            (r"\.test\.(ts|tsx|js|jsx|rs)$", 250),
            (_VENDOR, -2_000),
        ],
        limit=180,
    ),
    "docs_sources": RuleSet(
        rules=_DOCS_SOURCE_RULES, any_of=DOCS_SOURCE_PATTERNS["prompt"], limit=60
    ),
    "docs_tree": RuleSet(
        rules=_DOCS_SOURCE_RULES
        + [
            (rf"(^|/){_DOCS_ROOTS_LONG}/", 500),
            (
                r"(^|/)(index|introduction|overview|get-started|getting-started|quickstart)"
                r"\.(md|mdx|mdoc)$",
                350,
            ),
            (_DOCS_TOPIC_DIRS, 250),
            (_DOCS_INDEX_FILES, 600),
            (_TESTS, -800),
        ],
        any_of=DOCS_SOURCE_PATTERNS["prompt"],
        limit=140,
    ),
    "public_surface": RuleSet(
        rules=[
            (r"^readme(\.mdx?)?$|^package\.json$", 2_000),
            (r"^packages/[^/]+/readme(\.mdx?)?$", 1_800),
            (r"^packages/[^/]+/package\.json$", 1_750),
            (r"(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 1_400),
            (r"(^|/)(cli|command|commands)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 1_350),
            (r"(^|/)(route|routes|api|client|server)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 1_250),
            (r"(^|/)(config|options|schema|types)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 1_100),
            (r"^(docs|content/docs|site/docs|website/docs)/", 1_000),
            (r"^(examples|cookbook|templates)/", 800),
            (_TESTS, -600),
            (r"(^|/)(dist|build|coverage|compiled|vendor|vendored)(/|$)", -1_000),
        ],
        any_of=[
            _ANY_README,
            r"(^|/)package\.json$",
            r"(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$",
            r"(^|/)(cli|command|commands|route|routes|api|client|server|config|options|schema|types)"
            r"\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$",
            r"(^|/)(bin|cli|commands|routes|api|sdk|client|adapters?|plugins?|integrations?)(/|$)",
            r"(^|/)(docs|content/docs|site/docs|website/docs|examples|cookbook|templates)/",
        ],
        limit=50,
    ),
    "source_map": RuleSet(
        rules=[
            (_SOURCE_MAP_ROOT, 100),
            (_SOURCE_MAP_CONFIG, 70),
            (
                r"(^|/)(?:index|main|cli|server|client|config|route|page|layout|middleware)"
                r"\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|rs)$",
                90,
            ),
            (r"^(?:app|pages)/(?:api/)?", 80),
            (r"(^|/)(?:app|pages)/(?:api/)?", 70),
            (r"^(?:src|lib|server|client|cli|commands|api)/", 65),
            (r"(^|/)(?:src|lib|server|client|cli|commands|api)/", 55),
            (r"^packages?/", 45),
            (r"^examples?/", 25),
        ],
        penalty=(4, 40),
        limit=48,
    ),
    "path_fallback": RuleSet(
        rules=[
            (r"^readme(\.mdx?)?$", 35),
            (r"^package\.json$", 60),
            (r"^src/(index|main|mod|lib)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 55),
            (
                r"^packages/[^/]+/(index|package\.json|src/(index|main|reactclient)"
                r"\.(ts|tsx|js|jsx|mjs|cjs))$",
                45,
            ),
            (r"(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 20),
            (r"(^|/)package\.json$", 15),
            (r"(^|/)(test|tests|__tests__|fixtures|__fixtures__|testdata|playground)(/|$)", -60),
            (r"(^|/)(dist|build|coverage|vendor|vendored|compiled)(/|$)", -60),
            (r"(^|/)(examples?|demo|demos)(/|$)", -25),
        ],
        floor=0,
        limit=6,
    ),
    "chat_context": RuleSet(
        rules=[
            (r"(^|/)(packages|src|app)(/|$)", -8),
            (r"(^|/)(docs|examples)(/|$)", -6),
            (r"^\.", 60),
            (r"(^|/)tests?(/|$)|[^/]*\.test\.[^/]*$", 20),
        ],
        fixed=[(r"^readme\.md$", 0), (r"^package\.json$", 1), (r"^tsconfig\.json$", 2)],
        first_of=[
            (r"(^|/)readme\.md$", 10),
            (r"(^|/)package\.json$", 20),
            (r"(^|/)index\.tsx?$", 30),
            (r"(^|/)main\.tsx?$", 40),
        ],
        otherwise=100,
        per_slash=1,
        any_of=_CHAT_FILES,
        max_bytes=40_000,
        limit=8,
        descending=False,
    ),
    "chat_sandbox": RuleSet(
        rules=[
            (r"^readme\.md$", -220),
            (r"^package\.json$", -210),
            (r"^tsconfig\.json$", -130),
            (r"(^|/)readme\.md$", -110),
            (r"(^|/)package\.json$", -100),
            (r"(^|/)index\.tsx?$", -80),
            (r"(^|/)main\.tsx?$", -70),
            (r"(^|/)(docs|examples)(/|$)", -40),
            (r"(^|/)(packages|src|app)(/|$)", -30),
            (_CHAT_TESTS, 35),
            *_CHAT_HIDDEN,
        ],
        per_slash=8,
        max_bytes=180_000,
        limit=36,
        descending=False,
    ),
    "chat_inventory": RuleSet(
        rules=[
            (r"^readme\.md$", -200),
            (r"^package\.json$", -190),
            (r"^tsconfig\.json$", -120),
            (r"(^|/)readme\.md$", -100),
            (r"(^|/)package\.json$", -90),
            (r"(^|/)index\.tsx?$", -70),
            (r"(^|/)main\.tsx?$", -60),
            (r"(^|/)(docs|examples)(/|$)", -35),
            (r"(^|/)(packages|src|app)(/|$)", -25),
            (_CHAT_TESTS, 35),
            *_CHAT_HIDDEN,
            (r"(^|/)(node_modules|dist|build)(/|$)", 100),
        ],
        per_slash=8,
        limit=180,
        descending=False,
    ),
    "html_expansion": RuleSet(
        rules=[
            (
                r"/(learn|docs?|documentation|book|reference|api|manual|manuals|guide|guides|contents)"
                r"(/|index\.html|$)",
                50,
            ),
            (
                r"/(tutorial|getting-started|quickstart|fundamentals|library|standard-library|cargo"
                r"|rustdoc|rustc)(/|index\.html|$)",
                25,
            ),
            (r"/(blog|news|community|support|download|install|policy|license)(/|$)", -50),
            (r"^(?!/en(?:-[a-z]{2})?/).*/[a-z]{2}(?:-[a-z]{2})?/", -40),
        ],
        limit=8,
    ),
}

SOURCE_MAP_UNUSED = (
    r"\.(png|jpe?g|gif|webp|svg|ico|lock|log|map|snap|wasm|woff2?|ttf|otf)$"
    r"|(^|/)(?:dist|build|coverage|vendor|node_modules|test-results|fixtures?)(/|$)"
)
SOURCE_MAP_KEPT = [
    _SOURCE_MAP_ROOT,
    _SOURCE_MAP_CONFIG,
    r"^(?:app|pages|src|lib|components|server|client|cli|commands|api|packages|examples?)/.*"
    r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|swift|kt|java|cs|json|yaml|yml)$",
    r"(^|/)(?:app|pages|src|lib|components|server|client|cli|commands|api)/.*"
    r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|swift|kt|java|cs|json|yaml|yml)$",
]

# == addresses ================================================================================

URL_IN_TEXT = r"(?i)https?://[^\s<>\"'`)\]}]+"
BLOCKED_HOSTS = [
    "azure.microsoft.com",
    "github.com",
    "issues.apache.org",
    "openai.com",
    "raw.githubusercontent.com",
]
BLOCKED_HOST_SUFFIXES = [
    "github.com",
    "npmjs.com",
    "pypi.org",
    "slack.com",
    "stackoverflow.com",
    "twitter.com",
    "wikipedia.org",
    "x.com",
    "youtube.com",
]
BLOCKED_HOST_PARTS = ["badgen.net", "bugsplat.com", "discord.", "shields.io"]
PREVIEW_HOST_SUFFIXES = ["cloudfront.net", "grafana.net", "herokuapp.com", "labs.vercel.dev"]

SHARED_DEPLOYMENT_HOST = r"(^|\.)(vercel\.app|netlify\.app|pages\.dev)$"
DOCS_HOST_LABELS = ["doc", "docs", "documentation", "learn", "developer"]
VERSION_SEGMENT = r"^(?:v?\d+(?:\.\d+)*|latest|stable|current)$"
PLACEHOLDER_WORD = r"(?i)^(undefined|null|nan|none|tbd|todo)$"
GENERIC_URL_PART = r"^(docs?|documentation|reference|learn|latest|current|stable)$"
GENERIC_DOCS_ROOT = r"^(docs?|documentation|latest|current|stable)$"
URL_NAMESPACES = [
    (r"/reference/eslint-plugin-react-hooks(?:\.md|/|$)", "eslint-plugin-react-hooks"),
    (r"/reference/rules(?:\.md|/|$)", "rules-of-react"),
    (r"/reference/react-dom/server(?:\.md|/|$)", "react-dom-server"),
    (r"/reference/react-dom/static(?:\.md|/|$)", "react-dom-static"),
    (r"/reference/react-dom/client(?:\.md|/|$)", "react-dom-client"),
    (r"/reference/react-dom(?:\.md|/|$)", "react-dom"),
    (r"/reference/react(?:\.md|/|$)", "react"),
    (r"/learn/react-compiler(?:/|$)", "react-compiler"),
]
DOCS_FAMILY_NAMESPACE = (
    r"/docs/(?:guides/)?(ai|api|auth|authentication|cli|cron|database|databases|deployment"
    r"|edge-functions|embeddings|functions|integrations|local-development|models|platform|providers"
    r"|queues|realtime|resources|search|security|storage|vector|vectors)(?:/|$)"
)

ASSET_FILE = r"\.(png|jpe?g|gif|webp|svg|css|js|json|ico|pdf|zip|gz|tgz|ics)$"
ASSET_DIRECTORY = r"/(?:icons?|assets?|images?|fonts?)/"
MALFORMED_PATH = r"(?:%3c|%3e|</?script|customelements\.define|\.tostring\(\))"
NON_DOCS_PATHS = [
    r"/(?:404|not-found)(?:[/.]|$)",
    r"^/dl/?$",
    r"/(blog|news|pricing|showcase|customers|partners|events|careers|contact|login|signin|signup"
    r"|support|guidelines|brand|legal|privacy|terms|security-advisories|tags)(?:[/.]|$)",
    r"/_(?:sources|downloads)/",
    r"/(?:genindex|search)\.html$",
]
COMPANY_PATH = r"/(about|company)(/|$)"
MAX_DOCS_PATH_SEGMENTS = 6
DOCS_PATH = (
    r"/(docs?|documentation|learn|guide|guides|api|reference|manual|manuals|book|contents|developer"
    r"|tutorial|tutorials|examples?|cookbook|runtime|deploy|cli|sdk|framework|fundamentals|concepts"
    r"|components|commands|configuration|extensions?|start|quickstart|how-to|explanation|upgrade"
    r"|migration|library|standard-library|install|installation|engine|containers?|images?|daemon"
    r"|network|storage|swarm|compose|build|auth|authentication|database|realtime|functions?"
    r"|edge-functions?|formatter|linter|analyzer|ai|models?|providers?|embeddings?|vectors?|search)"
    r"(/|$)"
)
ENTRY_PATH = (
    r"/(docs?|documentation|learn|guide|guides|api|reference|manual|manuals|book|contents|developer"
    r"|tutorial|tutorials|examples?|cookbook|runtime|deploy|cli|sdk|framework|fundamentals|concepts"
    r"|components|commands|configuration|extensions?|start|quickstart|how-to|explanation|upgrade"
    r"|migration|library|standard-library|install|installation|formatter|linter|analyzer|auth"
    r"|authentication|database|realtime|functions?|edge-functions?|ai|models?|providers?"
    r"|embeddings?|vectors?|search)(/|$)"
)
URL_ORDER = [
    (r"/(learn|getting-started|quickstart|tutorial)", 0),
    (r"/(docs?|guide|guides|manual|book)", 1),
    (r"/(api|reference)", 2),
    (r"/(examples?|cookbook)", 3),
]
SECTION_SEGMENT = (
    r"^(docs?|documentation|learn|guide|guides|api|reference|manual|manuals|book|contents|developer"
    r"|tutorial|examples?|cookbook|runtime|deploy|cli|sdk|framework|fundamentals|concepts|components"
    r"|commands|configuration|extensions?|library|standard-library|engine|containers?|images?|daemon"
    r"|network|storage|swarm|compose|build|formatter|linter|analyzer|auth|authentication|database"
    r"|databases|realtime|functions?|edge-functions?|ai|models?|providers?|embeddings?|vectors?"
    r"|search)$"
)
PLAIN_DOCS_SEGMENT = r"^(docs?|documentation|manual|manuals)$"
LEAD_IN_SEGMENT = (
    r"^(index|overview|introduction|getting-started|quickstart|install|installation)$"
)
GROUP_SCORES = [
    (r"(?i)(getting started|quick start|quickstart|installation|setup|tutorial|learn|start)", 90),
    (r"(?i)(concept|foundation|architecture|fundamentals?|overview)", 75),
    (r"(?i)(guide|workflow|usage|how to|integration|deploy|testing|migration|upgrade)", 65),
    (r"(?i)(api|reference|configuration|command|cli|components?|functions?|hooks?)", 55),
    (r"(?i)(example|cookbook|recipe|troubleshoot|error|faq)", 45),
    (
        r"(?i)(ai|agent|models?|providers?|embeddings?|vectors?|search|database|storage|auth"
        r"|authentication|realtime|edge functions?)",
        58,
    ),
]
DOCS_INDEX_ROOT = (
    r"(?i)^(docs?|documentation|learn|guide|guides|reference|api|manual|manuals|book|contents"
    r"|developer|tutorial|tutorials)$"
)
FIRST_SEGMENT_INDEX = (
    r"(?i)^(docs|documentation|learn|reference|guide|guides|api|manual|manuals|book|contents)$"
)
DOCS_LANDING_PATHS = [
    "/docs",
    "/docs/latest",
    "/documentation",
    "/documentation/master",
    "/learn",
    "/guide",
    "/guides",
    "/reference",
    "/api",
    "/doc",
    "/manual",
    "/manuals",
    "/fundamentals",
    "/contents.html",
]
LOCALIZED_LANDING_PATHS = [
    "/en/getting-started/",
    "/en/docs/",
    "/en/guides/",
    "/en/reference/",
]
PRIMARY_INDEX_FILE = r"(?i)\.(txt|xml)$"
LANGUAGE_INDEX = (
    r"(?i)/llms/(?:js|javascript|ts|typescript|python|py|dart|swift|kotlin|java|csharp|cs|go|ruby"
    r"|php|rust)\.txt$"
)
PROJECT_DOCS_PATH = (
    r"/(docs?|documentation|learn|reference|guide|guides|api|manual|manuals|book|contents|developer"
    r"|fundamentals|formatter|linter|analyzer)(/|$)"
)
CANDIDATE_FROM_RULES = [
    (r"/docs(/|$)", 40),
    (
        r"/(learn|guide|guides|reference|api|documentation|manuals?|contents|fundamentals|formatter"
        r"|linter|analyzer)(/|$)",
        30,
    ),
]
CANDIDATE_PATH_RULES = [
    (r"/docs?(/|$)", 35),
    (
        r"/(learn|guide|guides|reference|api|documentation|manuals?|contents|fundamentals|formatter"
        r"|linter|analyzer)(/|$)",
        30,
    ),
    (
        r"(?i)^/(docs?|documentation|learn|guide|guides|reference|api|manual|manuals|book|contents"
        r"|developer|tutorial|tutorials|formatter|linter|analyzer)/*$",
        120,
    ),
    (r"(?i)/contents\.html$", 80),
    (r"(?i)/\d+(?:\.\d+)?/(?:contents\.html)?$", 60),
    (r"(?i)/\d+(?:\.\d+)?/(?:library|reference|tutorial)/index\.html$", 45),
    (r"(?i)/sitemap/sitemap-index\.xml$", 60),
    (r"^/llms\.txt$", 120),
    (r"/llms\.txt$", 120),
    (r"/llms-full\.txt$", 100),
    (r"/docs/llms\.txt$", 90),
    (r"/docs/sitemap\.xml$", 100),
]
INDEX_FILE_KIND = r"(?i)(?:llms(?:-full)?\.txt|sitemap\.xml|contents\.html)$"
NESTED_SITEMAP = (
    r"(doc|docs|documentation|learn|guide|guides|api|reference|manual|manuals|book|contents|developer"
    r"|tutorial|runtime|framework|fundamentals|library|engine|cli|sdk|auth|authentication|database"
    r"|storage|realtime|functions?|ai|models?|providers?|embeddings?|vectors?|search)"
    r"|^/sitemap/sitemap-\d+\.xml$|^/[a-z]{2}(?:-[a-z]{2})?/sitemap\.xml$"
)
ENGLISH_SITEMAP = r"(?i)^/en(?:-[a-z]{2})?/sitemap\.xml$"
DOCS_SITEMAP = (
    r"(?i)(doc|docs|documentation|learn|guide|guides|api|reference|manual|manuals|book|contents"
    r"|developer|tutorial|runtime|framework|fundamentals|library|engine|cli|sdk|auth|authentication"
    r"|database|storage|realtime|functions?|formatter|linter|analyzer|ai|models?|providers?"
    r"|embeddings?|vectors?|search)"
)
LINKED_INDEX_RULES = [
    (r"full", 120),
    (r"(latest|current|stable|5x|v5|en)(?:[./-]|$)", 40),
    (r"(api|reference|guide|guides|middleware|resource)", 20),
    (r"-(zh|ja|ko|fr|de|es|it|pt|ru|tr|ar)(?:[-.]|$)", -40),
]
LINKED_TEXT_RULES = [(r"(?i)full", 60), (r"(?i)medium", 40), (r"(?i)small", -30)]
COMPACT_INDEX_PROLOGUE = [
    r"(?i)(^|\n)#{1,3}\s+(documentation|docs|guides|reference|api reference|products?|build|manage"
    r"|resources?)\b",
    r"(?i)/docs/(?:guides|reference|api|resources|start|getting-started)/",
    r"(?i)/docs/guides/[a-z0-9-]+\.md",
]
HEADING_INDEX_PATH = r"/(documentation|reference|manual|manuals|book|contents)(/|\.html|$)"
DOCS_SHAPED_ENTRY = (
    r"(?:^|[\s/-])(?:docs?|documentation|learn|guide|guides|api|reference|manual|tutorial|tutorials"
    r"|examples?|cookbook|runtime|deploy|cli|sdk|framework|fundamentals|concepts|components|commands"
    r"|configuration|extensions?|quickstart|install|installation|auth|authentication)(?:$|[\s/-])"
)

# Composite score of a discovered index.
INDEX_WEIGHTS = {"relevance": 250, "candidate": 8, "links": 3, "headings": 2, "counted": 800}
INDEX_STRONG = [(r"", 220, 0), (r"(?i)llms.*\.txt$", 120, 0), (r"(?i)sitemap.*\.xml$", 40, 0), (r"", 20, 20)]
BROAD_INDEX_LINKS = 500
MIN_RELEVANCE = 4

# == bodies ===================================================================================

HTML_PROLOGUE_CHARS = 4_096
SITEMAP_XML_START = r"^\s*<\?xml"
SITEMAP_ROOT_START = r"(?i)^\s*<(urlset|sitemapindex)\b"
HTML_START = r"(?i)^\s*(?:<!doctype html|<html\b)"
HTML_BODY_TAGS = r"(?i)<(?:head|body|main|nav|article|section)\b"
HTML_META_TAGS = r"(?i)<(?:title|meta|link|script)\b"
HTML_ANCHOR = r"(?i)<a\s[^>]*href="
HTML_ANCHOR_END = r"(?i)</a>"
HTML_HEADING = r"(?i)<h[1-6]\b"
CHROME_HEADING = r"(?i)^(copy|edit this page|on this page)$"

# == titles ===================================================================================

NAV_CHROME_PHRASE = r"(?i)\b(?:What To Read Next|Where To Go Next|Read Next|Next Steps?)\b\s*"
SETUP_SLUG = r"^(getting-started|quickstart|quick-start|installation|setup)$"
SETUP_TITLE = r"(?i)getting started|quickstart|quick start|installation|setup"
CONTENTS_TITLE = r"^(?:table of contents|contents)$"
READ_NEXT_TITLE = (
    r"^(?:what to read next|where to go next|read next|next steps?"
    r"|related(?: pages?| resources?| links?)?)$"
)
PAGE_CHROME_TITLE = (
    r"^(?:previous|next|on this page|in this article|feedback|was this helpful|edit this page)$"
)
ENTRY_CHROME_TITLE = (
    r"^(anchor|edit|here|this guide|thumbs? up(?: icon)?|thumbs? down(?: icon)?|copy|view source"
    r"|source|github)$"
)
COMMAND_HEADING = (
    r"(?i)^(?:[$>]|(?:npm|pnpm|yarn|bun|npx|pip|python|node|cargo|go|docker|kubectl|curl|cd)\b)"
)
CODE_HEADING = (
    r"(?i)^(?:const|let|var|import|export|return|await|async|function|class|type|interface)\b"
)
SYNTAX_HEADING = r"[{};]|\s=>\s|=\w|={2,}"
LEGAL_HEADING = (
    r"(?i)^(license|licenses|authors?|contributors?|acknowledgements?|thanks|sponsors?|support|badge"
    r"|badges|status|copyright)$"
)
TOPIC_CHROME = (
    r"(?i)^(what to read next|where to go next|read next|next steps?"
    r"|related(?: pages?| resources?| links?)?|on this page|in this article)$"
)
TOPIC_BLOG = r"(?i)^(blog|blog posts?|blog tags?|core pages?|pages?|tags?)$"
TOPIC_TOO_GENERIC = r"(?i)^(API|Apis|Docs|Documentation|Learn|Overview|Reference)$"
COVERAGE_TOO_GENERIC = r"(?i)^(Documentation|Docs|Overview|Reference|API|Apis|Learn)$"
TOPIC_SKIPPED_SEGMENT = r"(?i)^(docs?|documentation|app|pages|en|latest|current|stable)$"
TOPIC_VERSION_SEGMENT = r"(?i)^(?:v?\d+(?:\.\d+)*)$"
TOPIC_SEGMENT = (
    r"(?i)^(learn|getting-started|quickstart|guide|guides|api-reference|api|reference|hooks"
    r"|components|functions|configuration|config|cli|architecture|examples|cookbook|migration|upgrade"
    r"|troubleshooting|testing|deployment|deploying|routing|caching|rendering|data-fetching"
    r"|file-system-conventions|directives|compiler|auth|authentication|database|databases|storage"
    r"|realtime|edge-functions|vector|vectors|embeddings|embedding|ai|models|model|providers|provider"
    r"|agents|agent|tools|tool|skills|skill|channels|channel|connections|connection|mcp|openapi"
    r"|open-api|sandbox|subagents|subagent|schedules|schedule|evals|eval|sessions|session|streaming"
    r"|instructions|instruction|inference|search)$"
)
GENERIC_TITLE = (
    r"(?i)^(adapters?|agents?|api|apis|architecture|auth|authentication|best practices|cli|commands?"
    r"|components?|concepts?|config|configuration|database|databases|directives?|docs?|documentation"
    r"|edge functions?|embeddings?|errors?|examples?|faq|foundations?|functions?|fundamentals?"
    r"|getting started|guides?|hooks?|installation|integrations?|introduction|limits?|lints?|models?"
    r"|options?|overview|pricing|providers?|quick start|quickstart|realtime|reference|resources?"
    r"|routes?|routing|schemas?|search|security|setup|storage|tools?|troubleshooting|tutorials?"
    r"|types?|vectors?)$"
)
ALLOWED_DUPLICATE_TITLE = (
    r"^(api|apis|architecture|components?|concepts?|directives|errors?|examples?|faq|fundamentals?"
    r"|guides?|hooks?|limits?|overview|pricing|reference|resources?|security|troubleshooting)$"
)

# == pages ====================================================================================

NARROW_SLUGS = [
    r"^reference-api-v\d+(?:-[a-z0-9]+){2,}$",
    r"^(?:react|react-dom|eslint-plugin-react-hooks|legacy-apis|rules-of-react|react-compiler)-"
    r"(?:components?|hooks?|apis?|client-apis|server-apis|static-apis|directives|configuration|lints?)"
    r"(?:$|-[a-z0-9])",
]
NARROW_TEXT = (
    r"\b(examples?|cookbook|recipe|quickstart|starter|template|troubleshoot|troubleshooting|migration"
    r"|upgrade|integration|adapter|provider|model|embedding|vector|search|client|sdk|framework|library"
    r"|astrojs|nextjs|nuxt|sveltekit|flutter|swift|kotlin|python|javascript|typescript|beeke?eper"
    r"|studio)\b"
)
BROAD_TEXT = (
    r"\b(architecture|concepts?|reference|api reference|getting started|installation|configuration"
    r"|security|auth|authentication|database|storage|realtime|routing|rendering|compiler"
    r"|server components?)\b"
)
BROAD_SECTION_TEXT = (
    r"\b(architecture|concepts?|fundamentals?|getting started|installation|overview|reference"
    r"|api reference|configuration|security|auth|authentication|database|storage|realtime|routing"
    r"|rendering|compiler|server components?)\b"
)
SPECIALISED_TEXT = (
    r"\b(custom[- ]renderers?|reconciler|host[- ]config|repository[- ]development|devtools[- ]core"
    r"|inline[- ]devtools|native[- ]style[- ]editor)\b"
)
FOCUSED_API_SLUG = (
    r"^react-(?:act|cache|create-context|fragment|lazy|memo|profiler|start-transition|strict-mode"
    r"|suspense|use)$"
)
FOCUSED_API_TEXT = (
    r"\b(streaming[- ]rendering|server[- ]streaming|resume[- ]and[- ]prerender"
    r"|react[- ]dom[- ]server[- ]apis?|react[- ]dom[- ]static[- ]apis?)\b"
)
PRIMITIVE_TEXT = (
    r"\b(instructions?|skills?|channels?|connections?|mcp|openapi|open api|sandbox|subagents?"
    r"|schedules?|evals?|sessions?|streaming|continuations?|client|sdk|hooks?|approvals?)\b"
)
IMPORTANT_PRIMITIVE_TEXT = (
    r"\b(instructions?|skills?|connections?|mcp|openapi|open api|sandbox|subagents?|schedules?|evals?"
    r"|sessions?|streaming|continuations?|client|sdk|approvals?)\b"
)
JOURNEY_TEXT = (
    r"\b(getting[- ]started|quick[- ]?start|first[- ]agent|tutorial|installation|setup|workflow)\b"
)
REFERENCE_TEXT = (
    r"(?i)(api|reference|configuration|config|option|command|route|hook|schema|type|endpoint)"
)
GUIDE_TEXT = (
    r"(?i)(getting started|quickstart|setup|install|guide|workflow|usage|tutorial|example|cookbook"
    r"|recipe|migration|upgrade|troubleshoot|troubleshooting)"
)
PLANNING_TEXT = (
    r"\b(ai sdk quality runs?|quality runs?|dx feedback|feedback deep dive|open source deepwiki"
    r"|deepwiki|research plan|implementation plan|indexing and workflow plan|auto update plan"
    r"|harness gaps?|quality follow-?up|completed plans?|active plans?|gap analysis|porting notes?"
    r"|benchmark harness|scratchpad|todo)\b"
)
INTERNAL_PROJECT_TEXT = (
    r"\b(rust[-\s]?port|porting notes?|gap analysis|orchestrator log|research notes?"
    r"|implementation log|benchmark harness|scratchpad|todo)\b|\b(oxc|orchestrator)\b"
)
OVERVIEW_TITLES = ["overview", "introduction", "repository-overview", "project-overview"]
SECTION_TOPIC_TOO_GENERIC = (
    r"^(docs?|documentation|project|repository|source|official|guide|guides|reference)$"
)

GENERATED_ENTRY_URL = r"(?i)/(?:generated|autoapi|autodoc|api-docs)/"
GENERATED_ENTRY_TEXT = r"(?i)\b(auto[-\s]?generated|generated reference|generated api|api docs)\b"
LOW_LEVEL_TITLE = (
    r"^(?:[A-Za-z_$][\w$]*\.){2,}[A-Za-z_$][\w$]*(?:\(\))?$"
    r"|^(?i:torch|tensorflow|tf|numpy|jax|sklearn|pandas|keras|scipy|matplotlib)\.[\w.]+(?:\(\))?$"
)
WIDE_TITLE_WORDS = (
    r"(getting-started|quickstart|overview|guide|tutorial|concept|configuration|examples"
    r"|troubleshooting|migration)"
)

# == page budgets =============================================================================
# Each ladder lists (lower bound, value), first match from the top.

MAX_PAGE_BASELINE = [(2_000, 36), (500, 24), (50, 12), (25, 5), (0, 4)]
MIN_PAGE_BASELINE = [(2_000, 18), (500, 14), (50, 6), (0, 3)]
MAX_PAGES_BY_LINKS = [(700, 100), (450, 90), (260, 80), (160, 72), (90, 60), (60, 48), (30, 28)]
MIN_PAGES_BY_LINKS = [(700, 80), (450, 72), (260, 64), (160, 56), (90, 48), (60, 38), (30, 20)]
MAX_PAGES_BY_DOCS = [
    (700, 100),
    (450, 90),
    (300, 80),
    (180, 72),
    (100, 60),
    (60, 48),
    (30, 28),
    (12, 14),
]
MIN_PAGES_BY_DOCS = [
    (700, 80),
    (450, 72),
    (300, 64),
    (180, 56),
    (100, 48),
    (60, 36),
    (30, 20),
    (12, 10),
]
WORD_BASELINE = [(500, 650), (50, 575), (25, 500), (0, 450)]
WORDS_BY_LINKS = [(120, 1_050), (60, 1_000)]
WORDS_BY_DOCS = [(100, 1_000), (60, 850), (30, 750), (12, 700)]
# Minimum words per kind of page, for the first evidence tier that applies:
# (tier, tiny, journey, primitive, focused, specialised, broad, narrow, normal)
PAGE_WORDS_BY_TIER = [
    ("links", 120, 450, 600, 500, 550, 550, 800, 575, 700),
    ("links", 60, 450, 575, 500, 525, 525, 775, 550, 675),
    ("docs", 100, 450, 575, 500, 550, 550, 775, 550, 675),
    ("docs", 60, 450, 550, 500, 525, 525, 750, 525, 650),
]

# == coverage =================================================================================

EVIDENCE_FAMILIES = [
    (
        "getting-started/tutorial",
        2,
        r"(?i)(getting started|quick start|quickstart|installation|install|setup|tutorial|first app"
        r"|start)",
        r"(?i)(getting started|quickstart|quick start|installation|install|setup|tutorial|first app"
        r"|start)",
    ),
    (
        "concepts/learning",
        6,
        r"(?i)(learn|concept|foundation|architecture|mental model|component|state|effect|render"
        r"|routing|caching|data fetching|compiler)",
        r"(?i)(learn|concept|foundation|architecture|mental model|component|state|effect|render"
        r"|routing|caching|data|compiler)",
    ),
    (
        "guides/workflows",
        5,
        r"(?i)(guide|workflow|how to|usage|pattern|auth|authentication|form|testing|deploy|production"
        r"|debug|integration|migration|upgrade)",
        r"(?i)(guide|workflow|how to|usage|pattern|auth|authentication|form|testing|deploy|production"
        r"|debug|integration|migration|upgrade)",
    ),
    (
        "API/reference",
        5,
        r"(?i)(api|reference|hook|hooks|component|function|directive|config|configuration|command|cli"
        r"|file-system|option|prop|method|schema|type)",
        r"(?i)(api|reference|hook|hooks|component|function|directive|config|configuration|command|cli"
        r"|file-system|option|prop|method|schema|type)",
    ),
    (
        "examples/troubleshooting/migration",
        3,
        r"(?i)(example|cookbook|recipe|troubleshoot|troubleshooting|debug|error|migration|upgrade|faq)",
        r"(?i)(example|cookbook|recipe|troubleshoot|troubleshooting|debug|error|migration|upgrade|faq)",
    ),
    (
        "AI/data platform surfaces",
        4,
        r"(?i)(agent|agents|ai|model|models|provider|providers|inference|embedding|embeddings|vector"
        r"|vectors|search|database|storage|auth|authentication|realtime|edge function|edge functions)",
        r"(?i)(agent|agents|ai|model|models|provider|providers|inference|embedding|embeddings|vector"
        r"|vectors|search|database|storage|auth|authentication|realtime|edge function|edge functions)",
    ),
    (
        "agent framework primitives",
        4,
        r"(?i)(instructions?|tools?|skills?|channels?|connections?|mcp|openapi|open api|sandbox"
        r"|subagents?|schedules?|evals?|sessions?|streaming|hooks?|agent config|configuration)",
        r"(?i)(instructions?|tools?|skills?|channels?|connections?|mcp|openapi|open api|sandbox"
        r"|subagents?|schedules?|evals?|sessions?|streaming|hooks?|agent config|configuration)",
    ),
]
# Families of an agent framework: present as soon as one entry matches.
PRIMITIVE_FAMILIES = [
    ("instructions", r"(?i)\binstructions?\b", r"(?i)\binstructions?\b"),
    (
        "agent configuration",
        r"(?i)\bagent[-\s]?config(?:uration)?\b|\bdefineagent\b|\bruntime config(?:uration)?\b",
        r"(?i)\bagent[-\s]?config(?:uration)?\b|\bruntime config(?:uration)?\b|\bdefineagent\b",
    ),
    (
        "tools and approvals",
        r"(?i)\btools?\b|\bdefineTool\b|\bhuman[-\s]?in[-\s]?the[-\s]?loop\b|\bapproval\b",
        r"(?i)\btools?\b|\bapproval\b|\bhuman[-\s]?in[-\s]?the[-\s]?loop\b",
    ),
    ("skills", r"(?i)\bskills?\b", r"(?i)\bskills?\b"),
    (
        "channels",
        r"(?i)\bchannels?\b|\bslack\b|\bdiscord\b|\bteams\b|\btelegram\b|\btwilio\b|\bgithub\b"
        r"|\blinear\b",
        r"(?i)\bchannels?\b|\bslack\b|\bdiscord\b|\bteams\b|\btelegram\b|\btwilio\b|\bgithub\b"
        r"|\blinear\b",
    ),
    (
        "connections, MCP, and OpenAPI",
        r"(?i)\bconnections?\b|\bmcp\b|\bopenapi\b|\bopen api\b|\boauth\b|\bvercel connect\b",
        r"(?i)\bconnections?\b|\bmcp\b|\bopenapi\b|\bopen api\b|\boauth\b|\bvercel connect\b",
    ),
    ("sandbox", r"(?i)\bsandbox\b|\bsandboxes\b", r"(?i)\bsandbox\b|\bsandboxes\b"),
    ("subagents", r"(?i)\bsubagents?\b|\bdelegat(?:e|ion)\b", r"(?i)\bsubagents?\b|\bdelegat(?:e|ion)\b"),
    ("schedules", r"(?i)\bschedules?\b|\bcron\b|\brecurring\b", r"(?i)\bschedules?\b|\bcron\b|\brecurring\b"),
    (
        "evals",
        r"(?i)\bevals?\b|\bevaluations?\b|\bjudges?\b|\bassertions?\b|\breporters?\b",
        r"(?i)\bevals?\b|\bevaluations?\b|\bjudges?\b|\bassertions?\b|\breporters?\b",
    ),
    (
        "sessions and streaming",
        r"(?i)\bsessions?\b|\bstreaming\b|\bcontinuations?\b|\bmessages?\b|\bruns?\b",
        r"(?i)\bsessions?\b|\bstreaming\b|\bcontinuations?\b|\bmessages?\b|\bruns?\b",
    ),
    (
        "frontend and client integrations",
        r"(?i)\bfrontend\b|\bclient\b|\bnextjs\b|\bnuxt\b|\bsveltekit\b|\bvue\b",
        r"(?i)\bfrontend\b|\bclient\b|\bnextjs\b|\bnuxt\b|\bsveltekit\b|\bvue\b",
    ),
    (
        "hooks and instrumentation",
        r"(?i)\bhooks?\b|\binstrumentation\b|\blifecycle\b",
        r"(?i)\bhooks?\b|\binstrumentation\b|\blifecycle\b",
    ),
    (
        "deployment and auth",
        r"(?i)\bdeployment\b|\bdeploy\b|\bproduction\b|\broute protection\b|\bauth\b"
        r"|\bauthentication\b",
        r"(?i)\bdeployment\b|\bdeploy\b|\bproduction\b|\broute protection\b|\bauth\b"
        r"|\bauthentication\b",
    ),
    (
        "CLI and commands",
        r"(?i)\bcli\b|\bcommands?\b|\bslash commands?\b|\bdev tui\b",
        r"(?i)\bcli\b|\bcommands?\b|\bslash commands?\b|\bdev tui\b",
    ),
]
JOURNEY_GROUPS = [
    r"(overview|introduction|what|why)",
    r"(getting started|quickstart|setup|install|start)",
    r"(concept|architecture|foundation|model)",
    r"(guide|workflow|usage|tutorial|quickstart|quick start|pattern|integration|cookbook|example)",
    r"(api|reference|surface|command|configuration|option)",
]
SPINE_GROUPS = [
    r"(overview|introduction|what|why)",
    r"(getting started|quickstart|setup|install|start)",
    r"(concept|foundation|architecture|model|mental model)",
    r"(guide|workflow|usage|tutorial|quickstart|quick start|pattern|integration)",
    r"(api|reference|configuration|config|option|command|route|hook|provider)",
    r"(example|cookbook|recipe|migration|upgrade|troubleshoot|troubleshooting|error|faq)",
]
CATALOGUE_TEXT = (
    r"(?i)(adapter|provider|plugin|integration|package|module|service|component|crate)s?\b"
)
READER_TEXT = (
    r"(?i)(getting started|quickstart|setup|install|guide|tutorial|usage|workflow|example|cookbook"
    r"|api|reference|configuration|option|troubleshoot|troubleshooting|error|faq|migration|upgrade)"
)
SETUP_LEAF_PATTERNS = [
    r"\bbuild[-\s].*from[-\s]scratch\b",
    r"\badd[-\s].*existing[-\s]project\b",
    r"\binstallation\b",
    r"\beditor[-\s]setup\b",
    r"\btypescript\b",
]
SETUP_LANDING_SLUG = r"^(?:creating|create)-a-[a-z0-9-]*app$"
SETUP_LANDING_TEXT = r"\bcreating[-\s]a[-\s][a-z0-9-]*[-\s]?app\b"

OUTLINE_ENTRY_RULES = [
    (r"(?i)(overview|introduction|what is|why|fundamentals?)", 115),
    (
        r"(?i)(getting started|quick start|quickstart|installation|setup|tutorial|first app|start here)",
        110,
    ),
    (
        r"(?i)(learn|concept|foundation|architecture|mental model|component|state|effect|render"
        r"|routing|caching|data fetching|compiler)",
        90,
    ),
    (
        r"(?i)(guide|workflow|usage|how to|integration|deploy|testing|migration|upgrade|production"
        r"|debug)",
        82,
    ),
    (r"(?i)(example|cookbook|recipe|troubleshoot|troubleshooting|error|faq)", 72),
    (
        r"(?i)(api|reference|hooks?|components?|configuration|config|command|cli|file system|function"
        r"|method|option|schema|type)",
        58,
    ),
    (
        r"(?i)(ai|agent|models?|providers?|embeddings?|vectors?|search|database|storage|auth"
        r"|authentication|realtime|edge functions?)",
        66,
    ),
]
OUTLINE_ENTRY_URL_RULES = [
    (
        r"(?i)/(learn|docs|guide|guides|tutorial|tutorials|concepts?|fundamentals?|getting-started"
        r"|quickstart)(/|$)",
        34,
    ),
    (r"(?i)/(examples?|cookbook|recipes?|troubleshooting|migration|upgrade)(/|$)", 22),
    (r"(?i)/(api|reference)(/|$)", 10),
]
OUTLINE_ENTRY_PENALTIES = {"generated": -115, "low_level": -38, "narrow_member": -28}
OUTLINE_GROUP_RULES = [
    (r"(?i)(getting started|quick start|quickstart|installation|setup|tutorial|learn)", 90),
    (r"(?i)(concept|architecture|state|effect|component|routing|render|caching)", 70),
    (r"(?i)(guide|workflow|usage|how to|integration|deploy|testing|migration)", 65),
    (
        r"(?i)(api|reference|hooks?|components?|configuration|command|cli|file system|function)",
        55,
    ),
    (
        r"(?i)(ai|agent|models?|providers?|embeddings?|vectors?|search|database|storage|auth"
        r"|authentication|realtime|edge functions?)",
        58,
    ),
    (r"(?i)(example|cookbook|troubleshoot|error|faq)", 45),
]

# == page snippets ============================================================================

REFERENCE_PAGE_TEXT = (
    r"(?i)\b(api|reference|config|configuration|option|directive|function|component|file|cli|command)\b"
)
GUIDE_GROUP_TEXT = r"(gettingstarted|learn|guide|guides|concept|concepts|tutorial|quickstart|quickstarts)"
INTRO_TITLE_TEXT = r"overview|introduction|gettingstarted|quickstart"
GUIDE_PAGE_URL_RULES = [
    (r"/learn/", 14),
    (r"/api-reference/config/", -24),
    (r"/api-reference/", -8),
    (r"/reference/rules/", -120),
    (r"/reference/eslint-plugin-react-hooks/", -120),
]
START_PAGE_TEXT = r"(?i)\b(getting[- ]started|quickstart|quick[- ]start|installation|setup)\b"
SUPPLEMENTS = [
    (r"(?i)(introduction|overview|project[- ]layout|agent[- ]config)", True),
    (r"(?i)(connections?|mcp|openapi|open api)", True),
    (r"(?i)(tools?|skills?|channels?|sandbox|subagents?|schedules?)", False),
]

# == source path matching =====================================================================
class SurfaceRule(NamedTuple):
    """Terms any of which must be asked for (or all of one of ``all_of``), path words any of which must be present, and the weight."""

    any_of: tuple[str, ...]
    path_words: tuple[str, ...]
    weight: int
    all_of: tuple[tuple[str, ...], ...] = ()


SURFACE_RULES = [
    SurfaceRule(("route", "routing", "router"), ("route", "routes", "router", "routing"), 44),
    SurfaceRule(
        ("cache", "caching", "revalidate", "revalidation"),
        ("cache", "caching", "revalidate", "revalidation"),
        44,
    ),
    SurfaceRule(
        ("auth", "authentication", "authorization"),
        ("auth", "authentication", "authorization", "oauth", "session", "sessions"),
        42,
    ),
    SurfaceRule(("form", "forms"), ("form", "forms", "action", "actions"), 34),
    SurfaceRule(("image", "images"), ("image", "images", "img", "media"), 38),
    SurfaceRule(("font", "fonts"), ("font", "fonts", "typography"), 34),
    SurfaceRule(
        ("metadata", "opengraph"),
        ("metadata", "opengraph", "og", "head", "seo"),
        36,
        all_of=(("open", "graph"),),
    ),
    SurfaceRule(("proxy", "middleware"), ("proxy", "middleware", "interceptor", "interceptors"), 42),
    SurfaceRule(
        ("config", "configuration", "options"),
        ("config", "configuration", "options", "settings"),
        44,
    ),
    SurfaceRule(("cli", "command", "commands"), ("cli", "command", "commands", "bin"), 46),
    SurfaceRule(("adapter", "adapters"), ("adapter", "adapters", "runtime", "runtimes"), 42),
    SurfaceRule(("directive", "directives"), ("directive", "directives", "server", "client"), 36),
    SurfaceRule(("function", "functions"), ("function", "functions", "api", "server"), 26),
    SurfaceRule(("component", "components"), ("component", "components", "ui"), 30),
    SurfaceRule(("hook", "hooks"), ("hook", "hooks"), 34),
    SurfaceRule(("schema", "type", "types"), ("schema", "schemas", "type", "types", "typings"), 34),
    SurfaceRule(
        ("database", "db", "postgres", "sql"),
        ("database", "databases", "db", "postgres", "sql", "storage"),
        38,
    ),
    SurfaceRule(("storage", "bucket", "buckets"), ("storage", "bucket", "buckets", "blob", "files"), 36),
    SurfaceRule(
        ("realtime", "websocket", "websockets"),
        ("realtime", "websocket", "websockets", "channel", "channels", "subscription", "subscriptions"),
        38,
    ),
    SurfaceRule(
        ("vector", "embedding", "embeddings", "search"),
        ("vector", "vectors", "embedding", "embeddings", "search", "retrieval", "index", "indexes"),
        40,
    ),
    SurfaceRule(
        ("model", "models", "provider", "providers"),
        ("model", "models", "provider", "providers", "inference", "generate", "generation"),
        38,
    ),
    SurfaceRule(
        ("agent", "agents", "tool", "tools"),
        ("agent", "agents", "tool", "tools", "workflow", "workflows"),
        38,
    ),
    SurfaceRule(
        ("example", "examples", "cookbook", "recipe", "recipes", "template", "templates", "demo", "demos"),
        ("example", "examples", "demo", "demos", "template", "templates", "cookbook", "recipe", "recipes"),
        42,
    ),
    SurfaceRule(
        (
            "example", "examples", "cookbook", "recipe", "recipes", "template", "templates", "demo",
            "demos", "test", "tests", "testing", "spec", "specs", "cypress", "jest", "playwright", "vitest",
        ),
        ("test", "tests", "testing", "spec", "specs", "fixture", "fixtures"),
        42,
    ),
    SurfaceRule(
        ("migration", "migrate", "upgrade", "upgrading"),
        ("migration", "migrations", "migrate", "upgrade", "upgrading", "codemod", "codemods"),
        40,
    ),
    SurfaceRule(
        ("troubleshoot", "troubleshooting", "debug", "debugging", "error", "errors"),
        (
            "troubleshoot", "troubleshooting", "debug", "debugging", "error", "errors", "diagnostic",
            "diagnostics",
        ),
        36,
    ),
]
SURFACE_DOCS_BONUS = 18
EXAMPLE_TERMS = [
    "example", "examples", "cookbook", "recipe", "recipes", "template", "templates", "demo", "demos",
]
TEST_TERMS = ["test", "tests", "testing", "spec", "specs", "cypress", "jest", "playwright", "vitest"]
TOOLING_TERMS = [
    "ci", "workflow", "workflows", "release", "deploy", "deployment", "publish", "publishing", "build",
    "bundling", "rollup", "npm", "yarn", "actions",
]
CI_TERMS = ["ci", "workflow", "workflows", "release", "deploy", "actions"]
BENCH_TERMS = ["bench", "benchmark", "performance", "eval", "evals"]
LINT_TERMS = ["eslint", "lint", "lints"]
ALWAYS_TERMS = r"^(api|apis|components?|configuration|directives|hooks?|lints?|overview)$"
# Terms added when the entry text matches.
ADDED_TERMS = [
    (r"(?i)\breact[-\s]+compiler\b", "compiler"),
    (r"(?i)/file-conventions/page(?:[./?#]|$)", "page"),
    (r"(?i)/file-conventions/layout(?:[./?#]|$)", "layout"),
    (r"(?i)/file-conventions/route(?:[./?#]|$)", "route"),
]
PATH_BOOSTS = [
    (DOCS_CONTENT_PATH, 52),
    (r"(?i)^apps/docs/content/(guides|reference|resources)/", 18),
    (r"(?i)^apps/docs/content/_partials/", -28),
    (r"(?i)^apps/docs/app/", 10),
    (r"(?i)^\.agents/", -80),
    (r"(?i)^readme(\.mdx?)?$", 12),
    (r"(?i)(^|/)package\.json$", 5),
    (r"(?i)(^|/)(index|main|mod|lib)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$", 10),
    (
        r"(?i)(^|/)(api|client|server|config|options|schema|types|hooks?|components?)"
        r"\.(ts|tsx|js|jsx|mjs|cjs)$",
        12,
    ),
    (r"(?i)(^|/)\.(claude|cursor)/", -80),
    (r"(?i)(^|/)(dist|build|coverage|vendor|vendored|compiled)(/|$)", -20),
]
# (path pattern, terms that make it wanted, weight if wanted, weight if not)
PATH_BOOSTS_BY_TERM = [
    (r"(?i)^\.github/", CI_TERMS, 8, -64),
    (
        r"(?i)^(scripts|tasks)/(release|ci|deploy|publish|npm|yarn|github|workflow|workflows|rollup"
        r"|build)/",
        TOOLING_TERMS,
        8,
        -72,
    ),
    (
        r"(?i)(^|/)(bench|benchmark|benchmarks|evals)(/|$)|turbopack-bench",
        BENCH_TERMS,
        8,
        -56,
    ),
    (
        r"(?i)(^|/)(test|tests|__tests__|fixtures|__fixtures__|testdata)(/|$)",
        EXAMPLE_TERMS + TEST_TERMS,
        14,
        -16,
    ),
    (r"(?i)(^|/)(playground|examples?|demo|demos)(/|$)", EXAMPLE_TERMS, 18, -30),
]
LINT_PATH = r"(^|/|[-_.])(eslint|lint|lints)($|/|[-_.])"
LINT_RULE_PATH = r"(^|/|[-_.])rules?($|/|[-_.])"
SIDE_PATHS = {
    "client": r"(^|/|[-_.])client($|/|[-_.])",
    "server": r"(^|/|[-_.])server($|/|[-_.])",
    "static": r"(^|/|[-_.])static($|/|[-_.])",
}
FOUNDATION_PATH = (
    r"^(readme(\.mdx?)?|package\.json|pnpm-workspace\.yaml|turbo\.json|lerna\.json|cargo\.toml)$"
)

# == drafts ===================================================================================

SOURCE_SECTION = r"(?im)^##\s+Relevant Source Files\b"
SOURCES_LINE = r"(?i)Sources:"
COMMAND_LINE = (
    r"(?i)(^|\n)\s*(pnpm|npm|yarn|bun|cargo|rustup|npx|node|git|curl|vercel)\s+"
)
NUMBERED_LINE = r"(?m)^\s*\d+\.\s+"
GUIDE_WORDS = r"(?i)(example|sample|workflow|step|terminal|command|configuration|config)"
# Paths that only belong on pages about them: (page text, slug the rule is limited to, path).
FORBIDDEN_PATHS = [
    (
        r"(?:^|-)(?:eslint|lint|lints|rules-of-hooks|exhaustive-deps|component-hook-factories)(?:-|$)",
        None,
        r"packages/eslint-plugin-react-hooks/[A-Za-z0-9_./-]+",
    ),
    (
        r"(?:^|-)(?:test|tests|testing|act)(?:-|$)",
        None,
        r"(?:packages/)?dom-event-testing-library/[A-Za-z0-9_./-]+",
    ),
    (
        r"(?:server|render-to-|render|resume|prerender)",
        r"(?i)^react-dom-apis-[a-z0-9-]+$",
        r"packages/react-dom/(?:npm/)?server\.js",
    ),
    (
        r"(?:client|create-root|hydrate-root|flush-sync)",
        r"(?i)^react-dom-apis-[a-z0-9-]+$",
        r"packages/react-dom/(?:npm/)?client\.js",
    ),
]

# A part of every match of each of these paths.
FORBIDDEN_MARKS = ["packages/eslint-plugin-react-hooks/", "dom-event-testing-library/", "packages/react-dom/", "packages/react-dom/"]

# == citations ================================================================================

_CITED = (
    r"ts|tsx|js|jsx|mjs|cjs|mts|cts|py|go|rs|md|mdx|json|yaml|yml|toml|css|scss|html|sh|sql|lock"
)
CITED_EXTENSION = rf"(?i)\.(?:{_CITED})$"
CODE_SPAN = r"`([^`\n]+)`"
MARKDOWN_LINK = r"\[([^\]\n]+)\]\(([^)\s]+)\)"
REPO_FILE_URL = r"(?i)https://github\.com/[^\s)`]+"
BARE_PATH = (
    r"(?i)(?:^|[\s({\"'>])((?!https?://|//)(?:\.{1,2}/|/)?[A-Za-z0-9_@~+-]"
    rf"[A-Za-z0-9_@()\[\]./+~-]*\.(?:{_CITED})(?:#L\d+(?:-L?\d+)?|:\d+(?::\d+)?)?)"
    r"(?=$|[\s)\]},.;!?\"'<])"
)
MAX_CITATIONS_PER_MESSAGE = 12

IMAGE_OR_PAGE_PATH = r"^[A-Za-z0-9][A-Za-z0-9._~/-]*(#[A-Za-z0-9._~-]+)?$"

# == jobs and events ==========================================================================

TURN_BOUNDARIES = [
    "authorization.required",
    "session.completed",
    "session.failed",
    "session.waiting",
    "turn.failed",
]
RUN_BOUNDARIES = ["turn.completed", "session.waiting", "session.completed"]
UNFINISHED_STATUSES = ["pending", "running"]
