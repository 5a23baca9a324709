"""Library-shaped inputs derived from the given tables.

The derivations are plain row-wise SELECTs in SQL that Spark and DuckDB both read, so a query and its
check start from the same rows. Everything grows with the tables it comes from: a repository is fifty
documents, an attempt or a job event is an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(expr: str, values: list[str | None]) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE CAST(({expr}) % {len(values)} AS INT) {cases} END"


_K = "CAST(floor(doc_id / 20) AS BIGINT)"
_REPO = f"source || '-' || CAST(CAST(floor({_K} / 50) AS BIGINT) AS STRING)"
_POS = f"CAST({_K} % 50 AS INT)"

_DIRS = [
    "docs/guides",
    "docs",
    "src",
    "packages/core/src",
    "content/docs/api",
    "test",
    "examples/basic",
    "",
    "packages/router",
    "apps/web/src/app/docs",
    "docs/plans",
    ".github/workflows",
    "lib/dist",
    "scripts/release",
    "server/routes",
    "website/docs/03-reference",
    "crates/engine/src",
]
_FILES = [
    "README.md",
    "index.ts",
    "package.json",
    "getting-started.mdx",
    "api-reference.md",
    "config.yaml",
    "main.go",
    "client.tsx",
    "LICENSE",
    "yarn.lock",
    "page.tsx",
    "03-installation.rst",
    "route_cache.py",
]
_DIR = pick("pos", _DIRS)
_FILE = pick("pos * 5 + CAST(floor(pos / 17) AS INT)", _FILES)
TITLES = [
    "Getting Started",
    "Installation",
    "API Reference",
    "Routing",
    "Data Fetching",
    "Caching",
    "Authentication",
    "Overview",
    "Configuration",
    "CLI",
    "Components",
    "Hooks",
    "Error Handling",
    "Testing Library",
    "Deployment",
    "Server Components",
    "useState",
    "Streaming",
    "Guides",
    "Troubleshooting",
    "Migration Guide",
    "Examples",
    "createRoot",
    "Edge Functions",
    "Vector Search",
]
_GROUPS = [
    "Getting Started",
    "Guides / Routing",
    "API Reference / Components",
    None,
    "Docs / Reference / Hooks",
    "Advanced Server Rendering Concepts Guides Examples / Patterns",
    "Learn",
]
_SECTIONS = ["guides", "reference", "learn", "api", "reference/react-dom", "concepts", "docs/auth"]
_HOSTS = ["docs.acme.dev", "acme.dev", "www.acme.dev", "learn.other.org"]

SQL: dict[str, tuple[str, str]] = {
    # name: (source relation, select list)
    "doc": (
        "documents",
        f"doc_id, {_REPO} AS repo_id, {_POS} AS pos, text, lang, source, n_chars",
    ),
    "tree": (
        "doc",
        f"repo_id, pos, n_chars * 40 AS size, doc_id,"
        f" CASE WHEN {_DIR} = '' THEN {_FILE} ELSE {_DIR} || '/' || {_FILE} END AS path",
    ),
    "entries": (
        "doc",
        "repo_id, pos,"
        f" {pick('pos', _GROUPS)} AS \"group\","
        f" {pick('pos', TITLES)} || CASE WHEN pos >= 25 THEN ' Basics' ELSE '' END AS title,"
        f" 'https://' || {pick('pos', _HOSTS)} || '/docs/' || {pick('pos', _SECTIONS)} || '/' ||"
        f" replace(lower({pick('pos', TITLES)}), ' ', '-') || CASE WHEN pos >= 25 THEN '-basics' ELSE '' END"
        " AS url,"
        " 'https://docs.acme.dev/llms.txt' AS source_url",
    ),
    "outline": (
        "doc",
        "repo_id, pos,"
        f" CASE WHEN pos % 9 = 4 THEN 'guides-' WHEN pos % 9 = 7 THEN 'react-dom-' ELSE '' END ||"
        f" replace(lower({pick('pos * 7 + 7', TITLES)}), ' ', '-') || CASE WHEN pos >= 45 THEN '-2' ELSE '' END AS slug,"
        f" {pick('pos * 7 + 7', TITLES)} AS title,"
        f" 'Explain ' || lower({pick('pos * 3', TITLES)}) || ' for ' || lang || ' readers' AS purpose,"
        " CASE pos % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' ELSE 'optional' END AS priority,"
        f" {_DIR} || '/' || {_FILE} AS source_path, doc_id, text",
    ),
    "attempts": (
        "events",
        "event_id AS attempt_id, CAST(user_id AS STRING) AS client_key,"
        " event_type || '/' || CAST(user_id % 7 AS STRING) AS repo_full_name, ts AS created_at",
    ),
    "repos": (
        "customer",
        "CAST(c_custkey AS STRING) AS repo_id, 'github' AS provider, lower(c_mktsegment) AS owner,"
        " c_name AS name, lower(c_mktsegment) || '/' || c_name AS full_name,"
        " c_custkey % 5 = 0 AS is_featured, c_custkey, c_acctbal",
    ),
}


def cte(*names: str) -> str:
    """WITH clause for DuckDB defining the named inputs (and what they build on)."""
    parts, seen = [], set()

    def add(name: str) -> None:
        if name in seen or name not in SQL:
            return
        seen.add(name)
        source, columns = SQL[name]
        add(source)
        parts.append(f"{name} AS (SELECT {columns} FROM {source})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(parts)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input as a DataFrame, each derived value computed once like a stored column."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    source, columns = SQL[name]
    view = derive(spark, sf_dir, source)
    return computed(view, columns)


def computed(df: DataFrame, columns: str) -> DataFrame:
    """A select list evaluated into columns that later filters refer to and do not repeat."""
    row = F.struct(*[F.expr(c) for c in _split(columns.replace('"group"', "`group`"))])
    return df.select(F.inline(F.array(row)))


def _split(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, quoted, current = [], 0, False, ""
    words = columns
    for ch in words:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += ch == "("
            depth -= ch == ")"
            if ch == "," and depth == 0:
                parts.append(current.strip())
                current = ""
                continue
        current += ch
    return [*parts, current.strip()]
