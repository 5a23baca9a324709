"""Queries of the table operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.ids import micros
from docloom.operators import joins, ordering, rollups
from docloom.plans.catalog import register
from docloom.plans.inputs import table

_NOW = "1998-08-02 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _us(name: str):
    return micros(F.col(name)).alias(name)


# -- lookups ----------------------------------------------------------------------------------


@register(
    "lookup_wanted",
    """SELECT c_custkey, c_name, c_nationkey FROM customer
    JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) w ON w.n_nationkey = c_nationkey""",
)
def lookup_wanted(spark, sf):
    wanted = table(spark, sf, "nation").filter("n_regionkey IN (1, 3)")
    wanted = wanted.select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return joins.lookup_wanted(customers, wanted, ["c_nationkey"])


def _repos_with_pointer(spark, sf):
    """Customers as repositories whose pointer is their last order."""
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderkey").alias("current_revision_id")
    )
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").join(
        last, "c_custkey", "left"
    )


def _revisions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("revision_id"),
        F.col("o_orderpriority").alias("commit_sha"),
        F.col("o_orderstatus").alias("generator_version"),
        F.col("o_orderdate").alias("indexed_at"),
        F.col("o_custkey").alias("source_index_artifact_id"),
    )


@register(
    "with_current_revision",
    """WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT c_custkey, last.k AS current_revision_id, o_orderpriority AS commit_sha,
      o_orderstatus AS generator_version, epoch_us(o_orderdate) AS indexed_at
    FROM customer LEFT JOIN last ON last.o_custkey = c_custkey
    LEFT JOIN orders ON o_orderkey = last.k""",
)
def with_current_revision(spark, sf):
    joined = joins.with_current_revision(_repos_with_pointer(spark, sf), _revisions(spark, sf))
    return joined.select(
        "c_custkey", "current_revision_id", "commit_sha", "generator_version", _us("indexed_at")
    )


@register(
    "wiki_view",
    """WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1),
    page AS (SELECT * FROM part WHERE CAST(floor(p_partkey / 100) AS INT) = 3)
    SELECT c.c_custkey AS repo_id, last.k AS current_revision_id, o.o_orderpriority AS commit_sha,
      si.c_name AS source_index_url, page.p_partkey AS page_id, page.p_name AS page_title,
      ct.c_name AS content_url, cc.c_name AS citations_url
    FROM customer c LEFT JOIN last ON last.o_custkey = c.c_custkey
    LEFT JOIN orders o ON o.o_orderkey = last.k
    LEFT JOIN customer si ON si.c_custkey = o.o_custkey
    LEFT JOIN page ON page.p_partkey % 100 = c.c_custkey
    LEFT JOIN part pr ON pr.p_partkey = page.p_partkey AND pr.p_size < 40
    LEFT JOIN customer ct ON ct.c_custkey = pr.p_size
    LEFT JOIN customer cc ON cc.c_custkey = pr.p_size + 20""",
)
def wiki_view(spark, sf):
    repos = _repos_with_pointer(spark, sf).withColumnRenamed("c_custkey", "repo_id")
    part = table(spark, sf, "part")
    pages = part.select(
        (F.col("p_partkey") % 100).alias("repo_id"),
        F.floor(F.col("p_partkey") / 100).cast("string").alias("slug"),
        F.col("p_partkey").alias("page_id"),
        F.col("p_name").alias("title"),
        F.col("p_partkey").alias("current_revision_id"),
    )
    page_revisions = part.filter("p_size < 40").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("bigint").alias("content_artifact_id"),
        (F.col("p_size") + 20).cast("bigint").alias("citations_artifact_id"),
    )
    artifacts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("artifact_id"), F.col("c_name").alias("url")
    )
    view = joins.wiki_view(repos, _revisions(spark, sf), artifacts, pages, page_revisions, "3")
    return view.select(
        "repo_id",
        "current_revision_id",
        "commit_sha",
        "source_index_url",
        "page_id",
        "page_title",
        "content_url",
        "citations_url",
    )


@register(
    "missing_pages",
    """SELECT CAST(c_nationkey AS STRING) AS repo_id, c_name AS slug FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def missing_pages(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("repo_id"), F.col("c_name").alias("slug")
    )
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    drafts = customers.join(done, "c_custkey", "left_semi").select(
        "repo_id", F.upper("slug").alias("page_slug")
    )
    return joins.missing_pages(customers.drop("c_custkey"), drafts)


# -- merges -----------------------------------------------------------------------------------

_SPLIT = "1996-01-01"


@register(
    "merge_pages",
    f"""WITH cur AS (SELECT CAST(o_custkey AS STRING) AS repo_id, o_orderpriority AS slug,
        min(o_orderkey) AS k, min(o_orderdate) AS d FROM orders WHERE o_orderdate < TIMESTAMP '{_SPLIT}' GROUP BY 1, 2),
    new AS (SELECT CAST(o_custkey AS STRING) AS repo_id, o_orderpriority AS slug,
        max(o_orderkey) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '{_SPLIT}' GROUP BY 1, 2)
    SELECT coalesce(CAST(cur.k AS STRING), sha256(concat_ws('|', repo_id, slug))) AS page_id, repo_id, slug,
      coalesce('new ' || CAST(new.k AS STRING), 'old ' || CAST(cur.k AS STRING)) AS title,
      CASE WHEN new.k IS NOT NULL THEN CAST(new.k AS STRING)
           WHEN p.repo_id IS NULL THEN CAST(cur.k AS STRING) END AS current_revision_id,
      epoch_us(coalesce(cur.d, TIMESTAMP '{_NOW}')) AS created_at,
      epoch_us(CASE WHEN new.k IS NULL AND p.repo_id IS NULL THEN cur.d ELSE TIMESTAMP '{_NOW}' END) AS updated_at,
      CASE WHEN new.k IS NOT NULL THEN 'v2' END AS published_in,
      CASE WHEN cur.k IS NULL THEN 'insert' WHEN new.k IS NOT NULL THEN 'update'
           WHEN p.repo_id IS NOT NULL THEN 'retire' ELSE 'keep' END AS action
    FROM cur FULL JOIN new USING (repo_id, slug)
    LEFT JOIN (SELECT DISTINCT repo_id FROM new) p USING (repo_id)""",
)
def merge_pages(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.col("o_orderpriority").alias("slug"),
        "o_orderkey",
        "o_orderdate",
    )
    key = F.col("k").cast("string")
    current = (
        orders.filter(F.col("o_orderdate") < F.lit(_SPLIT).cast("timestamp_ntz"))
        .groupBy("repo_id", "slug")
        .agg(F.min("o_orderkey").alias("k"), F.min("o_orderdate").cast("timestamp").alias("created_at"))
        .select(
            key.alias("page_id"),
            "repo_id",
            "slug",
            F.concat(F.lit("old "), key).alias("title"),
            key.alias("current_revision_id"),
            "created_at",
            F.col("created_at").alias("updated_at"),
        )
    )
    drafts = (
        orders.filter(F.col("o_orderdate") >= F.lit(_SPLIT).cast("timestamp_ntz"))
        .groupBy("repo_id", "slug")
        .agg(F.max("o_orderkey").alias("k"))
        .select(
            "repo_id",
            "slug",
            F.concat(F.lit("new "), key).alias("title"),
            key.alias("page_revision_id"),
        )
    )
    merged = joins.merge_pages(current, drafts, "v2", _now())
    return merged.withColumn("created_at", _us("created_at")).withColumn("updated_at", _us("updated_at"))


@register(
    "upsert_repositories",
    f"""WITH c AS (SELECT CAST(c_custkey AS STRING) AS id, 'github' AS provider, lower(c_mktsegment) AS owner,
        c_name AS name, c_acctbal AS b FROM customer)
    SELECT CASE WHEN b >= 0 THEN id ELSE sha256(provider || '/' || owner || '/' || name) END AS repo_id, provider, owner, name,
      owner || '/' || CASE WHEN b < 5000 THEN upper(name) ELSE name END AS full_name,
      CASE WHEN b < 5000 THEN 'https://github.com/' || owner || '/' || name ELSE 'stored' END AS repo_url,
      epoch_us(CASE WHEN b >= 0 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '{_NOW}' END) AS created_at,
      epoch_us(CASE WHEN b < 5000 THEN TIMESTAMP '{_NOW}' ELSE TIMESTAMP '1995-01-01' END) AS updated_at,
      CASE WHEN b < 0 THEN 'insert' WHEN b < 5000 THEN 'update' ELSE 'keep' END AS action,
      owner = 'building' AND b >= 5000 AS is_featured
    FROM c""",
)
def upsert_repositories(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("repo_id"),
        F.lit("github").alias("provider"),
        F.lower("c_mktsegment").alias("owner"),
        F.col("c_name").alias("name"),
        "c_acctbal",
    )
    then = F.lit("1995-01-01").cast("timestamp")
    stored = base.filter("c_acctbal >= 0").select(
        "repo_id",
        "provider",
        "owner",
        "name",
        F.concat_ws("/", "owner", "name").alias("full_name"),
        F.lit("stored").alias("repo_url"),
        then.alias("created_at"),
        then.alias("updated_at"),
    )
    incoming = base.filter("c_acctbal < 5000").select(
        "provider",
        "owner",
        "name",
        F.concat_ws("/", "owner", F.upper("name")).alias("full_name"),
        F.concat_ws("/", F.lit("https://github.com"), "owner", "name").alias("repo_url"),
    )
    featured = base.filter("owner = 'building' and c_acctbal >= 5000").select(
        F.concat_ws("/", "owner", "name").alias("full_name")
    )
    merged = joins.upsert_repositories(stored, incoming, featured, _now())
    return merged.withColumn("created_at", _us("created_at")).withColumn("updated_at", _us("updated_at"))


@register(
    "with_fallback",
    """WITH s AS (SELECT c_nationkey, CASE WHEN max(c_acctbal) > 9900 THEN max(c_mktsegment) END AS description,
        count(*) AS stars FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    SELECT n_nationkey, coalesce(s.description, r_name) AS description, s.stars
    FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN s ON s.c_nationkey = n_nationkey""",
)
def with_fallback(spark, sf):
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    seed = table(spark, sf, "nation").join(region, "n_regionkey").select(
        "n_nationkey", F.col("r_name").alias("description")
    )
    stored = table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(
        F.col("c_nationkey").alias("n_nationkey")
    ).agg(
        F.when(F.max("c_acctbal") > 9900, F.max("c_mktsegment")).alias("description"),
        F.count(F.lit(1)).alias("stars"),
    )
    return joins.with_fallback(seed, stored, ["n_nationkey"], ["description", "stars"])


@register(
    "stale_metadata",
    f"""WITH s AS (SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS stars,
        max(o_orderdate) FILTER (o_orderpriority <> '5-LOW') AS d FROM orders GROUP BY 1),
    j AS (SELECT c_custkey, CASE WHEN s.o_custkey IS NULL THEN 'missing' WHEN stars IS NULL THEN 'no_stars'
        WHEN d IS NULL THEN 'never'
        WHEN epoch_us(TIMESTAMP '{_NOW}') - epoch_us(d) > 24 * 365 * 3600000000 THEN 'old' END AS reason
      FROM customer LEFT JOIN s ON o_custkey = c_custkey)
    SELECT c_custkey, reason FROM j WHERE reason IS NOT NULL""",
)
def stale_metadata(spark, sf):
    seed = table(spark, sf, "customer").select(F.col("c_custkey").alias("full_name"))
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("full_name")).agg(
        F.nullif(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0)).alias("stars"),
        F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))).alias(
            "metadata_refreshed_at"
        ),
    )
    stale = rollups.stale_metadata(seed, stored, _now(), 24 * 365)
    return stale.select(F.col("full_name").alias("c_custkey"), "reason")


# -- order ------------------------------------------------------------------------------------


@register(
    "recent",
    """SELECT o_orderkey, epoch_us(o_orderdate) AS updated_at FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
)
def recent(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordering.recent(rows, 100, "o_orderdate", "o_orderkey").select(
        "o_orderkey", micros(F.col("o_orderdate")).alias("updated_at")
    )


_TARGETS_SQL = """last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1),
    t AS (SELECT c_name AS full_name, c_mktsegment = 'BUILDING' AS is_featured,
        o_orderpriority AS current_commit, o_orderstatus AS current_version, o_orderdate AS indexed_at,
        CASE WHEN c_acctbal > 0 THEN make_timestamp(CAST(floor(c_acctbal) AS BIGINT) * 86400000000) END AS last_checked_at,
        CASE WHEN c_nationkey <> 7 THEN CASE WHEN c_nationkey < 9 THEN o_orderpriority ELSE '1-URGENT' END END AS latest_commit,
        c_nationkey = 11 AS has_open_job, o_orderpriority AS attempted_commit, 'F' AS attempted_version,
        epoch_us(o_orderdate) AS enqueued_at_us
      FROM customer LEFT JOIN last ON last.o_custkey = c_custkey LEFT JOIN orders ON o_orderkey = last.k),
    r AS (SELECT *, CASE WHEN is_featured AND stale THEN 0 WHEN stale THEN 1 WHEN is_featured THEN 2 ELSE 3 END AS refresh_class
      FROM (SELECT *, current_commit IS NULL OR current_version IS DISTINCT FROM 'F' AS stale FROM t))"""


def _targets(spark, sf):
    joined = joins.with_current_revision(
        table(spark, sf, "customer").join(
            _repos_with_pointer(spark, sf).select("c_custkey", "current_revision_id"), "c_custkey"
        ),
        _revisions(spark, sf),
    )
    nation = F.col("c_nationkey")
    return joined.select(
        F.col("c_name").alias("full_name"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_featured"),
        F.col("commit_sha").alias("current_commit"),
        F.col("generator_version").alias("current_version"),
        F.col("indexed_at").cast("timestamp").alias("indexed_at"),
        F.when(
            F.col("c_acctbal") > 0, F.timestamp_seconds(F.floor("c_acctbal") * 86400)
        ).alias("last_checked_at"),
        F.when(
            nation != 7, F.when(nation < 9, F.col("commit_sha")).otherwise(F.lit("1-URGENT"))
        ).alias("latest_commit"),
        (nation == 11).alias("has_open_job"),
        F.col("commit_sha").alias("attempted_commit"),
        F.lit("F").alias("attempted_version"),
        micros(F.col("indexed_at")).alias("enqueued_at_us"),
    )


@register(
    "refresh_priority",
    f"""WITH {_TARGETS_SQL}
    SELECT full_name, refresh_class, epoch_us(last_checked_at) AS last_checked_at, epoch_us(indexed_at) AS indexed_at
    FROM r ORDER BY refresh_class, r.last_checked_at ASC NULLS FIRST, r.indexed_at ASC NULLS FIRST, full_name LIMIT 100""",
)
def refresh_priority(spark, sf):
    return ordering.refresh_priority(_targets(spark, sf), "F").select(
        "full_name", "refresh_class", _us("last_checked_at"), _us("indexed_at")
    )


_PLAN_NOW = 902016000000000  # 1998-08-02


@register(
    "plan_refresh",
    f"""WITH RECURSIVE {_TARGETS_SQL},
    o AS (SELECT *, CAST(row_number() OVER (ORDER BY refresh_class, last_checked_at ASC NULLS FIRST,
        indexed_at ASC NULLS FIRST, full_name) AS INT) AS i FROM r),
    s AS (SELECT *, is_featured AND current_commit IS NULL AS boot,
        is_featured AND current_version IS DISTINCT FROM 'F' AS gen,
        CASE WHEN latest_commit IS NULL THEN 'error'
          WHEN current_commit IS NOT DISTINCT FROM latest_commit AND current_version IS NOT DISTINCT FROM 'F' THEN 'current'
          WHEN NOT (is_featured AND current_commit IS NULL) AND attempted_commit IS NOT DISTINCT FROM latest_commit
            AND coalesce({_PLAN_NOW} - enqueued_at_us < 24 * 3600000000 * 300, false) THEN 'cooldown'
          WHEN has_open_job THEN 'active' ELSE 'queued' END AS would FROM o WHERE i <= 100),
    f AS (SELECT 0 AS i, 0 AS queued, 0 AS caught, '' AS status
      UNION ALL
      SELECT s.i, f.queued + CASE WHEN ok AND would = 'queued' THEN 1 ELSE 0 END,
        f.caught + CASE WHEN ok AND would = 'queued' AND gen THEN 1 ELSE 0 END,
        CASE WHEN ok THEN would ELSE 'deferred' END
      FROM f JOIN s ON s.i = f.i + 1,
      LATERAL (SELECT f.queued < 3 OR boot OR (gen AND f.caught < 12) AS ok))
    SELECT CAST(s.i - 1 AS INT) AS pos, s.full_name, s.is_featured, f.status,
      CASE WHEN f.status IN ('cooldown', 'active', 'queued') THEN
        CASE WHEN current_commit IS NOT DISTINCT FROM latest_commit THEN 'generator' ELSE 'repository' END END AS stale_reason
    FROM f JOIN s ON s.i = f.i""",
)
def plan_refresh(spark, sf):
    return ordering.plan_refresh(_targets(spark, sf), F.lit(_PLAN_NOW), "F", cooldown_hours=24 * 300)


@register(
    "refresh_summary",
    """SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'current' ELSE 'deferred' END AS status,
      CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority < '3' THEN 'generator' ELSE 'repository' END END AS stale_reason,
      count(*) AS repositories FROM orders GROUP BY 1, 2""",
)
def refresh_summary(spark, sf):
    s = F.col("o_orderstatus")
    outcomes = table(spark, sf, "orders").select(
        F.when(s == "O", "queued").when(s == "F", "current").otherwise("deferred").alias("status"),
        F.when(
            s == "O",
            F.when(F.col("o_orderpriority") < "3", F.lit("generator")).otherwise(F.lit("repository")),
        ).alias("stale_reason"),
    )
    return rollups.refresh_summary(outcomes)


@register(
    "search_rank",
    """WITH hits AS (SELECT unnest(string_split(p_name, ' ')) AS query, p_partkey AS pos,
        replace(p_name, ' ', '/') AS full_name FROM part),
    t AS (SELECT query, pos, full_name, CAST(CASE WHEN full_name = query THEN 0
        WHEN coalesce(string_split(full_name, '/')[2], full_name) = query THEN 1
        WHEN starts_with(full_name, query) THEN 2
        WHEN starts_with(coalesce(string_split(full_name, '/')[2], full_name), query) THEN 3 ELSE 4 END AS INT) AS tier FROM hits)
    SELECT query, pos, full_name, tier FROM t
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, pos) <= 9""",
)
def search_rank(spark, sf):
    part = table(spark, sf, "part")
    hits = part.select(
        F.explode(F.split("p_name", " ")).alias("query_id"),
        F.col("p_partkey").alias("pos"),
        F.replace("p_name", F.lit(" "), F.lit("/")).alias("full_name"),
    )
    queries = hits.select("query_id", F.col("query_id").alias("query")).distinct()
    return ordering.search_rank(hits, queries).select("query", "pos", "full_name", "tier")


@register(
    "trim_outline",
    """SELECT p_brand AS repo_id, p_partkey AS pos, CASE WHEN p_size = 1 THEN 'Overview' ELSE p_name END AS slug FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size = 1 THEN 0 ELSE 1 END,
      CASE WHEN p_size < 20 THEN 3 WHEN p_size < 35 THEN 2 ELSE 1 END DESC, p_partkey) <= 30""",
)
def trim_outline(spark, sf):
    size = F.col("p_size")
    outline = table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.col("p_partkey").alias("pos"),
        F.when(size == 1, F.lit("Overview")).otherwise(F.col("p_name")).alias("slug"),
        F.when(size < 20, "required").when(size < 35, "recommended").otherwise("optional").alias("priority"),
    )
    return ordering.trim_outline(outline, 30).select("repo_id", "pos", "slug")


@register(
    "landing_page",
    """SELECT p_brand AS repo_id, p_partkey AS page_id, slug FROM
      (SELECT *, CASE WHEN p_size = 1 AND p_retailprice > 1200 THEN 'overview' ELSE p_name END AS slug FROM part)
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN slug = 'overview' THEN 0 ELSE 1 END, p_retailprice, p_partkey) = 1""",
)
def landing_page(spark, sf):
    pages = table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.col("p_partkey").alias("page_id"),
        F.when((F.col("p_size") == 1) & (F.col("p_retailprice") > 1200), F.lit("overview"))
        .otherwise(F.col("p_name"))
        .alias("slug"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("created_at"),
    )
    return ordering.landing_page(pages).select("repo_id", "page_id", "slug")


@register(
    "active_job",
    """WITH p AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT o.o_custkey AS repo_id, o.o_orderkey AS job_id FROM orders o JOIN p ON p.o_custkey = o.o_custkey
    WHERE o_orderstatus IN ('O', 'P')
    QUALIFY row_number() OVER (PARTITION BY o.o_custkey ORDER BY CASE WHEN p.k = o_orderkey THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) = 1""",
)
def active_job(spark, sf):
    orders = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    jobs = orders.select(
        F.col("o_custkey").alias("repo_id"),
        F.col("o_orderkey").alias("job_id"),
        F.when(s == "O", "running").when(s == "P", "pending").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("started_at"),
    )
    repos = jobs.groupBy("repo_id").agg(F.min("job_id").alias("active_job_id"))
    return ordering.active_job(jobs, repos).select("repo_id", "job_id")


@register(
    "unique_slugs",
    """WITH s AS (SELECT p_brand AS repo_id, p_partkey AS pos, replace(p_name, ' ', '-') AS base FROM part)
    SELECT repo_id, pos, base || CASE WHEN n = 1 THEN '' ELSE '-' || CAST(n AS STRING) END AS page_slug,
      base || CASE WHEN n = 1 THEN '' ELSE '-' || CAST(n - 1 AS STRING) END AS anchor
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, base ORDER BY pos) AS n FROM s)""",
)
def unique_slugs(spark, sf):
    base = table(spark, sf, "part").select(
        F.col("p_brand").alias("repo_id"),
        F.col("p_partkey").alias("pos"),
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("base"),
    )
    anchors = ordering.numbered_slugs(base, ["repo_id"], "base", ["pos"], "anchor", first_suffix=1)
    pages = ordering.page_slugs(anchors, ["repo_id"], "base", "pos", "page_slug")
    return pages.select("repo_id", "pos", "page_slug", "anchor")


@register(
    "union_first",
    """WITH b AS (SELECT s_nationkey AS k, min(s_suppkey) AS pos FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
    a AS (SELECT c_nationkey AS k, min(c_custkey) AS pos FROM customer WHERE c_acctbal > 9950 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.pos, b.pos) AS pos, CAST(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS INT) AS source
    FROM a FULL JOIN b ON a.k = b.k""",
)
def union_first(spark, sf):
    a = table(spark, sf, "customer").filter("c_acctbal > 9950").select(
        F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pos")
    )
    b = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(
        F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("pos")
    )
    return joins.union_first(a, b, ["k"]).select("k", "pos", "source")


@register(
    "intersect_keys",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def intersect_keys(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    keys = orders.select(F.col("o_custkey").alias("c_custkey"))
    return joins.intersect_keys(table(spark, sf, "customer").select("c_custkey"), keys, ["c_custkey"])


@register(
    "subtract_keys",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def subtract_keys(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    keys = orders.select(F.col("o_custkey").alias("c_custkey"))
    return joins.subtract_keys(table(spark, sf, "customer").select("c_custkey"), keys, ["c_custkey"])


