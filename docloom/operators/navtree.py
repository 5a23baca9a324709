"""Navigation trees as adjacency rows: repo_id, node_id, parent_id, depth, ord, slug, title.

Trees are at most ``MAX_DEPTH`` deep, so bottom-up work is a fixed number of joins. Deeper input fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.binding import stage
from docloom.operators.matching import match_entries, nav_parts
from docloom.operators.predicates import any_match
from docloom.schemas import NAV_DEPTH
from docloom.session import joinable, materialized

MAX_DEPTH = NAV_DEPTH
_COLUMNS = ["repo_id", "node_id", "parent_id", "depth", "ord", "slug", "title"]


def check_depth(nav: DataFrame) -> DataFrame:
    """Fail the job on a node below the supported depth."""
    too_deep = F.raise_error(F.lit(f"navigation deeper than {MAX_DEPTH}")).cast("int")
    return nav.withColumn(
        "depth", F.when(F.col("depth") > MAX_DEPTH, too_deep).otherwise(F.col("depth"))
    )


def _with_ancestors(nodes: DataFrame, tree: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """Add the ancestors of each node, nearest first: ``up1`` .. and the carried columns of each.

    ``nodes`` has repo_id and parent_id. One join per level of the fixed depth.
    """
    out = nodes.withColumn("up1", F.col("parent_id"))
    for i in range(1, MAX_DEPTH):
        above = tree.select(
            "repo_id",
            F.col("node_id").alias(f"up{i}"),
            F.col("parent_id").alias(f"up{i + 1}"),
            *[F.col(c).alias(f"{c}{i}") for c in carry],
        )
        out = out.join(above, ["repo_id", f"up{i}"], "left")
    return out


def prune_nav(nav: DataFrame, slugs: DataFrame) -> DataFrame:
    """Drop leaves whose page is not selected, then folders left without anything below.

    ``slugs``: repo_id, slug. A node stays if its slug is selected or that of any descendant is, so
    the selected nodes and their ancestors are the result.
    """
    tree = check_depth(nav)
    wanted = slugs.select("repo_id", T.slug(F.col("slug")).alias("_key")).distinct()
    chosen = tree.withColumn("_key", T.slug(F.col("slug"))).join(
        wanted, ["repo_id", "_key"], "left_semi"
    ).select("repo_id", "node_id", "parent_id")
    lines = _with_ancestors(chosen, tree)
    names = ["node_id", *[f"up{i}" for i in range(1, MAX_DEPTH)]]
    kept = lines.select("repo_id", F.explode(F.array(*names)).alias("node_id")).distinct()
    return tree.join(kept, ["repo_id", "node_id"], "left_semi").select(*_COLUMNS)


def collapse_nav(nav: DataFrame) -> DataFrame:
    """Replace folders without a page whose only child is a leaf page by that leaf, bottom up.

    Collapsing never changes how many children a folder has, so a leaf takes the place of the highest
    of the single-child folders right above it, and those folders go.
    """
    tree = check_depth(nav)
    kids = tree.filter(F.col("parent_id").isNotNull()).groupBy(
        "repo_id", F.col("parent_id").alias("node_id")
    ).agg(F.count(F.lit(1)).alias("_kids"))
    counted = tree.join(kids, ["repo_id", "node_id"], "left").withColumn(
        "single", F.coalesce((F.col("_kids") == 1) & F.col("slug").isNull(), F.lit(False))
    )
    leaves = counted.filter(F.col("_kids").isNull() & F.col("slug").isNotNull()).select(
        "repo_id", "node_id", "parent_id"
    )
    only = counted.filter("single").select(
        "repo_id", "node_id", "parent_id", "depth", "ord", F.lit(True).alias("hit")
    )
    lines = _with_ancestors(leaves, only, ["parent_id", "depth", "ord", "hit"])
    # Ancestors are joined through single folders only: the chain ends where the first other one is.
    places = F.array(
        *[
            F.when(
                F.col(f"hit{i}"),
                F.struct(
                    F.col(f"up{i}").alias("id"),
                    F.col(f"parent_id{i}").alias("parent_id"),
                    F.col(f"depth{i}").alias("depth"),
                    F.col(f"ord{i}").alias("ord"),
                ),
            )
            for i in range(1, MAX_DEPTH)
        ]
    )
    moved = lines.select(
        "repo_id", "node_id", F.filter(places, lambda p: p.isNotNull()).alias("_chain")
    ).filter(F.size("_chain") > 0)
    gone = moved.select("repo_id", F.explode("_chain.id").alias("node_id"))
    top = moved.select("repo_id", "node_id", F.try_element_at("_chain", F.lit(-1)).alias("_to"))
    kept = tree.join(gone, ["repo_id", "node_id"], "left_anti").join(top, ["repo_id", "node_id"], "left")
    place = {c: F.when(F.col("_to").isNotNull(), F.col(f"_to.{c}")).otherwise(F.col(c)) for c in ("parent_id", "depth", "ord")}
    return kept.select("repo_id", "node_id", *[v.alias(k) for k, v in place.items()], "slug", "title").select(*_COLUMNS)


def rewrite_nav_slugs(nav: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace slug and title of nodes. ``replacements``: repo_id, slug, new_slug, new_title."""
    fresh = replacements.select("repo_id", F.col("slug").alias("_key"), "new_slug", "new_title")
    joined = nav.withColumn("_key", T.slug(F.col("slug"))).join(fresh, ["repo_id", "_key"], "left")
    return joined.select(
        "repo_id",
        "node_id",
        "parent_id",
        "depth",
        "ord",
        F.coalesce("new_slug", "slug").alias("slug"),
        F.coalesce("new_title", "title").alias("title"),
    )


def nav_or_pages(nav: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored tree of published pages; repositories without one get a flat page list.

    ``pages``: repo_id, slug, title, created_at. Nodes without a title or known page fall away.
    """
    titled = nav.filter(F.trim("title") != "")
    known = collapse_nav(prune_nav(titled, pages))
    flat = pages.join(known.select("repo_id"), "repo_id", "left_anti")
    w = Window.partitionBy("repo_id").orderBy("created_at", "slug")
    listed = flat.select(
        "repo_id",
        F.concat(F.lit("page:"), F.col("slug")).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(1).alias("depth"),
        (F.row_number().over(w) - 1).alias("ord"),
        "slug",
        "title",
    )
    return known.unionByName(listed)


def _tree_rows(leaves: DataFrame) -> DataFrame:
    """Folders and leaves of pages placed at ``parts`` (up to three folder titles), in page order."""
    depth = F.size("parts")
    prefixes = leaves.select(
        "repo_id",
        "pos",
        F.explode(
            F.transform(F.sequence(F.lit(1), depth), lambda d: F.slice("parts", F.lit(1), d))
        ).alias("_p"),
    )
    size = F.size("_p")
    folders = prefixes.groupBy("repo_id", "_p").agg(F.min("pos").alias("ord")).select(
        "repo_id",
        F.concat(F.lit("dir:"), F.array_join("_p", "/")).alias("node_id"),
        F.when(
            size > 1, F.concat(F.lit("dir:"), F.array_join(F.slice("_p", F.lit(1), size - 1), "/"))
        ).alias("parent_id"),
        size.alias("depth"),
        F.col("ord").cast("int").alias("ord"),
        F.lit(None).cast("string").alias("slug"),
        F.get("_p", size - 1).alias("title"),
    )
    pages = leaves.select(
        "repo_id",
        F.concat(F.lit("page:"), F.col("slug")).alias("node_id"),
        F.concat(F.lit("dir:"), F.array_join("parts", "/")).alias("parent_id"),
        (depth + 1).alias("depth"),
        F.col("pos").cast("int").alias("ord"),
        "slug",
        "title",
    )
    return folders.unionByName(pages)


def build_nav(outline: DataFrame, entries: DataFrame) -> DataFrame:
    """Sidebar of an outline from its matched entries' groups.

    Leaves go under up to three folders; the overview under ``Start Here``, pages without an entry under
    ``Additional Topics``. Order follows the pages.
    """
    best = joinable(match_entries(outline, entries).select("repo_id", "pos", "entry_pos"), "matched")
    placed = stage(
        entries.select("repo_id", F.col("pos").alias("entry_pos"), "group", "title", "url"),
        _parts=nav_parts(F.col("group"), F.col("title"), F.col("url")),
    ).select("repo_id", "entry_pos", "_parts")
    joined = outline.join(best, ["repo_id", "pos"], "left").join(placed, ["repo_id", "entry_pos"], "left")
    parts = (
        F.when(T.slug(F.col("slug")) == "overview", F.array(F.lit("Start Here")))
        .when(F.col("_parts").isNull(), F.array(F.lit("Additional Topics")))
        .otherwise(F.slice("_parts", 1, 3))
    )
    leaves = joined.select("repo_id", "pos", "slug", "title", parts.alias("parts"))
    return _tree_rows(materialized(leaves, "nav-leaves"))


def build_nav_by_rules(
    outline: DataFrame,
    groups: list[tuple[str, list[str]]],
    rest: str = "Reference and Operations",
    rest_into: str = "Deployment and Reference",
) -> DataFrame:
    """Sidebar from ordered rule groups: a page joins the first group whose patterns match its label.

    A group with fewer than two pages gives them to the later groups. Which groups stand is settled on the counts
    of each pattern of hits, at most 2 to the number of groups a repository, and joined back once, so the
    plan does not grow with the groups. What is left goes to ``rest_into`` if that stands, else to ``rest``.
    """
    label = F.replace(
        F.concat_ws(" ", T.slug(F.col("slug")), T.slug(F.col("title"))), F.lit("-"), F.lit(" ")
    )
    hits = F.array(*[F.coalesce(any_match(label, patterns), F.lit(False)) for _, patterns in groups])
    pages = materialized(outline.select("repo_id", "pos", "slug", "title", hits.alias("_hits")), "nav-hits")
    masks = pages.groupBy("repo_id", "_hits").agg(F.count(F.lit(1)).alias("n"))
    masks = masks.groupBy("repo_id").agg(F.collect_list(F.struct("_hits", "n")).alias("masks"))

    def settle(standing: Column, i: Column) -> Column:
        free = F.filter(
            "masks",
            lambda m: F.get(m["_hits"], i) & ~F.exists(standing, lambda j: F.get(m["_hits"], j)),
        )
        n = F.aggregate(free, F.lit(0).cast("long"), lambda a, m: a + m["n"])
        return F.when(n >= 2, F.concat(standing, F.array(i))).otherwise(standing)

    order = F.sequence(F.lit(0), F.lit(len(groups) - 1)) if groups else F.array().cast("array<int>")
    standing = F.aggregate(order, F.array().cast("array<int>"), settle)
    named = pages.join(masks.select("repo_id", standing.alias("_standing")), "repo_id")
    at = F.get(F.filter("_standing", lambda j: F.get("_hits", j)), F.lit(0))
    names = F.array(*[F.lit(name) for name, _ in groups]).cast("array<string>")
    target = [name for name, _ in groups].index(rest_into) if rest_into in dict(groups) else -1
    has_target = F.array_contains("_standing", target)
    folder = F.coalesce(F.get(names, at), F.when(has_target, F.lit(rest_into)).otherwise(F.lit(rest)))
    named = materialized(named.withColumn("_folder", folder), "nav-folders")
    folder = F.col("_folder")
    tree = _tree_rows(named.select("repo_id", "pos", "slug", "title", F.array(folder).alias("parts")))
    rank = F.coalesce(F.array_position(names, F.col("title")), F.lit(0))
    place = F.when(rank > 0, rank - 1).otherwise(F.lit(len(groups))).cast("int")
    return tree.withColumn("ord", F.when(F.col("depth") == 1, place).otherwise(F.col("ord")))
