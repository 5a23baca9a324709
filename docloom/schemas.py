"""Explicit schemas of the tables and JSON documents the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

CITATION = "struct<path:string,start_line:int,end_line:int>"

EVENT_DATA = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("messageSoFar", T.StringType()),
        T.StructField("callId", T.StringType()),
        T.StructField("toolName", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", EVENT_DATA),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

DRAFT_JSON = (
    "struct<slug:string,title:string,markdown:string,markdownLines:array<string>,"
    "citations:array<struct<path:string,startLine:bigint,endLine:bigint>>,"
    "relatedPages:array<string>,coverageNotes:array<string>>"
)


def _navigation(depth: int) -> str:
    children = "" if depth == 1 else f",children:array<{_navigation(depth - 1)}>"
    return f"struct<slug:string,title:string{children}>"


NAV_DEPTH = 4
OUTLINE_JSON = (
    "struct<title:string,summary:string,"
    "concepts:array<struct<name:string,description:string,sourcePaths:array<string>>>,"
    "pages:array<struct<slug:string,title:string,purpose:string,priority:string,"
    "sourcePaths:array<string>>>,"
    f"navigation:array<{_navigation(NAV_DEPTH)}>>"
)

PAGES = "page_id bigint, url string, html string"
NAV = "repo_id string, node_id string, parent_id string, depth int, ord int, slug string, title string"
POINTERS = "repo_id string, revision_id string, version int, published_at timestamp"
