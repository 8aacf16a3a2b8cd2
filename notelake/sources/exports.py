"""Landed exports of feeds, trackers, wikis, code hosts and drives, each as one shape of document.

Columns: connector, external_id, title, body, url, author, updated, meta. Exports are files that
Spark reads; nothing is fetched. A new source is a function (spark, path) -> DataFrame in ``SOURCES``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.operators.extract import html_to_markdown

#: Date formats of exports, tried in turn, after a weekday is taken off.
DATE_FORMATS = ("dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM")


def any_timestamp(text: Column) -> Column:
    """The first format that fits, as timestamp_ntz in the session's zone; null without one."""
    text = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")  # a weekday can be shown but not parsed
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def _document(df: DataFrame, connector: str, **columns: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    meta = columns.pop("meta", F.create_map().cast("map<string,string>"))
    names = ("external_id", "title", "body", "url", "author")
    return df.select(
        F.lit(connector).alias("connector"), *[columns.get(n, empty).alias(n) for n in names], columns.get("updated", F.lit(None).cast("timestamp_ntz")).alias("updated"), meta.alias("meta")
    )


def feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries; the id is the guid, else the link; content wins over description."""
    rss = (
        spark.read.format("xml").option("rowTag", "item")
        .schema("guid string, link string, title string, description string, encoded string, pubDate string, author string").load(path)
    )
    atom = (
        spark.read.format("xml").option("rowTag", "entry")
        .schema("id string, title string, summary string, content string, updated string, published string").load(path)
    )
    c = F.col
    items = _document(
        rss.where("guid is not null or link is not null"), "feed", external_id=F.coalesce("guid", "link"), title=c("title"), url=c("link"), author=c("author"),
        body=html_to_markdown(F.coalesce("encoded", "description", F.lit(""))), updated=any_timestamp(c("pubDate")),
    )
    entries = _document(
        atom.where("id is not null"), "feed", external_id=c("id"), title=c("title"), body=html_to_markdown(F.coalesce("content", "summary", F.lit(""))), updated=any_timestamp(F.coalesce("updated", "published"))
    )
    return items.unionByName(entries)


def _walk(node) -> str:
    if isinstance(node, list):
        return "".join(_walk(n) for n in node)
    if not isinstance(node, dict):
        return ""
    kind, inner = node.get("type"), _walk(node.get("content", []))
    if kind == "text":
        return node.get("text", "")
    if kind == "hardBreak":
        return "\n"
    if kind == "heading":
        return "#" * int(node.get("attrs", {}).get("level", 1)) + " " + inner + "\n\n"
    if kind == "listItem":
        return "- " + inner.strip() + "\n"
    if kind in ("paragraph", "bulletList", "orderedList", "codeBlock"):
        return inner + ("\n\n" if kind != "bulletList" else "\n")
    return inner


def tree_text(tree: Column) -> Column:
    """Markdown of a document tree given as JSON text; recursive, so it runs as an Arrow function."""

    @F.pandas_udf(T.StringType())
    def walk(trees: pd.Series) -> pd.Series:
        return pd.Series([_walk(json.loads(t)).strip() if t else "" for t in trees], dtype=object)

    return walk(tree)


_ISSUES = "issues array<struct<key:string,fields:struct<summary:string,description:string,updated:string,project:string,status:string,assignee:string,comments:array<struct<author:string,body:string>>>>>"


def tracker(spark: SparkSession, path: str) -> DataFrame:
    """Issues of exported pages: a header line, the description tree, the comments."""
    i = spark.read.schema(_ISSUES).json(path).select(F.explode("issues").alias("i")).select("i.key", "i.fields.*")
    head = F.concat_ws(" · ", "project", "status", F.coalesce("assignee", F.lit("unassigned")))
    said = F.transform("comments", lambda c: F.concat(F.lit("**"), c["author"], F.lit("**: "), c["body"]))
    body = F.concat_ws("\n\n", head, F.nullif(F.col("text"), F.lit("")), F.nullif(F.array_join(F.coalesce(said, F.array().cast("array<string>")), "\n\n"), F.lit("")))
    rows = i.withColumn("text", tree_text(F.col("description")))
    return _document(
        rows, "tracker", external_id=F.col("key"), title=F.concat_ws(" ", "key", "summary"), body=body, author=F.col("assignee"), updated=any_timestamp(F.col("updated")),
        meta=F.create_map(F.lit("project"), F.col("project"), F.lit("status"), F.col("status")),
    )


def wiki(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, title string, space string, body struct<storage:struct<value:string>>, updated string").json(path)
    return _document(
        rows, "wiki", external_id=F.col("id"), title=F.col("title"), body=html_to_markdown(F.col("body.storage.value")), updated=any_timestamp(F.col("updated")), meta=F.create_map(F.lit("space"), F.col("space"))
    )


def code_host(spark: SparkSession, path: str) -> DataFrame:
    """Issues and pull requests, told apart by ``pull_request``; labels joined, comments appended in order."""
    rows = spark.read.schema(
        "number long, title string, body string, user string, updated_at string, pull_request struct<url:string>, labels array<string>, comments array<struct<at:string,user:string,body:string>>"
    ).json(path)
    said = F.transform(F.array_sort("comments"), lambda c: F.concat(c["user"], F.lit(": "), c["body"]))
    body = F.concat_ws("\n\n", F.nullif(F.col("body"), F.lit("")), F.nullif(F.array_join(F.coalesce(said, F.array().cast("array<string>")), "\n\n"), F.lit("")))
    kind = F.when(F.col("pull_request").isNotNull(), "pull").otherwise("issue")
    return _document(
        rows, "code", external_id=F.concat(kind, F.lit("-"), F.col("number").cast("string")), title=F.col("title"), body=body, author=F.col("user"), updated=any_timestamp(F.col("updated_at")),
        meta=F.create_map(F.lit("kind"), kind, F.lit("labels"), F.array_join("labels", ",")),
    )


#: Types of drive files that hold text.
TEXT_TYPES = ("text/plain", "text/markdown", "application/document")


def drive(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Text files modified after the cursor."""
    rows = spark.read.schema("id string, name string, mimeType string, modifiedTime string, text string").json(path)
    rows = rows.where(F.col("mimeType").isin(*TEXT_TYPES)).withColumn("updated", any_timestamp(F.col("modifiedTime")))
    if after:
        rows = rows.where(F.col("updated") > F.lit(after).cast("timestamp_ntz"))
    return _document(rows, "drive", external_id=F.col("id"), title=F.col("name"), body=F.col("text"), updated=F.col("updated"))


SOURCES = {"feed": feed, "tracker": tracker, "wiki": wiki, "code": code_host, "drive": drive}


def register(name: str, source) -> None:
    """Adds a source: a function (spark, path) -> DataFrame of documents."""
    SOURCES[name] = source
