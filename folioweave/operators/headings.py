"""Headings of generic chunks that are really running text: who is asked, what replaces them, and what came of it.

Only generic chunks without an article reference and with a heading are judged, and of these, unless all are wanted, only
those whose heading looks suspicious.  A model's verdict decides; without one, or where it gives none, the heading stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal, models
from ..functions.providers import Provider, answer
from . import metadata

#: Characters of the text that a model sees and in which a new heading is sought, of the document's head that tells a decree, and of a heading.
PREFIX, SOUGHT, HEAD, LONGEST = 600, 4000, 4000, 500


def flags(payload: Column, enabled: Column) -> Column:
    """struct(enabled, forced): a request's own wish, if it has one, goes before the setting; a model that is off but wished for is forced."""
    wish = F.when(payload, True).when(~payload, False)
    return F.struct(F.coalesce(wish, enabled).alias("enabled"), F.coalesce(wish & ~enabled, F.lit(False)).alias("forced"))


def replacement(text: Column, title: Column, head: Column) -> Column:
    """A heading in place of running text: the law's name, else a heading sought behind the first line, else in the whole text; null where nothing is found."""
    decree = metadata.decree_context(title, head)
    t = legal.strip(F.coalesce(text, F.lit("")))
    rest = legal.strip(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1))
    sought = lambda c: F.nullif(F.substring(metadata.generic_heading(F.substring(c, 1, SOUGHT), title, decree), 1, LONGEST), F.lit(""))
    return F.coalesce(F.nullif(F.substring(legal.law_name(title), 1, LONGEST), F.lit("")), F.when(rest != "", sought(rest)), sought(t))


def judged(chunks: DataFrame, provider: Provider | None = None, refine_all: bool = False) -> DataFrame:
    """Adds outcome and new_heading to chunks with chunkType, articleRef, heading, text, title and head (the beginning of the document).

    outcome: not_generic, has_article_ref, empty_heading, not_suspicious, section_title, body or none (no verdict); new_heading is null where the heading stays.
    """
    h = legal.strip(F.coalesce("heading", F.lit("")))
    outcome = (
        F.when(F.coalesce("chunkType", F.lit("")) != "generic", "not_generic")
        .when(legal.strip(F.coalesce("articleRef", F.lit(""))) != "", "has_article_ref")
        .when(h == "", "empty_heading")
    )
    outcome = outcome if refine_all else outcome.when(~metadata.suspicious_heading(F.col("heading")), "not_suspicious")
    rows = chunks.withColumn("_skip", outcome)
    prompt = models.section_title_prompt(F.col("heading"), F.substring("text", 1, PREFIX), F.col("title"))
    rows = rows.withColumn("_verdict", models.section_title_answer(answer(F.when(F.col("_skip").isNull(), prompt), provider)))
    rows = rows.withColumn("outcome", F.coalesce("_skip", F.when(F.col("_verdict"), "section_title").when(~F.col("_verdict"), "body"), F.lit("none")))
    fallback = F.nullif(F.substring(legal.strip(F.coalesce("title", F.lit(""))), 1, LONGEST), F.lit(""))
    new = F.when(F.col("outcome") == "body", F.coalesce(replacement(F.col("text"), F.col("title"), F.col("head")), fallback))
    return rows.withColumn("new_heading", F.when(new != h, new)).drop("_skip", "_verdict")


def counters(rows: DataFrame, by: list[str], asked: bool = True) -> DataFrame:
    """What became of the chunks: judged, changed, asked of a model, its verdicts, and those left out for each reason."""
    out = lambda *names: F.count_if(F.col("outcome").isin(*names))
    told = out("section_title", "body", "none")
    return rows.groupBy(*by).agg(
        told.alias("evaluated"), F.count_if(F.col("new_heading").isNotNull()).alias("changed"), (told if asked else F.count_if(F.lit(False))).alias("model_invocations"), out("section_title").alias("verdict_section_title"), out("body").alias("verdict_body"),
        out("none").alias("verdict_none"), out("not_generic").alias("skipped_not_generic"), out("has_article_ref").alias("skipped_has_article_ref"), out("empty_heading").alias("skipped_empty_heading"), out("not_suspicious").alias("skipped_not_suspicious"),
    )


def applied(chunks: DataFrame, refined: DataFrame, key: str = "id") -> DataFrame:
    """The chunk table with the new headings in place of the old: the backfill's update as a join."""
    new = refined.where("new_heading IS NOT NULL").select(key, "new_heading")
    got = chunks.join(new, key, "left")
    return got.withColumn("heading", F.coalesce("new_heading", "heading")).select(*chunks.columns)
