"""Structural quality of documents from their trees, and corpus metrics over the scores.

Every check is an aggregate over narrow per-node flags, so a document of any size is reduced before the
shuffle; only the article sequence needs order, and it runs in blocks of the ordinal.  Documents without
nodes have no row; ratios over nothing are those of a passed check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from . import structure

# --- Fixed values: patterns, weights, curves and limits of the checks ---
TABLE_TOKEN = r"(?i)\[?/?TABLE(?:_\d+)?\]?"
HEAD_FOOT = [
    r"(?iU)DIARIO\s+OFICIAL", r"(?iU)C[AÁ]MARA\s+DE\s+DIPUTADOS", r"(?iU)C[AÁ]MARA\s+DE\s+SENADORES", r"(?iU)GACETA\s+PARLAMENTARIA",
    r"(?iU)SECRETAR[IÍ]A\s+DE\s+GOBERNACI[OÓ]N", r"(?U)^\s*\d{1,4}\s*$", r"(?iU)P[aá]gina\s+\d+",
]
DATES = [rf"(?iU)^\s*\d{{1,2}}\s+de\s+(?:{'|'.join(legal.MONTHS)})\s+de\s+\d{{4}}\s*$", r"(?iU)(?:DOF|Diario\s+Oficial)\s+\d{1,2}[\s/\-]"]
WEIGHTS = {
    "has_visible_table_tokens": 0.20, "article_sequence_health": 0.15, "header_footer_bleed": 0.20, "date_heading_false_positive_count": 0.05,
    "orphan_tables_count": 0.05, "unknown_block_ratio": 0.10, "toc_duplicate_ratio": 0.10, "article_ref_coverage": 0.15,
}
TYPES = ["book", "title", "chapter", "section", "article", "fraction", "inciso", "transitory", "table", "note", "paragraph"]
MOST_DISORDER, MOST_GAP, MOST_REPEATED, MOST_DEGRADED, MOST_DUPLICATED, LEAST_COVERED, FEW_ARTICLES = 0.3, 50, 0.4, 0.3, 0.15, 0.5, 2
LOW, MEDIUM = 0.85, 0.70
EXAMPLES = 5
BLOCK = 4096
KEYS = ["doc_id"]


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def sequence_parts(ref: Column) -> tuple[Column, Column]:
    """Number and suffix of an article reference such as 14, 14A, 14-A or 14 Bis; null where it has no such form."""
    plain = F.replace(F.replace(legal.strip(ref), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    form = r"^(\d+)([A-Za-z]*)$"
    base = F.nullif(F.regexp_extract(plain, form, 1), F.lit("")).try_cast("int")
    return base, F.nullif(F.lower(F.regexp_extract(plain, form, 2)), F.lit(""))


def article_sequence(tree: DataFrame) -> DataFrame:
    """doc_id, refs, disorder_ratio, max_gap, duplicate_ratio of the articles' references in order.

    The step from one article to the next is taken within blocks of ordinals and, between blocks, from the blocks' first and last articles.
    """
    refs = tree.where("node_type = 'article' AND article_ref IS NOT NULL").select("doc_id", "ord", "article_ref", sequence_parts(F.col("article_ref"))[0].alias("base"))
    numbered = refs.where("base IS NOT NULL").withColumn("block", F.floor(F.col("ord") / BLOCK))
    w = Window.partitionBy("doc_id", "block").orderBy("ord")
    steps = numbered.withColumn("gap", F.col("base") - F.lag("base").over(w)).groupBy("doc_id", "block").agg(
        F.count("*").alias("n"), F.count_if(F.col("gap") < 0).alias("down"), F.max("gap").alias("gap"), F.min_by("base", "ord").alias("first"), F.max_by("base", "ord").alias("last")
    )
    between = steps.withColumn("jump", F.col("first") - F.lag("last").over(Window.partitionBy("doc_id").orderBy("block")))
    seq = between.groupBy("doc_id").agg(
        F.sum("n").alias("bases"), F.sum(F.col("down") + F.when(F.col("jump") < 0, 1).otherwise(0)).alias("down"), F.greatest(F.max("gap"), F.max("jump"), F.lit(0)).alias("max_gap")
    )
    per = refs.groupBy("doc_id", "article_ref").agg(F.count("*").alias("c"))
    dup = per.groupBy("doc_id").agg(F.sum("c").alias("refs"), (F.sum("c") - F.count("*")).alias("dups"))
    got = dup.join(seq, "doc_id", "left")
    few = (F.col("refs") < 2) | (F.coalesce("bases", F.lit(0)) < 2)
    return got.select(
        "doc_id", "refs",
        F.when(few, 0.0).otherwise(F.round(F.col("down") / (F.col("bases") - 1), 4)).alias("disorder_ratio"),
        F.when(few, 0).otherwise(F.col("max_gap")).cast("int").alias("max_gap"),
        F.when(few, 0.0).otherwise(F.round(F.col("dups") / F.col("refs"), 4)).alias("duplicate_ratio"),
    )


def checks(tree: DataFrame) -> DataFrame:
    """One row per document with the figures of all checks.

    tree: doc_id, ord, parent_ord, node_id, node_type, heading, article_ref, page_number, and text or tokens (whether heading and text hold a table mark); optionally
    sources, the number of blocks a node comes from. A node's page is where it begins. Examples of date headings are at most five different entries.
    """
    heading = F.coalesce("heading", F.lit(""))
    token = F.col("tokens") if "tokens" in tree.columns else F.concat_ws(" ", heading, F.nullif("text", F.lit(""))).rlike(TABLE_TOKEN)
    sources = F.coalesce("sources", F.lit(0)) if "sources" in tree.columns else F.lit(1)
    nav, table = F.col("node_type").isin(structure.NAVIGABLE), F.col("node_type") == "table"
    flags = tree.select(
        "doc_id", "node_id",
        (nav & token).alias("tokens"), (nav & _any(heading, HEAD_FOOT)).alias("bleed"), (nav & _any(heading, DATES)).alias("dates"), F.when(nav & _any(heading, DATES), F.struct("ord", heading.alias("h"))).alias("dated"),
        (table & (F.col("page_number").isNull() | (sources < 1))).alias("orphans"), table.alias("tables"), (~F.col("node_type").isin(TYPES)).alias("unknown"), ((F.col("node_type") == "paragraph") & (F.col("parent_ord") == 0)).alias("loose"),
        (F.col("node_type") == "article").alias("articles"), ((F.col("node_type") == "article") & F.col("article_ref").isNotNull()).alias("referred"),
        F.when(nav, F.xxhash64("node_type", heading, "page_number")).alias("entry"),
    )
    names = ["tokens", "bleed", "dates", "orphans", "tables", "unknown", "loose", "articles", "referred"]
    per = flags.groupBy("doc_id", "entry").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in names], F.min("dated").alias("dated"))
    got = per.groupBy("doc_id").agg(
        F.sum("n").alias("nodes"), *[F.sum(c).alias(c) for c in names], F.sum(F.when(F.col("entry").isNotNull(), F.col("n"))).alias("entries"), F.count("entry").alias("distinct_entries"),
        F.transform(F.slice(F.array_sort(F.collect_list("dated")), 1, EXAMPLES), lambda x: x["h"]).alias("date_examples"),
    )
    ids = flags.where("entry IS NOT NULL").groupBy("doc_id", "node_id").agg(F.count("*").alias("c")).groupBy("doc_id").agg((F.sum("c") - F.count("*")).alias("repeated_ids"))
    seq = article_sequence(tree).drop("refs")
    return got.join(ids, "doc_id", "left").join(seq, "doc_id", "left").fillna(0, ["repeated_ids", "disorder_ratio", "max_gap", "duplicate_ratio", "entries"])


def verdicts(figures: DataFrame) -> DataFrame:
    """Adds to the figures of checks the derived ratios and, for each check, whether it passed (pass_...) and its part of the score (part_...)."""
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    c = F.col
    rows = figures.withColumns(
        {
            "degraded_ratio": ratio(c("unknown") + c("loose"), c("nodes")),
            "toc_duplicates": F.greatest(c("entries") - c("distinct_entries"), c("repeated_ids")),
            "coverage": F.when(c("articles") > 0, F.round(c("referred") / c("articles"), 4)).otherwise(F.lit(1.0)),
        }
    ).withColumn("toc_duplicate_ratio", ratio(c("toc_duplicates"), c("entries")))
    raw = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    passed = {
        "has_visible_table_tokens": c("tokens") == 0,
        "article_sequence_health": (c("disorder_ratio") < MOST_DISORDER) & (c("max_gap") <= MOST_GAP) & (c("duplicate_ratio") < MOST_REPEATED),
        "header_footer_bleed": c("bleed") == 0,
        "date_heading_false_positive_count": c("dates") == 0,
        "orphan_tables_count": c("orphans") == 0,
        "unknown_block_ratio": raw(c("unknown") + c("loose"), c("nodes")) < MOST_DEGRADED,
        "toc_duplicate_ratio": raw(c("toc_duplicates"), c("entries")) < MOST_DUPLICATED,
        "article_ref_coverage": (raw(c("referred"), c("articles")) >= LEAST_COVERED) | (c("articles") <= FEW_ARTICLES),
    }
    zero = lambda x: F.greatest(F.lit(0.0), x)
    gap = F.least(F.lit(1.0), F.greatest(F.lit(0), c("max_gap") - MOST_GAP) / 50) * 0.5
    part = {
        "has_visible_table_tokens": zero(1 - c("tokens") * 0.8),
        "article_sequence_health": zero(1 - F.least(F.lit(1.0), c("disorder_ratio") * 1.5 + c("duplicate_ratio") * 0.8 + gap)),
        "header_footer_bleed": zero(1 - c("bleed") * 0.4),
        "date_heading_false_positive_count": zero(1 - c("dates") * 0.15),
        "orphan_tables_count": zero(1 - raw(c("orphans"), c("tables"))),
        "unknown_block_ratio": zero(1 - c("degraded_ratio") * 2.0),
        "toc_duplicate_ratio": zero(1 - c("toc_duplicate_ratio") * 2.5),
        "article_ref_coverage": c("coverage"),
    }
    rows = rows.withColumns({f"pass_{k}": v for k, v in passed.items()})
    return rows.withColumns({f"part_{k}": F.when(c(f"pass_{k}"), 1.0).otherwise(v) for k, v in part.items()})


def scored(tree: DataFrame) -> DataFrame:
    """doc_id, nodes, score, severity, passed and the failing checks, in the order of the checks, of each document."""
    v = verdicts(checks(tree))
    score = sum((F.lit(w) * F.col(f"part_{k}") for k, w in WEIGHTS.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(~F.col(f"pass_{k}"), k) for k in WEIGHTS]))
    got = v.withColumn("score", F.round(score, 4)).withColumn("reasons", F.array_join(reasons, ","))
    return got.select("doc_id", "nodes", "score", severity(F.col("score")).alias("severity"), (F.col("score") >= MEDIUM).alias("passed"), "reasons")


def severity(score: Column) -> Column:
    return F.when(score >= LOW, "low").when(score >= MEDIUM, "medium").otherwise("high")


def gated(scores: DataFrame, threshold: float = 0.85, production: bool = True, allow_below: bool = False) -> DataFrame:
    """Adds gate (whether the new structure is used) and gate_reason: a score at or above the threshold, or below it where that is allowed outside production."""
    reached = F.col("score") >= threshold
    reason = F.when(reached, "quality_sufficient").when(F.lit(not production and allow_below), "low_quality_allowed_non_prod").otherwise("quality_insufficient")
    return scores.withColumns({"gate": reached | F.lit(not production and allow_below), "gate_reason": reason})


def corpus_metrics(records: DataFrame) -> DataFrame:
    """One row over the records (status, score, severity): documents by status, average, exact median, least and greatest score of the processed ones, severities."""
    ok = F.col("status") == "ok" if "status" in records.columns else F.lit(True)
    score = F.when(ok, F.col("score"))
    return records.agg(
        F.count("*").alias("documents"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("avg_score"),
        F.round(F.coalesce(F.median(score), F.lit(0.0)), 4).alias("median_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        *[F.count_if(ok & (F.col("severity") == s)).alias(f"{s}_documents") for s in ("low", "medium", "high")],
    )


def score_buckets(scores: DataFrame) -> DataFrame:
    """All four buckets with their counts, also where empty."""
    names = ["0.0-0.5", "0.5-0.7", "0.7-0.85", "0.85-1.0"]
    s = F.col("score")
    bucket = F.when(s < 0.5, names[0]).when(s < 0.7, names[1]).when(s < 0.85, names[2]).otherwise(names[3])
    per = scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    dim = scores.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return dim.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("documents"))


def failure_reasons(scores: DataFrame) -> DataFrame:
    """reason, documents, place: failing checks by how many documents fail them, equally frequent ones in the order of the checks."""
    order = {k: i for i, k in enumerate(WEIGHTS)}
    at = F.lit(len(order))
    for k, i in order.items():
        at = F.when(F.col("reason") == k, i).otherwise(at)
    per = scores.where("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("documents"), at)))  # at most one row per check


def problematic(records: DataFrame, least: float = LOW, include_passed: bool = False) -> DataFrame:
    """Failed records, and processed ones with a score below the least or high severity, or all with include_passed; the lowest scores are the worst."""
    ok = F.col("status") == "ok" if "status" in records.columns else F.lit(True)
    return records.where(~ok | F.lit(include_passed) | (F.col("score") < least) | (F.col("severity") == "high"))


def compared(left: DataFrame, right: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Per document, two versions of its chunks (documentId, chunkType, articleRef, heading, text): counts, tables, notes, reference coverage, visible table marks,
    heading quality and its difference, distributions of types, and a summary of what differs. scores: documentId and score of the right version."""

    def side(chunks: DataFrame, s: str) -> DataFrame:
        kind = F.coalesce("chunkType", F.lit(""))
        h = legal.strip(F.coalesce("heading", F.lit("")))
        art = kind.isin("article", "transitorio", "transitory")
        referred = legal.strip(F.coalesce("articleRef", F.lit(""))) != ""
        fine = (h != "") & ~h.rlike(TABLE_TOKEN) & (F.length(h) <= 300)
        token = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit(""))).rlike(TABLE_TOKEN)
        rows = chunks.select("documentId", kind.alias("k"), art.alias("a"), (art & referred).alias("r"), fine.alias("g"), token.alias("t"))
        per = rows.groupBy("documentId", "k").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in "argt"])
        got = per.groupBy("documentId").agg(
            F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in "argt"], F.sum(F.when(F.col("k") == "table", F.col("n")).otherwise(0)).alias("tables"), F.sum(F.when(F.col("k") == "boxed_note", F.col("n")).otherwise(0)).alias("notes"),
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("types"),
        )
        cover = F.when(F.col("a") > 0, F.col("r") / F.col("a")).otherwise(F.lit(1.0))
        return got.select(
            "documentId", F.col("n").alias(f"{s}_chunks"), F.round(cover, 4).alias(f"{s}_coverage"), F.col("tables").alias(f"{s}_tables"), F.col("notes").alias(f"{s}_notes"), (F.col("t") > 0).alias(f"{s}_tokens"),
            (F.col("g") / F.col("n")).alias(f"_{s}_quality"), F.col("types").alias(f"{s}_types"),
        )

    both = side(left, "left").join(side(right, "right"), "documentId", "full_outer")
    both = both.fillna(0, [f"{s}_{c}" for s in ("left", "right") for c in ("chunks", "tables", "notes")]).fillna(1.0, [f"{p}{s}_{c}" for p, c in (("", "coverage"), ("_", "quality")) for s in ("left", "right")]).fillna(False, ["left_tokens", "right_tokens"])
    both = both.fillna("{}", ["left_types", "right_types"]).withColumn("heading_quality_delta", F.round(F.col("_right_quality") - F.col("_left_quality"), 4)).drop("_left_quality", "_right_quality")
    signed = lambda c, form: F.format_string(form, c)
    diff, tables = F.col("right_chunks") - F.col("left_chunks"), F.col("right_tables") - F.col("left_tables")
    parts = F.array_compact(F.array(
        F.when(diff != 0, signed(diff, "chunk_count_delta=%+d")), F.when(F.col("heading_quality_delta") != 0, signed(F.col("heading_quality_delta"), "heading_quality_delta=%+.4f")),
        F.when(F.col("left_tokens") & ~F.col("right_tokens"), "v2_removed_table_tokens"), F.when(~F.col("left_tokens") & F.col("right_tokens"), "v2_introduced_table_tokens"), F.when(tables != 0, signed(tables, "table_count_delta=%+d")),
    ))
    both = both.withColumn("summary", F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("no_significant_differences"))
    return both.join(scores.select("documentId", F.col("score").alias("right_score")), "documentId", "left") if scores is not None else both
