"""Legends and headings of documents from their first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal

# --- Fixed values: forms of the legends that laws carry, and how much of a document is searched for them ---
LAST_REFORM = r"(?iU)(?:última|ultima)s?\s+reformas?\s+(?:publicadas?\s+)?dof\s+(\d{2})-(\d{2})-(\d{4})"
NEW_LAW = rf"(?iU)nueva\s+ley\s+publicada\s+en\s+el\s+diario\s+oficial\s+de\s+la\s+federaci[oó]n\s+el\s+(\d{{1,2}})\s+de\s+({'|'.join(legal.MONTHS)})\s+de\s+(\d{{4}})"
IN_FORCE = r"(?iU)\bTEXTO\s+VIGENTE\b"
AMOUNTS = r"(?iU)cantidades\s+actualizadas\s+por\s+[^.]*dof\s+(\d{2})-(\d{2})-(\d{4})"
FIRST_CHARS = 8000
#: First words of lines that go on with a sentence, and lines of the gazette's masthead.
CONTINUATION = (
    r"(?iU)^(considera|consideró|consideran|deberá|deberán|podrá|podrán|tendrá|tendrán|habrá|habrán|resulta|resultan|establece|establecen|determina|determinan|"
    r"dispone|disponen|autoriza|autorizan|ordena|ordenan|precisa|precisan|señala|señalan|define|definen|otorga|otorgan|fundamento)\b\s+"
)
SUSPICIOUS = r"(?iU)^casos,\s*se\s+|^(de esta ley|de la presente ley|de este código|de este codigo)\b"
MASTHEAD = r"(?iU)^\(?\s*Edici[oó]n\s+Vespertina\s*\)?\s*$|^DIARIO\s+OFICIAL\b|^PODER\s+EJECUTIVO\s*$"
WEEKDAY = r"(?iU)^(?:Lunes|Martes|Miércoles|Miercoles|Jueves|Viernes|Sábado|Sabado|Domingo)\b"


def _day(c: Column, pattern: str) -> Column:
    got = F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(c, pattern, 3), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 1)), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(got).between(1900, 2100), got)


def legal_legend(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, legend, publication_date, last_reform_date from the lines of the first 8000 characters; the last date of a kind holds, each phrase stands once."""
    lines = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.posexplode(F.split(F.substring(text, 1, FIRST_CHARS), "\r\n|\n|\r")).alias("n", "raw"))
    lines = lines.withColumn("line", legal.strip(F.col("raw"))).where(F.length("line") >= 10)
    c = F.col("line")
    kind = F.when(c.rlike(LAST_REFORM), "ultima").when(c.rlike(NEW_LAW), "nueva").when(c.rlike(IN_FORCE), "vigente").when(c.rlike(AMOUNTS), "cantidades")
    day = F.when(kind == "ultima", _day(c, LAST_REFORM)).when(kind == "nueva", legal.spanish_date(c)).when(kind == "cantidades", _day(c, AMOUNTS))
    phrase = F.when(kind == "ultima", F.regexp_extract(c, LAST_REFORM, 0)).when(kind == "nueva", F.regexp_extract(c, NEW_LAW, 0)).when(kind == "cantidades", F.regexp_extract(c, AMOUNTS, 0)).otherwise(c)
    got = lines.select("k", "n", kind.alias("kind"), day.alias("day"), phrase.alias("phrase")).where("kind IS NOT NULL AND (kind = 'vigente' OR day IS NOT NULL)")
    per = got.groupBy("k", "kind").agg(F.min(F.struct("n", "phrase")).alias("first"), F.max(F.struct("n", "day")).alias("last"))
    out = per.groupBy("k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["phrase"]), " ").alias("legend"),
        F.max(F.when(F.col("kind") == "nueva", F.col("last.day"))).alias("publication_date"),
        F.max(F.when(F.col("kind") == "ultima", F.col("last.day"))).alias("last_reform_date"), F.count("*").cast("int").alias("kinds"),
    )
    return out.select(F.col("k").alias(key), legal.squeeze(F.col("legend")).alias("legend"), "publication_date", "last_reform_date", "kinds")


def decree_rubric(text: Column) -> Column:
    """The sentence 'DECRETO por el que ...', at most 500 characters; null where there is none."""
    got = F.regexp_extract(text, r"(?iU)DECRETO\s+por\s+el\s+que\s+[\s\S]*?\.", 0)
    return F.when(got != "", F.substring(legal.squeeze(got), 1, 500))


def cut_at_word(text: Column, most: int) -> Column:
    """At most so many characters, cut at a blank, with an ellipsis where cut."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit("…")))


def decree_context(title: Column, head: Column) -> Column:
    """The document is a decree: by its title, or by a rubric in the first 4000 characters."""
    return (legal.doc_type(title) == "decreto") | F.coalesce(decree_rubric(F.substring(head, 1, 4000)).isNotNull(), F.lit(False))


def first_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, text of a document's first pages, joined by line feeds."""
    rows = pages.where((F.col("page_number") >= 1) & (F.col("page_number") <= most)).where("doc_id IS NOT NULL").groupBy("doc_id", "page_number").agg(F.max("text").alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def generic_heading(text: Column, title: Column, decree: Column | None = None) -> Column:
    """Heading of a chunk without structure: the decree's rubric, its first line that isn't a continuation, or the law's name. decree: whether the document is one, by default by its title."""
    decree = legal.doc_type(title) == "decreto" if decree is None else decree
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), legal.strip), lambda x: x != "")
    preamble = lambda x: (F.length(x) >= 40) & x.rlike(WEEKDAY) & x.rlike(rf"(?iU)\d{{1,2}}\s+de\s+(?:{'|'.join(legal.MONTHS)})\s+de\s+\d{{4}}") & x.rlike(r"\bQue\s+|(?i)Edici[oó]n\s+Vespertina")
    lines = F.filter(lines, lambda x: ~(decree & (x.rlike(MASTHEAD) | preamble(x))))
    good = F.filter(lines, lambda x: ~x.rlike(CONTINUATION))
    first = F.try_element_at(good, F.lit(1))
    name = F.when(legal.law_name(title) != "", legal.law_name(title))
    long = decree & (F.length(first) >= 120)
    return F.coalesce(F.when(decree, decree_rubric(text)), F.when(long, F.coalesce(name, cut_at_word(first, 120))), first, name, cut_at_word(F.try_element_at(lines, F.lit(1)), 120), F.lit(""))


def suspicious_heading(heading: Column) -> Column:
    """Stored headings that may be the middle of a sentence."""
    h = legal.strip(F.coalesce(heading, F.lit("")))
    return (h != "") & (h.rlike(CONTINUATION) | h.rlike(SUSPICIOUS))
