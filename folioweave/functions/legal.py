"""Scalar functions and predicates of the legal-text pipeline as Column expressions.

Patterns run in the JVM's regular expressions with (?U), so letters, digits and blanks are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the patterns and word lists by which legal structure is told ---

ROMAN = r"(?:[IVX]+|M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))(?!\w)"
ORDINALS = "|".join(
    [rf"vig[eé]simo\s+{w}" for w in ("noveno", "octavo", "s[eé]ptimo", "sexto", "quinto", "cuarto", "tercero", "segundo", "primero")]
    + ["vig[eé]simo"]
    + [rf"d[eé]cimo\s+{w}" for w in ("noveno", "octavo", "s[eé]ptimo", "sexto", "quinto", "cuarto", "tercero")]
    + ["und[eé]cimo", "duod[eé]cimo", "d[eé]cimo", "primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "s[eé]ptimo", "octavo", "noveno", "[uú]nico"]
)
STRICT_NUMBER = rf"(?:{ROMAN}|\d+[º°o]?)"
FLEXIBLE_NUMBER = rf"(?:{ORDINALS}|{ROMAN}|\d+[º°o]?)"
ARTICLE_NUMBER = rf"(?:\d+[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)+|\d+[º°o]?(?:\.[\s\-]*[A-Za-z](?=[.\s]|$))|\d+[º°o]?(?:\.\s*Bis)?|{FLEXIBLE_NUMBER})"
BOOK = rf"(?U)^[Ll]ibro\s+{STRICT_NUMBER}[\.\sº°o\-]*"
TITLE = rf"(?iU)^([Tt][íi]tulo|[Tt]ema)\s+({STRICT_NUMBER})[\.\sº°o\-]*"
CHAPTER = rf"(?iU)^[Cc]ap[íi]tulo\s+({STRICT_NUMBER})[\.\sº°o\-]*"
SECTION = rf"(?iU)^[Ss]ecci[óo]n\s+((?:{ROMAN}|\d+(?:\.\d+)+))[\.\sº°o\-]*"
ANNEX = rf"(?iU)^[Aa]nexo\s+(?:{STRICT_NUMBER}|[A-Z])[\.\sº°o\-]*"
ARTICLE = rf"(?iU)^Art[íi]culo\s+({ARTICLE_NUMBER})[\.\sº°o]*"
RULE = r"(?U)^[Rr]egla\s+\d+(?:\.\d+)+[\.\sº°o\-]*"
NUMERAL = r"(?U)^[Nn]umeral\s+\d+[\.\sº°o\-]*"
FRACTION = r"(?U)^[IVXivx]+[\.\-]+[\s]*"
INCISO = r"(?U)^[a-zA-Z]\)\s"
TRANSITORY_HEADER = r"(?iU)^(?:ART[ÍI]CULOS?\s+TRANSITORIOS?|TRANSITORIOS?|Transitorio)\s*$"
TRANSITORY_ORDINAL = (
    r"^(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO"
    r"|Primero|Segundo|Tercero|Cuarto|Quinto|Sexto|Séptimo|Octavo|Noveno|Décimo)[\.\-]+"
)
TABLE_MARK = r"^\[TABLE_\d+\]"
NUMBER_CONTINUES = r"(?iU)^(\d+[º°o]?)(?:\.-\s*|\.\s+)[A-Za-z]"
ARTICLE_LABEL = r"(?iU)^Art[íi]culo\s*$"
NUMBER_AFTER_REFORM = r"(?iU)^(\d+[º°o]?)(?:\.-\s*|\.\s*)"
REFORM_NOTE = (
    r"(?iU)^(Art[íi]culo|P[áa]rrafo|Fracc[ií][óo]n|Secci[óo]n|Cap[íi]tulo|T[íi]tulo)\s+(reformad[oa]|adicionad[oa]|derogad[oa])\s*\.?\s*DOF"
)
REFORM = r"(?iU)^Reforma\s+DOF"
PAGINATION = r"(?U)^\d+\s+de\s+\d+$"
INLINE_ARTICLE = r"(?iU)^de (esta|la presente)\s+(Ley|ley)|^del presente|^de este (Código|código|ordenamiento|cuerpo)"
TRANSITORY_CITATION = r"(?iU)^Transitori[oa]\s+(del|de la|de los|de las)\s"
EDITORIAL_NOTE = r"(?iU)^(?:ACLARACI[OÓ]N|Nota\s*de\s+erratas|Fe\s+de\s+erratas|N\.\s*de\s+E\.|NOTA\s+DEL\s+EDITOR|Nota\s*:\s)"
BODY_PHRASE = (
    r"(?iU)^(con el |con la |con el factor |de este |de la presente |de la |de los |de las |de la ley |se considera|se señalan|se refiere|"
    r"partir del |partir de la |partir de los |partir de |del cap[íi]tulo |del t[íi]tulo |del c[oó]digo |primera del |segunda del |"
    r"tercera del |cuarta del |quinta del |sexta del |s[eé]ptima del |octava del |novena del |d[eé]cima del |que incluye |"
    r"incluye los art[íi]culos |, del |, de la |, de los |, de las |del T[íi]tulo |de esta Ley[,.]?\s*|de la presente Ley[,.]?\s*|"
    r"de este C[oó]digo[,.]?\s*|del\s)"
)
BODY_BEFORE = (
    r"(?iU)(?:La denominación del|denominación del|señalados en el|señaladas en el|señalado en el|señalada en el|referido en el|referida en el|"
    r"mencionado en el|mencionada en el|indicado en el|indicada en el|establecido en el|establecida en el|previsto en el|prevista en el|"
    r"del cap[íi]tulo|del t[íi]tulo|del art[íi]culo|del libro|de la secci[óo]n|permisibles\s+señalado|permisibles\s+señalada|establecidos|"
    r"previstos|mencionados|referidos)"
)
CONTINUATION_BEFORE = r"(?iU)\b(?:del|en el|de la|de los|de las|en la)\s*$"
KEYWORD_BEFORE = r"(?iU)^(?:permisibles|establecidos|previstos|mencionados|referidos)\s*$"
HEADER_PATTERNS = [
    r"(?U)^\d+\s+de\s+\d+$",
    r"(?iU)^Página\s+\d+",
    r"(?U)^[A-ZÁÉÍÓÚÑ\d\s(),.\-]{8,250}$",
    r"(?iU)CÁMARA DE DIPUTADOS",
    r"(?iU)Secretaría General",
    r"(?iU)Secretaría de Servicios Parlamentarios",
    r"(?iU)Última Reforma DOF \d{2}-\d{2}-\d{4}",
]
REFORM_LEGEND = r"(?iU)Art[íi]culo\s+(reformad[oa]|adicionad[oa]|derogad[oa])\s*\.?\s*DOF"
PRESERVED = [
    (rf"(?iU)^(Artículo|ART[IÍ]CULO)\s+(\d+[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)*\b|{ORDINALS})\b", "articulo"),
    (r"(?iU)^Art\.\s*\d+(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)*\b", "articulo_abbrev"),
    (r"(?iU)^(Capítulo|Título|Sección)\b", "titulo_capitulo_seccion"),
    (r"(?iU)^(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s*", "romanos"),
    (r"(?iU)^[a-z]\)\s*(?:\.-|\.)?\s*", "inciso"),
    (r"(?U)^\d+\.\s+", "lista_numerica"),
    (r"(?iU)^(Fracción|Inciso)\s+", "fraccion_inciso"),
    (r"(?U)^\$\s*[\d,]+\.?\d*\s+.*\$\s*[\d,]+", "tabla_fila"),
    (r"(?U)^\d[\d,]*\.?\d*\s+[\d,]+\.?\d*\s+[\d,]+\.?\d*\s+[\d.]+", "tabla_fila"),
    (r"(?iU)^\d[\d,]*\.?\d*\s+En adelante\s+[\d,]+\.?\d*\s+[\d.]+", "tabla_fila"),
    (r"(?iU)(?:Reforma|derog[oó]|adicion[oó]|reformad[oa])\s+.*DOF|\d{4}\)\s+Reforma\s+DOF", "reform_note"),
    (TRANSITORY_HEADER, "transitorios"),
    (r"(?iU)^(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO)\s*[\.\-]+", "transitorio_ordinal"),
]
BLOCK_START = (
    r"(?iU)^(CONSIDERANDO|EXPIDIENDO|EXHORTANDO|ART[ÍI]CULO|ART\.\s*\d|T[ÍI]TULO|CAP[ÍI]TULO|SECCI[ÓO]N|TRANSITORIOS?|ÚNICO|VISTO|PUNTOS?\s+DE\s+ACUERDO|"
    r"CÁMARA\s+DE\s+DIPUTADOS|DECRETO\s+por\s+el\s+que)\b"
)
OWN_ROW = (
    r"(?iU)^(?:(?:CONSIDERANDO|EXPIDIENDO|EXHORTANDO|DECRETO\s+por\s+el\s+que|T[ÍI]TULO|CAP[ÍI]TULO|SECCI[ÓO]N|TRANSITORIOS?|ÚNICO|VISTO|PUNTOS?\s+DE\s+ACUERDO|"
    r"CÁMARA\s+DE\s+DIPUTADOS)\b|Al\s+margen\b)"
)
CUT_AT_END = [r"(?iU)(?:artí|durant)$", r"(?iU),\s*(se|le|les|nos|me|te|lo|los|las)$", r"(?iU) [a-záéíóúñ]$"]
MID_WORD = r"(?iU)^(?:culos|on|e)\b"
VERB_START = (
    r"(?U)^(?=\p{Ll})(?i:considera|consideró|consideran|deberá|deberán|podrá|podrán|tendrá|tendrán|habrá|habrán|resulta|resultan|establece|establecen|determina|determinan|"
    r"dispone|disponen|autoriza|autorizan|ordena|ordenan|precisa|precisan|señala|señalan|define|definen|otorga|otorgan|fundamento)\b\s+"
)
ARTICLE_ALONE = r"(?iU)^Art[íi]culo\s+\d+[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)*(?:\s*[.\-]*\s*)?$"
ARTICLE_DASH = r"(?iU)Art[íi]culo\s+\d+[º°o]?-$"
ARTICLE_TAIL = r"(?iU)Art[íi]culo\s+\d+(?:[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)*)?-\s*$"
LETTER_ALONE = r"^[A-Z]\.$"
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
DOC_TYPES = [
    ("reglamento", ["reglamento"]),
    ("codigo", ["código", "codigo"]),
    ("presupuesto", ["presupuesto"]),
    ("decreto", ["decreto"]),
    ("acuerdo", ["acuerdo"]),
    ("norma", ["norma", "nom-"]),
    ("ley", ["ley"]),
]
STOP_WORDS = "a al ante bajo con contra de del desde el en entre es esta este la las lo los mas ni no o para pero por que se sin sobre su sus un una y ya".split()

BLOCK_NOTE = r"(?iU)(?:ACLARACI[OÓ]N|Fe\s+de\s+erratas|N\.\s*de\s+E\.|NOTA\s+(?:DEL\s+EDITOR|ACLARATORIA|editorial)|Art[íi]culo\s+(?:reformad[oa]|adicionad[oa]|derogad[oa])\b|Correcci[oó]n|AVISO)"
BLOCK_ORDINAL = (
    r"(?iU)^\s*(?:Primero|Segundo|Tercero|Cuarto|Quinto|Sexto|S[eé]ptimo|Octavo|Noveno|D[eé]cimo|Und[eé]cimo|Duod[eé]cimo|"
    r"D[eé]cimo\s*(?:primer|segund|tercer|cuart|quint|sext|s[eé]ptim|octav|noven)o?|Vig[eé]simo|Trig[eé]simo|Cuadrag[eé]simo|Quincuag[eé]simo)\s*[.\-–—]"
)
INLINE_REFERENCE = (
    r"(?iU)(?:conforme|conform[ea]|según|previsto|dispuesto|establecid[oa]|señalad[oa]|referid[oa]|contenid[oa]|indicad[oa]|mencionad[oa]|"
    r"de\s+(?:acuerdo|conformidad)|en\s+(?:t[eé]rminos|los\s+t[eé]rminos)|(?:el|del|al|los|las|un)\s+)\s*(?:art[ií]culo|art\.)\s+\d+"
)
OPENS_ARTICLE = r"(?iU)^\s*Art[ií]culo\s+\d+[\s\w]*[.\-–—]"
OPENS_FRACTION, OPENS_ITEM = r"(?U)^\s*[IVXLCDM]+\s*[.\-–—]", r"(?U)^\s*[a-z]\)\s"
DATE_ALONE = rf"(?iU)^\s*\d{{1,2}}\s+DE\s+(?:{'|'.join(MONTHS)})\s+DE\s+\d{{4}}\s*$"
TITLE_WORDS = r"(?iU)\b(LEY|DECRETO|REGLAMENTO|CÓDIGO|ESTATUTO|ACUERDO|NORMA|CONSTITUCIÓN|PRESUPUESTO|LINEAMIENTOS?)\b"
ACRONYM_STOPS = "de del la los las el sobre en para por al con que y e o u federal general nacional nueva".split()

# --- Expressions ---


#: All blanks of Unicode.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: How a line with legal structure may begin; any other line is generic.
_STRUCTURED = (
    r"(?iu)^(?:libro|t[íi]tulo|tema|cap[íi]tulo|secci[óo]n|anexo|art[íi]culo|regla|numeral|[ivx]+[.\-]|[a-z]\)|transitorio|"
    r"primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo|\[table_|\d)"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def squeeze(c: Column) -> Column:
    """Blanks of any kind as single spaces."""
    return strip(F.when(c.rlike(r"  |(?U)[\s&&[^ ]]"), F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(c))


def always_removed(line: Column) -> Column:
    t = strip(line)
    return t.rlike(PAGINATION) | t.rlike(r"(?iU)^Página\s+\d+")


def header_candidate(line: Column) -> Column:
    t = strip(line)
    return (F.length(t) <= 250) & t.rlike("|".join(f"(?:{p})" for p in HEADER_PATTERNS))


def preservation_rule(line: Column) -> Column:
    """Name of the first rule that keeps a line break, else null."""
    t = strip(line)
    out = F.when(t.rlike(PRESERVED[0][0]), PRESERVED[0][1])
    for pattern, name in PRESERVED[1:]:
        out = out.when(t.rlike(pattern), name)
    return out


def own_row(line: Column) -> Column:
    """Lines of a gazette's masthead, rubric or marginal note, which are never joined with others."""
    return strip(line).rlike(OWN_ROW)


def cut_at_end(line: Column) -> Column:
    """The line ends within a word or before the rest of its clause."""
    t, out = strip(line), F.lit(False)
    for p in CUT_AT_END:
        out = out | t.rlike(p)
    return out


def cut_at_start(line: Column) -> Column:
    """The line begins with the second half of a word or with the verb of the clause before it."""
    t = strip(line)
    return t.rlike(MID_WORD) | t.rlike(VERB_START)


def stray_blank(before: Column, after: Column) -> Column:
    """A blank line between the two is an artefact of layout: they belong together."""
    a, b = strip(before), strip(after)
    signs = cut_at_end(a) | cut_at_start(b)
    return F.coalesce((a != "") & (b != "") & preservation_rule(b).isNull() & ~b.rlike(BLOCK_START) & (merge_score(a, b) >= 2) & signs, F.lit(False))


def squeezed_breaks(text: Column) -> Column:
    """At most two line feeds in a row, without blanks around the text."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"))


def merge_score(before: Column, after: Column) -> Column:
    """How strongly two lines belong together; 0 where either is blank."""
    p, n = strip(before), strip(after)
    point = lambda cond, v: F.when(cond, v).otherwise(0)
    capitals = n.rlike(r"^[^a-záéíóúñü]*$") & n.rlike("[A-Z]") & (F.length(n) < 60)
    score = (
        point(~p.rlike(r"[.?!;:]$"), 2)
        + point(p.rlike(r"""[,("']$"""), 1)
        + point(n.rlike(r"^[a-záéíóúñü0-9]"), 1)
        + point(F.length(n) > 20, 1)
        - point(capitals, 2)
        - point((F.length(n) < 10) & ~n.rlike(r"[.,;:?!-]"), 2)
        - point(p.rlike(r"[)\]]$"), 1)
    )
    return F.when((F.coalesce(F.length(p), F.lit(0)) == 0) | (F.coalesce(F.length(n), F.lit(0)) == 0), 0).otherwise(score)


def article_number(raw: Column) -> Column:
    """1o and 1º become 1; 14-A and 3 Bis are kept; ordinal words pass through; null becomes empty."""
    t = strip(F.coalesce(raw, F.lit("")))
    bis, dashed = r"(?iU)^(\d+)[º°o]?\.?\s*Bis$", r"(?iU)^(\d+)[º°o]?\.?\s*-\s*([A-Za-z])"
    return (
        F.when(t.rlike(bis), F.concat(F.regexp_extract(t, bis, 1), F.lit(" Bis")))
        .when(t.rlike(dashed), F.concat_ws("-", F.regexp_extract(t, dashed, 1), F.regexp_extract(t, dashed, 2)))
        .when(t.rlike(r"(?U)\d+(-\s*[A-Za-z0-9]+)+$"), t)
        .otherwise(strip(F.regexp_replace(t, r"(?iU)^(\d+)[º°o]\s*$", "$1")))
    )


def sequence_base(ref: Column) -> Column:
    """The first number of an article reference."""
    return F.regexp_extract(F.coalesce(ref, F.lit("")), r"(\d+)", 1).try_cast("int")


def doc_type(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for name, words in DOC_TYPES:
        cond = low.contains(words[0])
        for w in words[1:]:
            cond = cond | low.contains(w)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("otro")


def law_acronym(title: Column) -> Column:
    """The first letters, in capitals, of a title's words but for those that don't count; of fewer than two letters the title's beginning."""
    t = F.coalesce(title, F.lit(""))
    words = F.filter(F.split(squeeze(t), " "), lambda w: w.rlike(r"^\p{L}") & ~F.lower(w).isin(ACRONYM_STOPS))
    letters = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(letters) < 2, strip(F.substring(t, 1, 50))).otherwise(letters)


def law_name(title: Column) -> Column:
    """The title without trailing parentheses, at most 255 characters."""
    return F.substring(strip(F.regexp_replace(strip(title), r"(?U)\s*\([^)]*\)\s*$", "")), 1, 255)


def iso_date(c: Column) -> Column:
    """Date of the first ten characters, null where they are none."""
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def spanish_date(c: Column) -> Column:
    """The first '1 de abril de 2024' in a text as a date, null where there is none or it is no day of 1900 to 2100."""
    pattern = rf"(?iU)(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)})\s+de\s+(\d{{4}})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, pattern, 2)))
    day, year = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 3)
    got = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(got).between(1900, 2100), got)


def signature(text: Column) -> Column:
    """A line's form for finding repetitions: capitals, dates and numbers as marks, single blanks."""
    low = F.lower(text)
    t = F.regexp_replace(low, rf"(?U)\b\d{{1,2}}\s*(?:de\s+)?(?:{'|'.join(MONTHS)})(?:\s*(?:de|del)\s*\d{{2,4}})?\b", "<<date>>")
    t = F.regexp_replace(t, r"(?U)\b(?:folio|n[uú]m(?:ero)?|no\.)?\s*\d+\b", "<<num>>")
    return F.upper(squeeze(F.when(low.rlike(r"\p{Nd}"), t).otherwise(low)))


def word_count(text: Column) -> Column:
    """Words parted by blanks."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def search_tokens(text: Column) -> Column:
    """Distinct lower-case words without accents and stop words, sorted; an approximation of a Spanish text-search vector, without stemming."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "áéíóúüñ", "aeiouun")
    words = F.filter(F.split(t, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_sort(F.array_distinct(words))


def date_heading(text: Column) -> Column:
    """Text that is a date rather than a heading."""
    t = strip(text)
    months = "|".join(MONTHS)
    city = rf"(?iU)^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+de\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?,?\s+\d{{1,2}}\s+de\s+(?:{months})"
    return (
        t.rlike(DATE_ALONE)
        | (t.rlike(city) & (F.length(t) < 120))
        | (t.rlike(r"(?iU)\bDOF\s+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b") & (F.length(t) < 100))
    )


def upper_ratio(text: Column) -> Column:
    """Share of capitals among letters, of at least one."""
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(1))


def document_title(text: Column) -> Column:
    t = strip(text)
    return F.length(t).between(5, 300) & ~date_heading(t) & (upper_ratio(t) >= 0.6) & t.rlike(TITLE_WORDS)


def line_type(line: Column, before: Column, after: Column) -> Column:
    """struct(type, ref): a line's legal structure by ordered rules, from the stripped line and its neighbours.

    Most lines are told generic by one pattern; give columns, not expressions, so that nothing is computed twice.
    """
    t, before, after = line, F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    number = lambda c: strip(c).rlike(r"(?iU)^[IVX\d]+[º°o]?$")
    rest = lambda p: strip(F.regexp_replace(t, p, ""))

    def container(pattern: str, group: int) -> Column:
        """True where a title or chapter line is really body text."""
        r = rest(pattern)
        cited = before.rlike(KEYWORD_BEFORE) & (r != "") & r.rlike(r"(?i)señalado en el|señalada en el")
        below = (r == "") & (after != "") & (after.rlike(BODY_PHRASE) | after.rlike(r"(?iU)^del\s|^de esta Ley|^de la presente Ley"))
        return ~number(F.regexp_extract(t, pattern, group)) | r.rlike(BODY_PHRASE) | r.rlike(r"(?iU)^del\s") | before.rlike(BODY_BEFORE) | before.rlike(CONTINUATION_BEFORE) | cited | below

    note_before = before.rlike(r"(?iU)(?:Reforma|derog[oó]|adicion[oó]|reformad[oa])\s+.*DOF") | before.rlike(r"(?U)\d{2}-\d{2}-\d{4}\s*$")
    article_rest = rest(ARTICLE)
    article_raw = strip(F.regexp_extract(t, ARTICLE, 1))
    cites = (
        (article_raw == "")
        | article_raw.rlike(r"(?iU)^[uú]nico$")
        | (t.startswith("artículo") & ~(before.rlike(r"[.;:]$") | (before == "")) & ~note_before)
        | ((article_rest != "") & (article_rest.rlike(INLINE_ARTICLE) | article_rest.rlike(TRANSITORY_CITATION)))
    )
    reform_context = (F.length(strip(before)) >= 10) & before.rlike(
        r"(?iU)(?:Reforma|derog[oó]|adicion[oó]|reformad[oa])\s+.*DOF|\d{4}\)\s+Reforma\s+DOF|\d{2}-\d{2}-\d{4}\s*:?\s*(?:Derogó|Adicionó|Reformó)"
    )
    section = strip(F.regexp_extract(t, SECTION, 1))
    book_word = F.split(rest(BOOK), r"(?U)\s+").getItem(0)
    kind = lambda name, ref=None: F.struct(F.lit(name).alias("type"), (ref if ref is not None else F.lit(None).cast("string")).alias("ref"))
    generic = kind("generic")
    tag = lambda raw: F.concat(F.lit("Art. "), article_number(raw), F.lit("."))
    return (
        F.when(t.isNull() | (F.length(t) < 5) | ~t.rlike(_STRUCTURED), generic)
        .when(t.rlike(REFORM_NOTE) | t.rlike(REFORM) | t.rlike(PAGINATION) | t.rlike(EDITORIAL_NOTE), generic)
        .when(t.rlike(BOOK), F.when(number(book_word), kind("book")).otherwise(generic))
        .when(t.rlike(TITLE), F.when(container(TITLE, 2), generic).otherwise(kind("title")))
        .when(t.rlike(CHAPTER), F.when(container(CHAPTER, 1), generic).otherwise(kind("chapter")))
        .when(t.rlike(SECTION), F.when(section.rlike(r"(?iU)^[IVX]+[º°o]?$") | section.rlike(r"(?U)^\d+(?:\.\d+)+$"), kind("section")).otherwise(generic))
        .when(t.rlike(ANNEX), kind("annex"))
        .when(t.rlike(ARTICLE), F.when(cites, generic).otherwise(kind("article", F.concat(F.lit("Artículo "), article_number(article_raw)))))
        .when(t.rlike(RULE), kind("rule"))
        .when(t.rlike(NUMERAL), kind("numeral"))
        .when(t.rlike(FRACTION), kind("fraction"))
        .when(t.rlike(INCISO), kind("inciso"))
        .when(t.rlike(TRANSITORY_HEADER), kind("transitorio"))
        .when(t.rlike(TRANSITORY_ORDINAL), F.when((before != "") & ~before.rlike(r"(?U)[\.:;]\s*$"), generic).otherwise(kind("transitorio")))
        .when(t.rlike(TABLE_MARK), kind("table"))
        .when(t.rlike(NUMBER_CONTINUES) & strip(before).rlike(ARTICLE_LABEL), kind("article", tag(F.regexp_extract(t, NUMBER_CONTINUES, 1))))
        .when(t.rlike(NUMBER_AFTER_REFORM) & reform_context, kind("article", tag(F.regexp_extract(t, NUMBER_AFTER_REFORM, 1))))
        .otherwise(generic)
    )


def opens_article(line: Column) -> Column:
    """The line opens an article and doesn't merely refer to one."""
    return line.rlike(OPENS_ARTICLE) & ~line.rlike(INLINE_REFERENCE)


def block_label(text: Column, kind: Column, source: Column, index_zone: Column, boxed: Column) -> Column:
    """struct(label, confidence, reason) of a layout block by ordered rules."""
    t = strip(F.coalesce(text, F.lit("")))
    line = strip(F.split(t, "\n").getItem(0))
    got = lambda a, b, c: F.struct(F.lit(a).alias("label"), F.lit(b).alias("confidence"), F.lit(c).cast("string").alias("reason"))
    heading = lambda word: line.rlike(rf"(?iU)^\s*{word}\s+[IVXLCDM\d]+")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(kind == "header"), got("page_header", 0.95, "kind_header_from_normalizer"))
        .when(yes(kind == "footer"), got("page_footer", 0.95, "kind_footer_from_normalizer"))
        .when(yes(source == "pymupdf_table") | yes(kind == "table"), got("table", 0.95, "table_signal"))
        .when(line.rlike(BLOCK_NOTE) | yes(kind == "boxed_note") | yes(boxed), got("editorial_note", 0.95, "editorial_note_pattern"))
        .when(yes(index_zone), got("index_block", 0.8, "possible_index_zone_metadata"))
        .when(t.rlike(r"(?iU)^\s*TRANSITORIOS?\s*$"), got("transitory_heading", 0.95, "transitory_heading_pattern"))
        .when(t.rlike(BLOCK_ORDINAL), got("transitory_item", 0.95, "transitory_ordinal_pattern"))
        .when(date_heading(t), got("article_body", 0.8, "date_not_heading"))
        .when(document_title(t), got("document_title", 0.8, "document_title_keywords_caps"))
        .when(opens_article(line), got("article_heading", 0.95, "article_heading_pattern"))
        .when(heading("Libro"), got("book_heading", 0.95, "book_heading_pattern"))
        .when(heading("T[ií]tulo"), got("title_heading", 0.95, "title_heading_pattern"))
        .when(heading("Cap[ií]tulo"), got("chapter_heading", 0.95, "chapter_heading_pattern"))
        .when(heading("Secci[oó]n"), got("section_heading", 0.95, "section_heading_pattern"))
        .when(heading("Anexo"), got("annex_heading", 0.95, "annex_heading_pattern"))
        .when(t.rlike(OPENS_FRACTION), got("fraction", 0.95, "fraction_roman_pattern"))
        .when(t.rlike(OPENS_ITEM), got("inciso", 0.95, "inciso_letter_pattern"))
        .when(F.length(t) > 30, got("article_body", 0.6, "default_prose_body"))
        .otherwise(got("unknown", 0.6, None))
    )


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Part of box a covered by box b; 0 for a box without area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))
