"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atril import settings as S
from atril.functions.unicode import fold, let, nfkc

# --- fixed values: word lists, tables and patterns that results depend on -------------------

ENTITY_STOP_WORDS = [
    "para", "cual", "cuales", "como", "donde", "cuando", "porque", "sobre",
    "entre", "desde", "hasta", "este", "esta", "estos", "estas", "esos",
    "esas", "otro", "otra", "otros", "otras", "todo", "toda", "todos",
    "todas", "sera", "seran", "hacer",
]
FACTUAL = (
    "materias?|asignaturas?|semestres?|pensum|plan(?:es)? de estudios?|créditos?|"
    "c[oó]digos?|requisitos?|prerrequisitos?|duraci[oó]n|cu[aá]ntos?|cu[aá]ntas?|"
    "costos?|precios?|valores?|matr[ií]culas?|inscripci[oó]n(?:es)?|fechas?|plazos?|horarios?|"
    "snies|acreditaci[oó]n|resoluci[oó]n|decretos?|sedes?|facultades?|ubicaci[oó]n|direcci[oó]n|"
    "programas?|admisiones?|puntajes?|promedios?|t[ií]tulos?|grados?|"
    "modalidad(?:es)?|presencial|distancia|virtual|jornadas?|diurna|nocturna"
)
CONVERSATIONAL = "hola|buenas|buenos|saludos|gracias|por favor|interesante|genial"
VARYING = (
    "pensum|plan(?:es)? de estudios?|materias?|asignaturas?|cr[eé]ditos?|"
    "semestres?|duraci[oó]n|perfil (?:profesional|ocupacional|del egresado)|"
    "t[ií]tulos?|titulaci[oó]n|egresados?|snies|misi[oó]n|visi[oó]n"
)
PROCEDURAL = (
    "homologaci[oó]n|homologar|convalidaci[oó]n|convalidar|validar|"
    "perd[ií]|pierdo|perder|reprobar|reprobaci[oó]n|repetir|repetici[oó]n|"
    "aplazamiento|aplazar|cancelaci[oó]n|cancelar|supletorio"
)
ORDINALS = {
    "primer": "1", "primero": "1", "segundo": "2", "tercer": "3", "tercero": "3",
    "cuarto": "4", "quinto": "5", "sexto": "6", "septimo": "7", "octavo": "8",
    "noveno": "9", "decimo": "10", "undecimo": "11", "duodecimo": "12",
    "ultimo": "ULTIMO",
}
CARDINALS = {
    "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "diez": "10",
}
ROMAN = {
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6",
    "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12",
}
ROMAN_ORDINAL = {
    "I": "primer", "II": "segundo", "III": "tercer", "IV": "cuarto",
    "V": "quinto", "VI": "sexto", "VII": "séptimo", "VIII": "octavo",
    "IX": "noveno", "X": "décimo", "XI": "undécimo", "XII": "duodécimo",
}
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "txt", "md": "txt",
    "xlsx": "xlsx", "xls": "xls", "csv": "csv", "pptx": "pptx",
}
DOC_REF_EXTENSIONS = [".pdf", ".xlsx", ".xls", ".docx", ".csv", ".pptx"]
# --------------------------------------------------------------------------------------------


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def truthy(text: Column) -> Column:
    """NULL and the empty string both count as absent."""
    return F.when(text != "", text)


def whole_word(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iuU)\\b({pattern})\\b")


def normalize_for_match(text: Column) -> Column:
    return fold(text, wide=True)


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text, wide=True), F.lit("[a-z0-9]+"), F.lit(0))


def significant_words(text: Column) -> Column:
    spaced = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    stop = F.array(*[F.lit(w) for w in ENTITY_STOP_WORDS])
    return F.array_except(
        F.array_distinct(F.filter(alnum_words(spaced), lambda w: F.length(w) >= 4)), stop
    )


def words_mention(query_words: Column, entity_words: Column, min_overlap: float = S.ENTITY_OVERLAP) -> Column:
    def enough(words: Column) -> Column:
        shared = F.size(F.array_intersect(query_words, words))
        return (F.size(words) > 0) & (shared / F.greatest(F.size(words), F.lit(1)) >= min_overlap)

    return F.coalesce(let(entity_words, enough), F.lit(False))


def mentions_entity(query: Column, entity: Column, min_overlap: float = S.ENTITY_OVERLAP) -> Column:
    return words_mention(significant_words(query), significant_words(entity), min_overlap)


def is_factual(text: Column) -> Column:
    return whole_word(text, FACTUAL)


def is_conversational(text: Column) -> Column:
    return whole_word(text, CONVERSATIONAL)


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def temperature(text: Column, default: float = 0.05) -> Column:
    return (
        F.when(is_factual(text), 0.0).when(is_conversational(text), 0.15).otherwise(F.lit(default))
    )


def is_greeting(text: Column) -> Column:
    return ~is_factual(text) & is_conversational(text) & (F.size(whitespace_words(text)) <= 6)


def varying_topic(text: Column) -> Column:
    return ~whole_word(text, PROCEDURAL) & whole_word(text, VARYING)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def overlap_share(query_words: Column, text_words: Column) -> Column:
    return let(query_words, lambda q: F.when(
        F.size(q) > 0, F.size(F.array_intersect(q, text_words)) / F.size(q)).otherwise(F.lit(0.0)))


def keyword_score(query: Column, text: Column) -> Column:
    return overlap_share(word_set(query), word_set(text))


def semester_reference(text: Column) -> Column:
    values = {**CARDINALS, **ROMAN}

    def find(words: Column) -> Column:
        ordinal = F.filter(
            F.transform(words, lambda w: F.try_element_at(_map(ORDINALS), w)), lambda v: v.isNotNull())

        def number_after(word, i):
            following = F.try_element_at(words, i + 2)
            return F.when(
                word == "semestre",
                F.when(following.rlike("^[0-9]+$"), following).otherwise(F.try_element_at(_map(values), following)))

        numbered = F.filter(F.transform(words, number_after), lambda v: v.isNotNull())
        return F.coalesce(F.try_element_at(ordinal, F.lit(1)), F.try_element_at(numbered, F.lit(1)))

    return let(alnum_words(text), find)


def head_words(text: Column, chars: int = S.NEAR_DUP_HEAD_CHARS) -> Column:
    return F.array_distinct(whitespace_words(F.lower(F.substring(text, 1, chars))))


def jaccard(a: Column, b: Column) -> Column:
    def share(shared: Column) -> Column:
        total = F.size(a) + F.size(b) - shared
        return F.when(total > 0, shared / total).otherwise(F.lit(0.0))

    return let(F.size(F.array_intersect(a, b)), share)


def head_jaccard(a: Column, b: Column) -> Column:
    return jaccard(head_words(a), head_words(b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def clean_text(text: Column) -> Column:
    """F2.  Rare marks are looked for by plain substring search before a regex runs."""
    def where(t: Column, hint: Column, pattern: str, to: str) -> Column:
        return F.when(hint, F.regexp_replace(t, pattern, to)).otherwise(t)

    t = F.regexp_replace(nfkc(text), "\\t[ \\t]*| [ \\t]+", " ")  # single spaces are left alone, not rewritten
    t = let(t, lambda x: where(x, x.contains("\n\n\n"), "\\n{3,}", "\n\n"))
    t = F.regexp_replace(t, "(?U)\\n\\s*\\d+\\s*\\n", "\n")
    t = let(t, lambda x: where(x, F.lower(x).contains("gina"), "(?iuU)Página\\s+\\d+\\s+de\\s+\\d+", ""))
    t = let(t, lambda x: where(x, x.contains("___"), "_{3,}", ""))
    t = let(t, lambda x: where(x, x.contains("---"), "-{3,}", ""))
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_extract(text, "(?sU)\\A\\s*(.*\\S)?\\s*\\z", 1)


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def request_key(**parts: Column) -> Column:
    ordered = [parts[name].alias(name) for name in sorted(parts)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def token_count(text: Column) -> Column:
    return (F.char_length(text) / S.CHARS_PER_TOKEN).cast("int")


def citations(answer: Column, n_sources: Column | None = None) -> Column:
    found = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(answer, F.lit("\\[(\\d{1,2})\\]"), F.lit(1)), lambda d: d.cast("int")
    )))
    if n_sources is None:
        return found
    return F.filter(found, lambda n: (n >= 1) & (n <= n_sources))


def refusal_flag(answer: Column) -> Column:
    return answer.contains(S.REFUSAL_MARKER)


def clarification_flag(answer: Column) -> Column:
    return answer.contains(S.CLARIFICATION_MARKER)


def _verdict_lines(output: Column) -> Column:
    return F.filter(
        F.transform(F.split(output, "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"), strip),
        lambda line: line != "",
    )


def verdict(output: Column) -> Column:
    def read(lines: Column) -> Column:
        last = F.upper(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
        reason = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), " ")
        return F.struct(
            last.startswith("NO").alias("rejected"),
            (last.startswith("SI") | last.startswith("SÍ")).alias("hallucinated"),
            F.nullif(reason, F.lit("")).alias("reason"))

    return F.when(output.isNotNull(), let(_verdict_lines(output), read))


def narrow_context(context: Column, answer: Column, max_chars: int = S.GRADING_CONTEXT_CHARS) -> Column:
    cited = citations(answer)
    kept = F.filter(
        F.split(context, "\\n\\n---\\n\\n"),
        lambda b: F.array_contains(
            cited, F.try_to_number(F.regexp_extract(b, "^\\[(\\d{1,2})\\]", 1), F.lit("99")).cast("int")
        ),
    )
    narrowed = F.when(F.size(kept) > 0, F.array_join(kept, S.BLOCK_SEPARATOR)).otherwise(context)
    return F.substring(narrowed, 1, max_chars)


def strip_reasoning(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?is)<think>.*?</think>", ""))


# The Unicode property Extended_Pictographic as code point ranges (the JVM's
# regular expressions know the property by name only from Java 21 on).
PICTOGRAPHIC = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB "
    "25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F "
    "2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C "
    "26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA "
    "26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 "
    "274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 "
    "3030 303D 3297 3299 1F004 1F02C-1F02F 1F094-1F09F 1F0AF-1F0B0 1F0C0 1F0CF-1F0D0 1F0F6-1F0FF "
    "1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AF-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A "
    "1F23C-1F23F 1F249-1F25F 1F266-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 "
    "1F3F7-1F3FA 1F400-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 "
    "1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 "
    "1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6E5 1F6E9 "
    "1F6EB-1F6F0 1F6F3-1F6FF 1F7DC-1F7F0 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8AF "
    "1F8BC-1F8BF 1F8C2-1F8CF 1F8D9-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA58-1FA5F 1FA6E-1FAFF "
    "1FC00-1FFFD "
).split()
PICTOGRAPHIC_CLASS = "[" + "".join(
    "-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in PICTOGRAPHIC
) + "]"

# Markup rules in the order they apply, as (pattern, replacement).
MARKDOWN_RULES = [
    ("```[\\s\\S]*?```", " "),
    ("`([^`]*)`", "$1"),
    ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    ("(\\*\\*\\*|___)(.*?)\\1", "$2"),
    ("(\\*\\*|__)(.*?)\\1", "$2"),
    ("(?<![\\w*])\\*(?!\\s)(.*?)(?<!\\s)\\*(?!\\w)", "$1"),
    ("~~(.*?)~~", "$1"),
    ("(?m)^#{1,6}\\s+", ""),
    ("(?m)^>\\s?", ""),
    ("(?m)^\\s*([-*_])\\s*(\\1\\s*){2,}$", ""),
    ("(?m)^\\s*[-*+]\\s+", ""),
    ("(?m)^\\s*\\d+[.)]\\s+", ""),
    ("\\|", " "),
    ("[#*_~`]", ""),
    (PICTOGRAPHIC_CLASS, ""),
    ("[\\x{FE0F}\\x{200D}\\x{20E3}]", ""),
    ("[ \\t]+", " "),
    ("\\n{2,}", "\n"),
]


def strip_markdown(text: Column) -> Column:
    for pattern, replacement in MARKDOWN_RULES:
        done = F.regexp_replace(text, pattern, replacement)
        if pattern == PICTOGRAPHIC_CLASS:  # a two-range test spares most rows the long class
            done = F.when(text.rlike("[\\x{A9}\\x{AE}\\x{203C}-\\x{10FFFF}]"), done).otherwise(text)
        text = done
    return strip(text)


def normalize_doc_ref(name: Column) -> Column:
    tail = "".join(f"(?:\\{ext})?" for ext in reversed(DOC_REF_EXTENSIONS))
    return strip(F.regexp_replace(normalize_for_match(strip(name)), tail + "\\z", ""))


def split_doc_refs(cell: Column) -> Column:
    parts = F.transform(F.split(cell, "[;/]"), lambda p: strip(F.regexp_replace(p, "\\([^)]*\\)", "")))
    files = F.filter(
        parts,
        lambda p: (p != "") & ~F.lower(p).contains("sitio web") & ~F.lower(p).contains("verificar"),
    )
    return F.filter(F.transform(files, normalize_doc_ref), lambda r: r != "")


def cell_to_string(text: Column, number: Column, day: Column) -> Column:
    """Typed cell columns (at most one is not NULL) to the text shown for the cell."""
    whole = number == F.floor(number)
    return F.coalesce(
        strip(text),
        F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string")),
        F.date_format(day, "yyyy-MM-dd"),
        F.lit(""),
    )


def roman_ordinal(label: Column) -> Column:
    return F.try_element_at(_map(ROMAN_ORDINAL), label)


def excerpt(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def client_key(forwarded: Column, peer: Column, trusted_hops: int = 1) -> Column:
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(hops)
    return F.coalesce(
        F.when(n > 0, F.try_element_at(hops, (F.greatest(n - trusted_hops, F.lit(0)) + 1).cast("int"))),
        peer,
        F.lit("unknown"),
    )


def file_type(name: Column) -> Column:
    return F.try_element_at(_map(EXTENSIONS), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)))


SOURCES_TYPE = (
    "array<struct<citation_number:int,chunk_id:bigint,document_title:string,content_preview:string,"
    "score:double,program:string,faculty:string>>"
)


def sources_to_json(sources: Column) -> Column:
    return F.to_json(sources)


def sources_from_json(text: Column) -> Column:
    return F.from_json(text, SOURCES_TYPE)


# Abbreviations whose full stop does not end a sentence, and the shortest sentence.
ABBREVIATIONS = [
    "dr", "dra", "sr", "sra", "srta", "ing", "lic", "prof", "profa",
    "núm", "num", "art", "av", "avda", "cra", "cll", "no", "vs", "etc",
    "ej", "p", "pág", "pp", "ud", "uds", "esp", "depto", "aprox",
]
MIN_SENTENCE_CHARS = 12
