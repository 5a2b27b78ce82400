"""Scalar functions over texts, JSON answers and identifiers, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of source-file names and of leaked keys.
CHAPTER = r"第\s*0*(\d+)章"
EXERCISE = r"(?i)ch\s*0*(\d+)[_-]*\s*習題解答(?:\.pdf)?$"
MODULE = r"模組\s*0*(\d+)"
EXAM = r"(?i)初級|資訊安全工程師|混合|題庫|exam|practice|test|question"
KEY_FORMS = {
    "NVIDIA_API_KEY": r"nvapi-[A-Za-z0-9_-]{20,}",
    "GROQ_API_KEY": r"gsk_[A-Za-z0-9_-]{20,}",
    "GOOGLE_API_KEY": r"AIza[A-Za-z0-9_-]{20,}",
    "OPENAI_API_KEY": r"sk-(?:proj-|live-)?[A-Za-z0-9_-]{20,}",
}
WINDOWS_PATH = r"\b[A-Za-z]:[\\/]"
ENV_ASSIGNMENT = r"(?Us)\b(OPENAI_API_KEY|GOOGLE_API_KEY|GEMINI_API_KEY|GROQ_API_KEY(?:_[0-9])?|NVIDIA_API_KEY_[0-9]|NEO4J_PASSWORD)\s*=\s*(.+)"
PLACEHOLDERS = ["", "your_api_key_here", "your-key-here", "replace_me", "changeme", "placeholder", "example", "none", "null"]


def strip(c: Column) -> Column:
    """Without white space at both ends, all that Unicode has."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def name_key(c: Column) -> Column:
    """How entity names are compared."""
    return F.lower(strip(c))


def loose_key(c: Column) -> Column:
    """Lower case, without parentheses and what they hold, separators and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)|（[^）]*）", ""), r"[\s_\-/.,:;·、，。]+", "")


def identifier(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def unit_key(c: Column) -> Column:
    """CHnn of a chapter or its exercises, MODnn of a module, else null; numbers start at 1."""

    def number(pattern: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast("int")

    def key(prefix: str, n: Column) -> Column:
        return F.when(n >= 1, F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0")))

    chapter, exercise, module = number(CHAPTER), number(EXERCISE), number(MODULE)
    return F.when(chapter.isNotNull(), key("CH", chapter)).when(exercise.isNotNull(), key("CH", exercise)).when(module.isNotNull(), key("MOD", module))


# What a source file's name can be, in the order in which the forms are tried. Named parts of a pattern: no, the chapter's number; title.
UNIT_FORMS = [
    ("章節", r"第\s*(?<no>\d{1,2})\s*章[\s_-]*(?<title>.+)$"),
    ("章節", r"(?i)^ch(?<no>\d{1,2})[\s_-]*(?<title>習題解答)"),
    ("模組", r"模組\s*\d+[\s_-]*[-_－:：]?\s*(?<title>.+)$"),
    ("模組", r"(?i)^(?:ipas[\s_-]*)?(?<title>.*網路安全簡介.*)$"),
    ("題庫", EXAM),
]
UNTITLED, SKIPPED, UNKNOWN = "未命名", "SKIP", "UNMATCHED"


def unit_struct(file: Column) -> Column:
    """unit, category, chapter_no and is_exercise of a source file's name, as a struct: the first of UNIT_FORMS that fits."""
    stem = F.translate(F.regexp_replace(file, r"^.*[/\\\\]|\.(?i:pdf|json)$", ""), "０１２３４５６７８９", "0123456789")

    def part(pattern: str, name: str) -> Column:
        groups = re.findall(r"\((?!\?)|\(\?<([a-z]+)>", pattern)
        return F.regexp_extract(stem, pattern, groups.index(name) + 1) if name in groups else F.lit("")

    def named(pattern: str) -> Column:
        """The title without a suffix, marks at its ends and white space."""
        bare = F.regexp_replace(part(pattern, "title"), r"(?i)^[\s_-]+|[\s_-]*(?:e\d+)?(?:\.(?:pdf|json))?[\s_-]*$|\s+", "")
        return F.coalesce(F.nullif(bare, F.lit("")), F.lit(UNTITLED))

    found = []
    for category, pattern in UNIT_FORMS:
        no = part(pattern, "no").try_cast("int")
        prefix = F.coalesce(F.lpad(no.cast("string"), 2, "0"), F.lit("M"))
        unit = F.lit(SKIPPED) if category == "題庫" else F.concat_ws("_", prefix, named(pattern))
        exercise = F.lit("習題解答" in pattern)
        found.append(F.when(F.rlike(stem, F.lit(pattern)), F.struct(unit.alias("unit"), F.lit(category).alias("category"), no.alias("chapter_no"), exercise.alias("is_exercise"))))
    other = F.struct(F.lit(UNKNOWN).alias("unit"), F.lit(UNKNOWN).alias("category"), F.lit(None).cast("int").alias("chapter_no"), F.lit(False).alias("is_exercise"))
    return F.coalesce(*found, F.when(file.isNotNull(), other))


def unit_of(file: Column) -> dict[str, Column]:
    """The fields of unit_struct(); take them of a column that holds it where several are needed."""
    first = unit_struct(file)
    return {name: first[name] for name in ("unit", "category", "chapter_no", "is_exercise")}


def answer_letters(c: Column) -> Column:
    """The distinct letters A to D of an answer, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("[ABCD]"), F.lit(0)))), "")


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two texts as sets of characters: 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(F.filter(F.split(a, ""), lambda v: v != "")), F.array_distinct(F.filter(F.split(b, ""), lambda v: v != ""))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def lenient_json(c: Column, array_first: bool = True) -> Column:
    """The JSON text in an answer with words around it: the longest [...] or {...}, or the whole; null if none parses."""
    array, thing = F.regexp_extract(c, r"(?s)\[.*\]", 0), F.regexp_extract(c, r"(?s)\{.*\}", 0)
    order = [array, thing, c] if array_first else [c, F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), thing]
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in order))


# The form of an answer where there is no JSON, and how much of a text is kept.
ANSWER_FORM = r"\"?answer\"?\s*[:：]\s*\"([A-Da-d ,，、]+)\"?"
KEPT_RAW, KEPT_REASONING = 300, 500


def answer_of(raw: Column) -> Column:
    """answer, reasoning and parse_error of a model's answer: from JSON, where error is null; else by ANSWER_FORM (regex_fallback); else empty (no_match, or empty for an empty text)."""
    found = lenient_json(raw, array_first=False)
    thing = F.startswith(F.schema_of_variant(F.try_parse_json(found)), F.lit("OBJECT"))
    field = lambda n: F.coalesce(F.get_json_object(found, f"$.{n}"), F.lit(""))
    part = lambda a, r, e: F.struct(a.alias("answer"), r.alias("reasoning"), e.alias("parse_error"))
    start = F.left(raw, F.lit(KEPT_RAW))
    stated = part(F.trim(field("answer")), F.left(field("reasoning"), F.lit(KEPT_REASONING)), F.lit(None).cast("string"))
    formed = part(F.regexp_extract(raw, ANSWER_FORM, 1), start, F.lit("regex_fallback"))
    blank = part(F.lit(""), F.lit(""), F.lit("empty"))
    return F.when(raw.isNull() | (raw == ""), blank).when(thing, stated).when(F.rlike(raw, F.lit(ANSWER_FORM)), formed).otherwise(part(F.lit(""), start, F.lit("no_match")))


def whole_number(c: Column) -> Column:
    """A text as a whole number, what is behind the point dropped; null if it is none."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2.0**63), number.cast("long"))


def env_secret(line: Column) -> Column:
    """The variable that a line's first assignment gives a secret; null without one, or if the value is a placeholder or read from the environment."""
    value = F.regexp_extract(line, ENV_ASSIGNMENT, 2)
    bare = F.btrim(strip(value), F.lit("\"'"))
    placeholder = F.lower(bare).isin(*PLACEHOLDERS) | (F.startswith(bare, F.lit("<")) & F.endswith(bare, F.lit(">")))
    return F.when(F.rlike(line, F.lit(ENV_ASSIGNMENT)) & ~F.contains(value, F.lit("getenv(")) & ~placeholder, F.regexp_extract(line, ENV_ASSIGNMENT, 1))


def secret_kinds(line: Column) -> Column:
    """All kinds of secret in a line, as an array: keys by their form, ENV and the variable of an assignment, TOKEN and PATH."""
    forms = KEY_FORMS | {"TOKEN": 'token = "[0-9a-f]{40}"', "PATH": WINDOWS_PATH}
    return F.array_compact(F.array(*(F.when(F.rlike(line, F.lit(p)), F.lit(k)) for k, p in forms.items()), F.concat(F.lit("ENV "), env_secret(line))))


def canonical_id(c: Column) -> Column:
    """Community ids as text: '7.0' is '7', a missing one UNKNOWN."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("UNKNOWN"))


def size_bucket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 9, "3-9").when(n <= 49, "10-49").when(n <= 99, "50-99").otherwise(">=100")


def bucket_middle(c: Column) -> Column:
    """The middle of '3-9', the number of '12+'; '>=100' has none."""
    low, high = F.regexp_extract(c, r"^(\d+)-(\d+)$", 1).try_cast("double"), F.regexp_extract(c, r"^(\d+)-(\d+)$", 2).try_cast("double")
    return F.coalesce((low + high) / 2, F.regexp_extract(c, r"^(\d+)\+?$", 1).try_cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double; 0 if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
