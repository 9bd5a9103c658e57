"""Scalar rules as columns: names and types of files, identifiers, headings, classes of documents, hashes."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIME = r"^[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*$"
SHA256 = r"^[0-9a-f]{64}$"
AGENT_KEY = r"^[a-z0-9][a-z0-9_-]*$"
MOST_NAME, MOST_AGENT_KEY = 255, 64
TRANSIT_VERSION = r"^vault:v(\d+):"
STRUCTURED, SEMI_STRUCTURED = 0.6, 0.2
PARTIAL_MATCH = 0.7
SNIPPET_LEAST, SNIPPET_MOST, SNIPPET_TEXT, HIGHLIGHTS, HIGHLIGHT_JOIN = 30, 500, 350, 2, " … "
HEADING_KEYWORDS = (
    "purpose", "scope", "objective", "objectives", "responsibilities", "responsibility", "introduction", "definitions", "definition",
    "procedure", "procedures", "claim procedure", "policy", "process", "overview", "references", "guidelines", "general", "eligibility",
    "roles and responsibilities", "annex", "appendix", "notes",
)
TITLE_STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "for", "to", "in", "on", "at", "by", "with", "from", "as", "but", "nor", "per", "via", "vs", "&",
)
SENTENCE_ENDINGS = ".!?،؛"
BULLETS = ("-", "•", "*", "▪", "–", "—")
NUMBERED = r"^\d+(\.\d+)+([.\):])?\s+\S"
SECTIONED = r"(?i)^(section|article|chapter|annex|appendix|part)\s+[\divxlc]+\b"
LEADING_NUMBER = r"^\d+([.\)]|\.\d+)*\s*"
LABEL_CHARS, SHORT_HEADING_WORDS, TITLE_WORDS = 120, 4, (2, 9)


# ---------------------------------------------------------------- files and identifiers


def file_name(path: Column) -> Column:
    """The last component, trimmed; null if it is empty, longer than 255 or holds a control character."""
    name = F.regexp_replace(F.regexp_extract(path, r"(?s)([^/\\]*)$", 1), r"^\s+|\s+$", "")
    return F.when((F.length(name).between(1, MOST_NAME)) & ~name.rlike(r"[\x00-\x1f\x7f]"), name)


def extension(name: Column) -> Column:
    """With its dot; empty for a name that has none, begins with its only one or ends in one."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")


def content_type(mime: Column) -> Column:
    """In lower case; null if it is no type/subtype."""
    kind = F.lower(F.trim(mime))
    return F.when(kind.rlike(MIME), kind)


def is_sha256(digest: Column) -> Column:
    return F.coalesce(F.lower(F.trim(digest)).rlike(SHA256), F.lit(False))


def is_agent_key(key: Column) -> Column:
    return F.coalesce(key.rlike(AGENT_KEY) & (F.length(key) <= MOST_AGENT_KEY), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (SHA-1) of RFC 4122."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def term_id(term: Column) -> Column:
    """A term's 32-bit number: BLAKE2b of four bytes, big-endian."""

    @F.pandas_udf("long")
    def number(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big"))

    return number(term)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the fields in the order of their names, without blanks; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])), 256)


def transit_version(ciphertext: Column) -> Column:
    """The key version that a ciphertext names; null if it names none."""
    found = F.regexp_extract(ciphertext, TRANSIT_VERSION, 1)
    return F.when(found != "", found.cast("int"))


def entry_age(entry_id: Column, as_of: Column) -> Column:
    """Seconds since a stream entry's own time, the milliseconds before the dash; never negative."""
    made = F.split_part(entry_id, F.lit("-"), F.lit(1)).cast("long") / 1000
    return F.greatest(F.lit(0.0), F.unix_millis(as_of) / 1000 - made)


def seconds_until(at: Column, now: Column) -> Column:
    """Whole seconds, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil((F.unix_micros(at) - F.unix_micros(now)) / 1e6)).cast("long")


def unchanged(stored_hash: Column, stored_version: Column, current_hash: Column, current_version: Column) -> Column:
    """Whether neither the content nor the pipeline that indexed it has changed; something never indexed has."""
    same = (stored_hash == current_hash) & (stored_version == current_version)
    return F.coalesce(same, F.lit(False))


# ---------------------------------------------------------------- texts


def json_sentences(text: Column) -> Column:
    """Sentences, or the lines that aren't blank of a text of one sentence."""
    parts = F.split(text, r"(?<=[.!?؟])\s+")
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    return F.when(F.size(parts) > 1, parts).otherwise(lines)


def clean_ocr_text(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r"[_\-]{5,}", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def section_key(path: Column, depth: int = 2) -> Column:
    """The first components of a JSON path."""
    inner = F.regexp_replace(path, r"^\$+\.?", "")
    return F.when(inner == "", "$").otherwise(F.concat(F.lit("$."), F.substring_index(inner, ".", depth)))


def snippet(text: Column, highlights: Column) -> Column:
    """The first highlights, or the text's beginning where they are thin; null if that is too."""
    start = F.substring(text, 1, SNIPPET_TEXT)
    first = F.when(F.size(highlights) > 0, F.array_join(F.slice(highlights, 1, HIGHLIGHTS), HIGHLIGHT_JOIN)).otherwise(start)
    chosen = F.when(F.length(first) >= SNIPPET_LEAST, first).when(F.length(start) >= SNIPPET_LEAST, start)
    return F.substring(chosen, 1, SNIPPET_MOST)


def turn_content(text: Column, attachments: Column, payload: Column) -> Column:
    """What a message says: its text, nothing beside attachments, else the payload itself."""
    said = F.when(F.trim(text) != "", text)
    return F.coalesce(said, F.when(F.size(F.coalesce(attachments, F.array().cast("array<string>"))) > 0, F.lit("")), payload)


# ---------------------------------------------------------------- structure


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_weak_heading(text: Column) -> Column:
    return F.endswith(_folded(text), F.lit(":"))


def is_heading(text: Column) -> Column:
    """A label, a numbered line, a known word, a short capitalised line, one of capitals or one in title case."""
    line = _folded(text)
    label = F.endswith(line, F.lit(":")) & (F.length(line) <= LABEL_CHARS) & ~line.rlike(r":\s+\S")
    numbered = line.rlike(NUMBERED) | line.rlike(SECTIONED)
    core = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, LEADING_NUMBER, ""), ":+$", "")))
    words = F.split(line, " ")
    capital = line.rlike(r"^\p{Lu}")
    short = (F.size(words) <= SHORT_HEADING_WORDS) & capital
    capitals = line.rlike(r"\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")
    significant = F.filter(words, lambda w: w.rlike(r"\p{L}") & ~F.lower(w).isin(*TITLE_STOP_WORDS))
    titled = (F.size(significant) > 0) & capital & F.forall(significant, lambda w: w.rlike(r"^\p{Lu}"))
    long = F.size(words).between(*TITLE_WORDS) & (capitals | titled)
    plain = (line != "") & ~line.rlike(f"[{SENTENCE_ENDINGS}]$") & ~line.contains("|")
    return plain & (label | numbered | core.isin(*HEADING_KEYWORDS) | short | long)


def is_bullet(text: Column) -> Column:
    line = F.regexp_replace(text, r"^\s+", "")
    marks = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(m)) for m in BULLETS])
    return marks | line.rlike(r"^\d+[.\)]")


def looks_tabular(text: Column) -> Column:
    """A row of two or more cells between bars."""
    return text.contains("|") & (F.size(F.filter(F.split(text, r"\|"), lambda c: F.trim(c) != "")) >= 2)


def class_by_ratio(tables: Column, texts: Column, names: dict[str, str]) -> Column:
    """The name of a document's class by the share of its tables; ``names`` for empty, structured, semi and unstructured."""
    ratio = tables / F.greatest(tables + texts, F.lit(1))
    return (
        F.when((tables == 0) & (texts == 0), names["empty"])
        .when((texts == 0) | (ratio > STRUCTURED), names["structured"])
        .when((tables > 0) & (ratio > SEMI_STRUCTURED), names["semi"])
        .otherwise(names["unstructured"])
    )


def json_class(tables: Column, texts: Column) -> Column:
    return class_by_ratio(tables, texts, {"empty": "empty_json", "structured": "structured_json", "semi": "semi_structured_json", "unstructured": "unstructured_json"})


def docx_class(tables: Column, texts: Column, images: Column) -> Column:
    names = {"empty": "docx_empty", "structured": "docx_structured_text", "semi": "docx_semi_structured_text", "unstructured": "docx_unstructured_text"}
    return F.when((tables == 0) & (texts == 0) & (images > 0), "docx_images").otherwise(class_by_ratio(tables, texts, names))


def pdf_class(tables: Column, blocks: Column, images: Column) -> Column:
    return (
        F.when((tables > 0) & (blocks > 0), "pdf_mixed").when(tables > 0, "pdf_tables").when(blocks > 0, "pdf_text").when(images > 0, "pdf_images").otherwise("pdf_empty")
    )


def numeric_ratio(values: Column) -> Column:
    """The share of values that hold a digit; 1 without values."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda v: v.rlike(r"(?U)\d"))) / n).otherwise(F.lit(1.0))


def column_similarity(a: Column, b: Column) -> Column:
    """The mean likeness of two header rows: 1 for equal names, 0.7 for one in the other; 0 for rows of other lengths."""

    def like(x: Column, y: Column) -> Column:
        x, y = F.lower(F.trim(x)), F.lower(F.trim(y))
        part = (x != "") & (y != "") & (x.contains(y) | y.contains(x))
        return F.when(x == y, 1.0).when(part, PARTIAL_MATCH).otherwise(0.0)

    total = F.aggregate(F.zip_with(a, b, like), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a)).otherwise(0.0)
