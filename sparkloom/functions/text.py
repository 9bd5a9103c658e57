"""Text functions; every one is an expression of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENGLISH_STOP_WORDS = [
    "a", "all", "an", "and", "are", "as", "at", "be", "both", "but", "by", "can", "each", "every", "few", "for", "from", "had",
    "has", "have", "he", "how", "in", "is", "it", "its", "just", "more", "most", "no", "nor", "not", "now", "of", "on", "only",
    "other", "own", "same", "should", "so", "some", "such", "than", "that", "the", "they", "this", "to", "too", "very", "was",
    "what", "when", "where", "which", "who", "why", "will", "with",
]
ARABIC_STOP_WORDS = [
    "أقل", "أكثر", "أم", "أن", "أنا", "أنت", "أنتم", "أنتن", "أو", "أي", "أيضا", "أين", "إلا", "إلى", "إليه", "إليها", "إليهم",
    "إن", "التي", "الذي", "الذين", "اللاتي", "اللتان", "اللذان", "اللواتي", "ب", "بدون", "بعد", "بعض", "به", "بها", "بهم", "بين",
    "تحت", "ثم", "جدا", "حول", "حيث", "خلال", "ذات", "ذلك", "سوى", "ضد", "ضمن", "عبر", "على", "عليه", "عليها", "عن", "عند", "غير",
    "ف", "فوق", "في", "فيه", "فيها", "فيهم", "قبل", "قد", "قليل", "ك", "كان", "كثير", "كذلك", "كل", "كيف", "ل", "لا", "لدى",
    "لكن", "لماذا", "له", "لها", "لهم", "لهن", "ليس", "ما", "متى", "مثل", "مع", "من", "منه", "منها", "منهم", "نحن", "نحو", "نعم",
    "نفس", "هذا", "هذه", "هم", "هن", "هنا", "هناك", "هو", "هي", "و", "ولكن",
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARABIC = "؀-ۿ"
NOISE_HEADERS = ("no.", "no", "row", "#", "index", "id")
ARABIC_HIGH, ARABIC_LOW = 0.6, 0.3
MIN_TOKEN = 2
METADATA_PATTERNS = (
    r"كم\s+عدد", r"كم\s+ملف", r"عدد\s+الملفات", r"اعرض\s+الملفات",
    r"how\s+many\s+(?:files|documents|docs)", r"list\s+(?:the\s+)?(?:files|documents|docs)",
)
TOPICAL_PATTERNS = (r"عن\b", r"حول\b", r"يتحدث", r"about\b", r"regarding\b", r"mentions?\b")
SUMMARIZE_PATTERNS = (
    r"لخص", r"تلخيص", r"ملخص", r"summari[sz]e", r"summary", r"ما\s+(?:هو|هي)\s+ملف", r"what\s+is\s+(?:the\s+)?file",
)
#: Patterns and what takes their place, in this order.
CLEANING = (
    (r"(?iU)\bPage\s*\d+\b", " "),
    (r"[~_*={}\[\]\-]{3,}", " "),
    (f"[^\\x09\\x0A\\x0D\\x20-\\x7E{ARABIC}]", " "),
    (r"\s{3,}", " "),
    (r"\n{2,}", "\n"),
    (r"^\s+|\s+$", ""),
)
SENTENCE_SPLIT = r"[.؟!؛۔]+|\n{2,}"
MEANINGFUL_RATIO, MEANINGFUL_LENGTH = 0.3, 10


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize_arabic(text: Column) -> Column:
    """Alef, hamza, teh marbuta and alef maksura forms unified, tashkeel dropped."""
    return F.regexp_replace(F.translate(text, "إأآؤئةى", "اااءءهي"), r"[ً-ٰٟ]", "")


def _share(text: Column) -> tuple[Column, Column]:
    arabic, english = (F.length(F.regexp_replace(text, f"[^{letters}]+", "")) for letters in (ARABIC, "a-zA-Z"))
    return arabic, english


def detect_language(text: Column) -> Column:
    """arabic, english, mixed or unknown, by the share of Arabic among Arabic and ASCII letters."""
    arabic, english = _share(text)
    ratio = arabic / (arabic + english)
    return (
        F.when(F.coalesce(arabic + english, F.lit(0)) == 0, "unknown")
        .when(ratio > ARABIC_HIGH, "arabic")
        .when(ratio < ARABIC_LOW, "english")
        .otherwise("mixed")
    )


def _useful(tokens: Column, stop: list[str], drop_stop: bool) -> Column:
    tokens = F.filter(tokens, lambda w: F.length(w) >= MIN_TOKEN)
    return F.filter(tokens, lambda w: ~w.isin(*stop)) if drop_stop else tokens


def english_tokens(text: Column, drop_stop: bool = True) -> Column:
    return _useful(words(F.translate(F.lower(text), PUNCTUATION, "")), ENGLISH_STOP_WORDS, drop_stop)


def english_words(text: Column) -> Column:
    """What ``english_tokens`` makes tokens of, stop words and single letters included: enough where only given tokens are looked for."""
    return F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"(?U)\s+")


def arabic_tokens(text: Column, drop_stop: bool = True, normalize: bool = True) -> Column:
    lowered = F.lower(normalize_arabic(text) if normalize else text)
    return _useful(F.regexp_extract_all(lowered, F.lit(f"(?U)[{ARABIC}\\w]+"), 0), ARABIC_STOP_WORDS, drop_stop)


def tokenize(text: Column, drop_stop: bool = True, normalize: bool = True, kind: Column | None = None) -> Column:
    """Tokens by language: a bag for one language, a set in order of first use for mixed and unknown texts; ``kind`` is the language where it is a column already."""
    kind = detect_language(text) if kind is None else kind
    english, arabic = english_tokens(text, drop_stop), arabic_tokens(text, drop_stop, normalize)
    both = F.array_distinct(F.concat(arabic, english))
    empty = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", empty)
        .when(kind == "arabic", arabic).when(kind == "english", english).otherwise(both)
    )


def sentences(text: Column) -> Column:
    """Parts between sentence marks or blank lines."""
    parts = F.transform(F.split(text, SENTENCE_SPLIT), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def clean_text(text: Column) -> Column:
    """Page numbers, runs of rules and letters outside ASCII and Arabic become blanks; blank runs are squeezed."""
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    return text


def classify_intent(query: Column) -> Column:
    """metadata, summarize_doc or content; a topical connector turns a metadata question into a content one."""

    def any_of(patterns: tuple[str, ...]) -> Column:
        return query.rlike("(?iU)" + "|".join(patterns))

    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "content")
        .when(any_of(METADATA_PATTERNS), F.when(any_of(TOPICAL_PATTERNS), "content").otherwise("metadata"))
        .when(any_of(SUMMARIZE_PATTERNS), "summarize_doc")
        .otherwise("content")
    )


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def words_of_limit(token_limit: Column) -> Column:
    """``max_words`` of a column."""
    return F.greatest(F.floor(token_limit / 1.3 * 0.9), F.lit(32)).cast("int")


def max_words(token_limit: int) -> int:
    """Words that surely fit a token limit: 1.3 tokens a word and a tenth in reserve."""
    return max(int(token_limit / 1.3 * 0.9), 32)


def is_rtl(text: Column, lang: Column | None = None) -> Column:
    """Right to left for ``ar``, not for ``en``; for any other language if more than half of the letters are Arabic."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    most = 2 * F.length(F.regexp_replace(letters, f"[^{ARABIC}]+", "")) > F.length(letters)
    return most if lang is None else F.when(lang == "ar", True).when(lang == "en", False).otherwise(most)


def is_meaningful(text: Column, least: float = MEANINGFUL_RATIO) -> Column:
    """At least 10 characters, and of those that are no blank three tenths letters, digits or Arabic signs."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    solid = F.length(F.translate(clean, " \n", ""))
    good = F.length(F.regexp_replace(clean, f"[^\\p{{L}}\\p{{N}}{ARABIC}]+", ""))
    return (F.length(clean) >= MEANINGFUL_LENGTH) & (solid > 0) & (good / solid >= least)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def row_sentence(cells: Column) -> Column:
    """``header: value; ...`` of an array of (k, v), without noise headers and empty values."""
    solid = F.filter(
        cells, lambda c: ~F.lower(F.trim(c["k"])).isin(*NOISE_HEADERS) & (F.coalesce(F.trim(c["v"]), F.lit("")) != "")
    )
    return F.array_join(F.transform(solid, lambda c: F.concat(F.trim(c["k"]), F.lit(": "), F.trim(c["v"]))), "; ")


def header_line(headers: Column) -> Column:
    kept = F.filter(F.transform(headers, lambda h: F.trim(h)), lambda h: (h != "") & ~F.lower(h).isin(*NOISE_HEADERS))
    return F.array_join(kept, "; ")


def breadcrumb(parts: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != "")), " — ")
