"""Line-first quality rules.

Every line is judged on its own before its document is: punctuation rules
(symbol-ridden lines, shouting, short lines without a closing mark), a
navigation rule (menus of ``|`` or ``>`` separated entries) and a boilerplate
rule (short lines with a stock phrase).  Failing lines are removed, and a
document that loses more than half of the characters of its words is rejected,
as is one that fails the base rules (too few words, too much repetition).

Defined results: a null text is an empty one (no words, rejected).  Rows repeat
in the output as they do in the input, extra columns are ignored, an empty
table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.llm.common import append_columns, documents
from sparkloom.llm.textops import LOWER_ASCII, SEPARATOR, PrefixHash, Slice, mix

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
#: A line fails if more than this share of its non-blank bytes are symbols.
SYMBOL_PERCENT = 5
#: A line without a closing mark fails only if it is shorter than this.
SHORT_LINE_WORDS = 4
BOILERPLATE_WORDS = 30

SYMBOLS = b"#*$%&|<>"
NAVIGATION = b"|>"
SHOUTS = b"!?"
CLOSERS = b".!?\"'):;"
CLOSERS_WIDE = ("…", "”", "’", "»")
#: Stock phrases in small letters (English, French, German, Spanish); A-Z is lower-cased before they are looked for.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign in to",
    "subscribe to our", "terms of service", "terms of use",
    "abonnez-vous", "cliquez ici", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookie-richtlinie", "datenschutzerklärung", "hier klicken", "newsletter abonnieren",
    "aviso legal", "condiciones de uso", "haga clic aquí", "política de privacidad", "suscríbete a", "todos los derechos reservados",
)


def _member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_NAVIGATION, _IS_SHOUT, _IS_CLOSER = map(_member, (SYMBOLS, NAVIGATION, SHOUTS, CLOSERS))
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_WIDE = re.compile("|".join(CLOSERS_WIDE).encode())


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def judge(part: Slice, keep_text: bool = False) -> list:
    """Counts and verdicts of the documents of a slice, and the cleaned texts if asked for."""
    data, offsets, n = part.data, part.offsets, len(part)
    starts, ends, first = part.words()
    n_words = np.diff(first)
    in_word = ~SEPARATOR[data]
    points = _running(in_word & ((data & 0xC0) != 0x80))
    symbols = _running(_IS_SYMBOL[data])
    word_chars, n_symbols = np.diff(points[offsets]), np.diff(symbols[offsets])

    # lines: they end at \n or at the end of their document
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([breaks + 1, offsets[:-1][np.diff(offsets) > 0]]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end[:0]
    word_at = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    words = word_at[1] - word_at[0]
    solid = words > 0
    line_start, line_end, words, word_lo, word_hi = (x[solid] for x in (line_start, line_end, words, *word_at))
    line_doc = np.searchsorted(offsets, line_start, "right") - 1

    line_points = points[line_end] - points[line_start]
    solid_bytes = _running(in_word)
    line_symbols = symbols[line_end] - symbols[line_start]
    shouts = _running(_IS_SHOUT[data])
    bars = _running(_IS_NAVIGATION[data])
    last = ends[word_hi - 1] - 1 if len(word_hi) else np.empty(0, np.int64)
    closed = _IS_CLOSER[data[last]]
    raw = data.tobytes()
    wide_last = np.array([m.end() - 1 for m in _WIDE.finditer(raw)], np.int64)
    closed |= np.isin(last, wide_last)
    fails = 100 * line_symbols > SYMBOL_PERCENT * (solid_bytes[line_end] - solid_bytes[line_start])
    fails |= 3 * (shouts[line_end] - shouts[line_start]) > 2 * words
    fails |= ~closed & (words < SHORT_LINE_WORDS)
    n_bars = bars[line_end] - bars[line_start]
    fails |= (n_bars >= 2) & (3 * n_bars >= words)
    hits = np.array([m.start() for m in _PHRASES.finditer(LOWER_ASCII[data].tobytes())], np.int64)
    if len(hits) and len(line_start):
        at = np.searchsorted(line_start, hits, "right") - 1
        at = at[at >= 0]
        stock = np.zeros(len(line_start), bool)
        stock[at] = True
        fails |= stock & (words <= BOILERPLATE_WORDS)
    kept_chars = np.bincount(line_doc[~fails], line_points[~fails], n).astype(np.int64) if len(line_doc) else np.zeros(n, np.int64)

    # lines equal to an earlier one of their document
    n_dup_lines = np.zeros(n, np.int64)
    n_repeat = np.zeros(n, np.int64)
    if len(line_start):
        hashed = PrefixHash(data)
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x51ED270B))
        key = mix(hashed.of(line_start, line_end) + salt[line_doc])
        order = np.argsort(key, kind="stable")
        again = order[1:][key[order][1:] == key[order][:-1]]
        n_dup_lines = np.bincount(line_doc[again], minlength=n)

        word_doc = np.repeat(np.arange(n), n_words)
        w = hashed.of(starts, ends)
        if len(w) >= 3:
            key = mix(w[:-2] + np.uint64(3) * w[1:-1] + np.uint64(0x9E3779B97F4A7C15) * w[2:] + salt[word_doc[:-2]])
            inside = np.flatnonzero(word_doc[:-2] == word_doc[2:])
            order = inside[np.argsort(key[inside])]
            same = key[order][1:] == key[order][:-1]
            repeated = np.concatenate([order[1:][same], order[:-1][same]])
            covered = np.zeros(len(w), bool)
            for k in range(3):
                covered[repeated + k] = True
            n_repeat = np.bincount(word_doc[covered], minlength=n)

    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~base_failed & (100 * kept_chars >= MIN_KEPT_PERCENT * word_chars)
    out = [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept]
    if keep_text:
        lines: list[list[bytes]] = [[] for _ in range(n)]
        for d, lo, hi in zip(line_doc[~fails], line_start[~fails], line_end[~fails], strict=True):
            lines[d].append(raw[lo:hi])
        out.append([b"\n".join(x).decode() for x in lines])
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """Append counts, ``base_failed`` and ``kept``; with ``clean_col`` also the text without its failing lines."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    if clean_col:
        fields.append(T.StructField(clean_col, T.StringType()))
    keep_text = bool(clean_col)
    return append_columns(docs, text_col, fields, lambda: lambda part: judge(part, keep_text))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules(docs).drop("text")


_PHRASES_SQL = "|".join(BOILERPLATE).replace("'", "''")
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
solid AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM lines
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT rid, line, len(array_to_string(lw, '')) AS chars,
        (100 * len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {SYMBOL_PERCENT} * strlen(array_to_string(lw, ''))
         OR 3 * len(regexp_replace(line, '[^!?]', '', 'g')) > 2 * len(lw)
         OR (NOT regexp_matches(lw[len(lw)], '[.!?"''):;…”’»]$') AND len(lw) < {SHORT_LINE_WORDS})
         OR (len(regexp_replace(line, '[^|>]', '', 'g')) >= 2
             AND 3 * len(regexp_replace(line, '[^|>]', '', 'g')) >= len(lw))
         OR (regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES_SQL}')
             AND len(lw) <= {BOILERPLATE_WORDS})) AS fails
        FROM solid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
        coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS kept_chars FROM judged GROUP BY rid),
p AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM p) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
base AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        coalesce(kept_chars, 0) AS kept_chars
        FROM w LEFT JOIN l USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
      AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM base
"""
