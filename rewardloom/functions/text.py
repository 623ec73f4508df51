"""Column functions over prompt, completion and SQL text.

All of these are native Spark expressions (no UDF), so they stay inside
whole-stage code generation. Each stage of a multi-step text rule references
its input once, which keeps the expression tree linear in the number of steps.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
SYSTEM_MESSAGE = "Generate a single SQLite SELECT query. No explanations."
USER_HEADER = "Given the following database schema:\n\n"
QUESTION_HEADER = "\n\nQuestion: "
ASSISTANT_PREFIXES = ("<|im_start|>assistant\n", "assistant\n")
CORRUPTION_MARKERS = ("<|", "<quote", "```", "\n\n", "\nSELECT", "\nWITH")
FORBIDDEN_TOKENS = ("--", "/*", "*/")
FORBIDDEN_KEYWORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "replace",
    "vacuum", "pragma", "attach", "detach", "reindex", "analyze", "explain",
    "begin", "commit", "rollback", "savepoint",
)
REASON_NONE = "SQL is None"
REASON_EMPTY = "Empty SQL"
REASON_TOKEN = "Forbidden token found: "
REASON_PREFIX = "Only SELECT queries are allowed"
REASON_KEYWORD = "Forbidden keyword found: "
REASON_MULTI = "Multiple statements are not allowed"
DIFFICULTIES = ("easy", "medium", "hard", "extra")
# ---------------------------------------------------------------------------

# Python's str.strip() set: every code point for which str.isspace() holds.
WS = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())
# Word characters in the sense of Python's Unicode ``\b``: letters, numbers, "_".
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
_WS_CLASS = "[" + WS + "]"
_NON_WS_RUN = "[^" + WS + "]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _jre(s: str) -> str:
    """Escapes a literal for a Java regex."""
    return "".join(ch if ch.isalnum() or ch in " \n" else "\\" + ch for ch in s)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trims the full Unicode whitespace set, both ends."""
    return F.btrim(_c(c), F.lit(WS))


# --- X1, X2, X3: prompt and completion text -------------------------------

def chatml_prompt(schema, question) -> Column:
    """The chat prompt, ending with the assistant header and a newline."""
    return F.concat(
        F.lit(f"{IM_START}system\n{SYSTEM_MESSAGE}\n{IM_END}\n{IM_START}user\n{USER_HEADER}"),
        _c(schema),
        F.lit(QUESTION_HEADER),
        _c(question),
        F.lit(f"\n{IM_END}\n{IM_START}assistant\n"),
    )


def completion(sql) -> Column:
    """Trimmed SQL followed by the end token."""
    return F.concat(strip_ws(sql), F.lit(IM_END))


def ensure_im_end(sql) -> Column:
    """Idempotent end token; null or blank becomes the bare token."""
    s = strip_ws(F.coalesce(_c(sql), F.lit("")))
    return (
        F.when(s == "", F.lit(IM_END))
        .when(s.endswith(IM_END), s)
        .otherwise(F.concat(s, F.lit(IM_END)))
    )


# --- X4, K4, X5: SQL extraction from generated text ------------------------

def longest_block(blocks) -> Column:
    """K4: the longest string in an array; the first one wins a length tie."""
    return F.aggregate(
        _c(blocks),
        F.lit(""),
        lambda acc, b: F.when(F.length(b) > F.length(acc), b).otherwise(acc),
    )


def strip_code_fences(text) -> Column:
    """Drop fence markers (and the lower-case ``sql`` tag), keep the
    longest non-empty block; text without blocks comes back trimmed."""
    t = strip_ws(text)
    parts = F.split(F.replace(t, F.lit("```sql"), F.lit("```")), "```", -1)
    blocks = F.filter(F.transform(parts, lambda p: strip_ws(p)), lambda b: F.length(b) > 0)
    best = longest_block(blocks)
    # Only texts with a fence go through the (interpreted) block logic; an
    # empty block list falls back to the trimmed text.
    return F.when(t.contains("```"), F.coalesce(F.nullif(best, F.lit("")), t)).otherwise(t)


_PREFIX_RES = tuple("^" + _jre(p) for p in ASSISTANT_PREFIXES)
_NON_ASCII_TAIL_RE = r"(?s)[^\x00-\x7F].*"
# Every marker starts with '<', '`' or a newline: the lookahead lets the regex
# engine reject most positions with one character-class test.
_MARKER_TAIL_RE = "(?s)(?=[<`\n])(" + "|".join(_jre(m) for m in CORRUPTION_MARKERS) + ").*"
_SQL_START_RE = r"(?s)^((?i:select|with).*)$"


def extract_sql(text, im_end_token: str = IM_END) -> Column:
    """Isolate the first SQL statement in generated text, or ''."""
    t = strip_code_fences(text)
    t = strip_ws(F.substring_index(t, im_end_token, 1))
    for prefix_re in _PREFIX_RES:
        t = strip_ws(F.regexp_replace(t, prefix_re, ""))
    t = strip_ws(F.regexp_replace(t, _NON_ASCII_TAIL_RE, ""))
    t = strip_ws(F.regexp_replace(t, _MARKER_TAIL_RE, ""))
    t = strip_ws(F.substring_index(t, ";", 1))
    # What is left is ASCII, so an ASCII case-insensitive prefix test is exact.
    return F.regexp_extract(t, _SQL_START_RE, 1)


# --- X6: validation ---------------------------------------------------------

def words(c) -> Column:
    """Maximal runs of word characters (the units Python's ``\\b`` separates)."""
    return F.split(_c(c), NON_WORD_RUN, -1)


_ALLOWED_START_RE = r"^(?iu:select|with)(?!" + WORD_CLASS + ")"


def _reason_from(raw: Column, s: Column, lowered: Column) -> Column:
    """The X6 chain from the raw text, its stripped form and the lowered
    stripped form. The comment tokens are tested on the stripped text
    (lower-casing never creates them); one word split decides whether any
    keyword is present, and only then is the first keyword in list order
    looked up."""
    reason = F.when(raw.isNull(), F.lit(REASON_NONE)).when(s == "", F.lit(REASON_EMPTY))
    for tok in FORBIDDEN_TOKENS:
        reason = reason.when(s.contains(tok), F.lit(REASON_TOKEN + tok))
    reason = reason.when(~s.rlike(_ALLOWED_START_RE), F.lit(REASON_PREFIX))
    kw_array = F.array(*[F.lit(k) for k in FORBIDDEN_KEYWORDS])
    first_kw = None
    for kw in FORBIDDEN_KEYWORDS:
        hit = F.array_contains(words(lowered), kw)
        msg = F.lit(REASON_KEYWORD + kw)
        first_kw = F.when(hit, msg) if first_kw is None else first_kw.when(hit, msg)
    reason = reason.when(F.arrays_overlap(words(lowered), kw_array), first_kw)
    return reason.when(F.regexp_replace(s, r";+\z", "").contains(";"), F.lit(REASON_MULTI))


def validation_reason(sql) -> Column:
    """The first failing rule's message, or null when the SQL is valid."""
    raw = _c(sql)
    s = strip_ws(raw)
    return _reason_from(raw, s, F.lower(s))


def validate_sql(sql) -> Column:
    """``struct(is_valid boolean, reason string)``."""
    reason = validation_reason(sql)
    return F.struct(reason.isNull().alias("is_valid"), reason.alias("reason"))


def add_validation(df: DataFrame, col: str, reason_out: str, valid_out: str | None = None) -> DataFrame:
    """X6 as DataFrame staging for long texts: the stripped text is computed
    once, in its own projection. Lower-casing happens only in the keyword
    branch, which texts failing the SELECT/WITH prefix test never reach."""
    s_col = f"_{reason_out}_s"
    out = df.withColumn(s_col, strip_ws(col))
    out = out.withColumn(reason_out, _reason_from(F.col(col), F.col(s_col), F.lower(F.col(s_col))))
    if valid_out:
        out = out.withColumn(valid_out, F.col(reason_out).isNull())
    return out.drop(s_col)


# --- X7: difficulty ---------------------------------------------------------

def _occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, as in ``str.count``."""
    return F.floor(
        (F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit(""))))
        / F.lit(len(needle))
    )


# "join" as a whole word, literal first so the regex engine can scan for the
# literal before testing the boundaries on either side.
_JOIN_WORD_RE = "join(?<!" + WORD_CLASS + "join)(?!" + WORD_CLASS + ")"


def join_count(low) -> Column:
    """Occurrences of ``\\bjoin\\b`` in (lower-cased) text."""
    return F.regexp_count(_c(low), F.lit(_JOIN_WORD_RE))


def _difficulty_from(low: Column, joins: Column) -> Column:
    from_pos = F.locate("from", low)
    has_subquery = (from_pos > 0) & F.substr(low, from_pos + F.lit(4)).contains("select")
    has_set_op = low.contains("intersect") | low.contains("union") | low.contains("except")
    has_nested = _occurrences(low, "select") >= 3
    return (
        F.when(has_nested | has_set_op, F.lit("extra"))
        .when((joins >= 2) | has_subquery | low.contains("having"), F.lit("hard"))
        .when((joins >= 1) | low.contains("group by") | low.contains("order by"), F.lit("medium"))
        .otherwise(F.lit("easy"))
    )


def difficulty(sql) -> Column:
    """Easy / medium / hard / extra from substring and word tests."""
    low = F.lower(_c(sql))
    return _difficulty_from(low, join_count(low))


def add_difficulty(df: DataFrame, col: str, out: str) -> DataFrame:
    """X7 as DataFrame staging: the lowered text and its join count are
    computed once, in their own projection."""
    low, joins = f"_{out}_low", f"_{out}_joins"
    staged = df.withColumn(low, F.lower(F.col(col))).withColumn(joins, join_count(F.col(low)))
    return staged.withColumn(out, _difficulty_from(F.col(low), F.col(joins))).drop(low, joins)


# --- X8, X9: token count and SELECT-star ------------------------------------

def sql_token_count(sql) -> Column:
    """Number of runs of non-whitespace (Python ``\\S+``). Every
    whitespace character is first mapped to a blank (``translate`` is a
    per-character table lookup), so the regex only has to test one character."""
    blanked = F.translate(_c(sql), WS, " " * len(WS))
    return F.coalesce(F.regexp_count(blanked, F.lit("[^ ]+")), F.lit(0)).cast("long")


# The leading lookahead is a cheap filter: only 's', 'S' and U+017F (which
# case-folds to 's') can start a case-insensitive "select".
_STAR_INTENDED_RE = "(?=[sS\u017f])(?<!" + WORD_CLASS + ")(?iu:select)" + _WS_CLASS + r"+\*"
_STAR_LITERAL_RE = _STAR_INTENDED_RE + "(?=" + WORD_CLASS + ")"


def uses_select_star(sql, pattern: str = "intended") -> Column:
    """``intended`` = SELECT followed by ``*``; ``literal`` = the original
    pattern, which needs a word character right after the ``*``."""
    regex = {"intended": _STAR_INTENDED_RE, "literal": _STAR_LITERAL_RE}[pattern]
    return F.coalesce(_c(sql).rlike(regex), F.lit(False))


# --- X10: error classes -----------------------------------------------------

def classify_error(exception_class, message) -> Column:
    """Error type from a driver-reported exception class and message."""
    cls = _c(exception_class)
    msg = F.lower(F.coalesce(_c(message), F.lit("")))
    operational = (
        F.when(msg.contains("interrupted"), F.lit("timeout"))
        .when(msg.contains("syntax error") | msg.contains("near"), F.lit("syntax_error"))
        .otherwise(F.lit("runtime_error"))
    )
    return (
        F.when(cls == "OperationalError", operational)
        .when(cls == "ProgrammingError", F.lit("forbidden"))
        .otherwise(F.lit("unknown_error"))
    )
