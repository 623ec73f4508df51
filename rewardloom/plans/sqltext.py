"""DuckDB restatements of the text rules (X1-X9), used by the oracle
statements. Written from the rules' definitions, not from the Spark code:
DuckDB's RE2 has no look-around, so word boundaries are tested by splitting
into word runs."""

from __future__ import annotations

from rewardloom.functions import text as T
from rewardloom.plans.bindings import sql_str

WS = sql_str(T.WS)
NON_WORD = sql_str(r"[^\p{L}\p{N}_]+")


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def ensure_im_end(expr: str) -> str:
    s = strip(f"coalesce({expr}, '')")
    end = sql_str(T.IM_END)
    return f"(CASE WHEN {s} = '' THEN {end} WHEN ends_with({s}, {end}) THEN {s} ELSE {s} || {end} END)"


def completion(expr: str) -> str:
    return f"({strip(expr)} || {sql_str(T.IM_END)})"


def words(expr: str) -> str:
    return f"regexp_split_to_array({expr}, {NON_WORD})"


def has_word(expr: str, word: str) -> str:
    return f"list_contains({words(expr)}, {sql_str(word)})"


def strip_code_fences(expr: str) -> str:
    t = strip(expr)
    blocks = (
        f"list_filter(list_transform(string_split(replace({t}, '```sql', '```'), '```'), "
        f"lambda p: {strip('p')}), lambda b: length(b) > 0)"
    )
    longest = f"list_reduce(list_prepend('', {blocks}), lambda acc, b: CASE WHEN length(b) > length(acc) THEN b ELSE acc END)"
    return f"(CASE WHEN NOT contains({t}, '```') THEN {t} WHEN len({blocks}) = 0 THEN {t} ELSE {longest} END)"


def extract_sql(expr: str) -> str:
    t = strip_code_fences(expr)
    t = strip(f"split_part({t}, {sql_str(T.IM_END)}, 1)")
    for p in T.ASSISTANT_PREFIXES:
        t = f"(CASE WHEN starts_with({t}, {sql_str(p)}) THEN {strip(f'substr({t}, {len(p) + 1})')} ELSE {t} END)"
    t = strip(f"regexp_replace({t}, {sql_str('(?s)[^\\x00-\\x7F].*')}, '')")
    markers = "|".join(["<[|]", "<quote", "```", "\n\n", "\nSELECT", "\nWITH"])
    t = strip(f"regexp_replace({t}, {sql_str('(?s)(' + markers + ').*')}, '')")
    t = strip(f"split_part({t}, ';', 1)")
    return f"(CASE WHEN starts_with(lower({t}), 'select') OR starts_with(lower({t}), 'with') THEN {t} ELSE '' END)"


def validation_reason(expr: str) -> str:
    s = strip(expr)
    low = f"lower({s})"
    parts = [f"WHEN {expr} IS NULL THEN {sql_str(T.REASON_NONE)}", f"WHEN {s} = '' THEN {sql_str(T.REASON_EMPTY)}"]
    for tok in T.FORBIDDEN_TOKENS:
        parts.append(f"WHEN contains({low}, {sql_str(tok)}) THEN {sql_str(T.REASON_TOKEN + tok)}")
    first_word = f"{words(low)}[1]"
    parts.append(f"WHEN coalesce({first_word} NOT IN ('select', 'with'), TRUE) THEN {sql_str(T.REASON_PREFIX)}")
    for kw in T.FORBIDDEN_KEYWORDS:
        parts.append(f"WHEN {has_word(low, kw)} THEN {sql_str(T.REASON_KEYWORD + kw)}")
    parts.append(f"WHEN contains(rtrim({s}, ';'), ';') THEN {sql_str(T.REASON_MULTI)}")
    return "(CASE " + " ".join(parts) + " ELSE NULL END)"


def difficulty(expr: str) -> str:
    low = f"lower({expr})"
    joins = f"len(list_filter({words(low)}, lambda w: w = 'join'))"
    fpos = f"strpos({low}, 'from')"
    sub = f"({fpos} > 0 AND contains(substr({low}, {fpos} + 4), 'select'))"
    setop = f"(contains({low}, 'intersect') OR contains({low}, 'union') OR contains({low}, 'except'))"
    nested = f"((length({low}) - length(replace({low}, 'select', ''))) // 6 >= 3)"
    return (
        f"(CASE WHEN {nested} OR {setop} THEN 'extra' "
        f"WHEN {joins} >= 2 OR {sub} OR contains({low}, 'having') THEN 'hard' "
        f"WHEN {joins} >= 1 OR contains({low}, 'group by') OR contains({low}, 'order by') THEN 'medium' "
        f"ELSE 'easy' END)"
    )


def token_count(expr: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({expr}, {sql_str('[^' + T.WS + ']+')})), 0) AS BIGINT)"


def star(expr: str, literal: bool = False) -> str:
    pat = "(^|[^\\p{L}\\p{N}_])(?i:select)[" + T.WS + "]+[*]"
    if literal:
        pat += "[\\p{L}\\p{N}_]"
    return f"coalesce(regexp_matches({expr}, {sql_str(pat)}), FALSE)"


def split_first(expr: str, sep: str) -> str:
    return f"split_part({expr}, {sql_str(sep)}, 1)"


def extract_sql_staged(source: str, text_col: str = "text", out_col: str = "sql") -> str:
    """X4+X5 over a source, one derived column per step (keeps the SQL small)."""
    end = sql_str(T.IM_END)
    p1, p2 = (sql_str(p) for p in T.ASSISTANT_PREFIXES)
    l1, l2 = (len(p) + 1 for p in T.ASSISTANT_PREFIXES)
    markers = sql_str("(?s)(" + "|".join(["<[|]", "<quote", "```", "\n\n", "\nSELECT", "\nWITH"]) + ").*")
    nonascii = sql_str("(?s)[^\\x00-\\x7F].*")
    empty = "''"
    steps = [
        f"{strip(text_col)} AS _x0",
        f"list_filter(list_transform(string_split(replace(_x0, '```sql', '```'), '```'), lambda p: {strip('p')}), lambda b: length(b) > 0) AS _xb",
        "CASE WHEN NOT contains(_x0, '```') OR len(_xb) = 0 THEN _x0 ELSE list_reduce(list_prepend('', _xb), "
        "lambda acc, b: CASE WHEN length(b) > length(acc) THEN b ELSE acc END) END AS _x1",
        f"{strip(f'split_part(_x1, {end}, 1)')} AS _x2",
        f"CASE WHEN starts_with(_x2, {p1}) THEN {strip(f'substr(_x2, {l1})')} ELSE _x2 END AS _x3",
        f"CASE WHEN starts_with(_x3, {p2}) THEN {strip(f'substr(_x3, {l2})')} ELSE _x3 END AS _x4",
        f"{strip(f'regexp_replace(_x4, {nonascii}, {empty})')} AS _x5",
        f"{strip(f'regexp_replace(_x5, {markers}, {empty})')} AS _x6",
        f"{strip(split_first('_x6', ';'))} AS _x7",
        f"CASE WHEN starts_with(lower(_x7), 'select') OR starts_with(lower(_x7), 'with') THEN _x7 ELSE '' END AS {out_col}",
    ]
    q = f"SELECT * FROM {source}"
    for s in steps:
        q = f"(SELECT *, {s} FROM {q if q.startswith('(') else '(' + q + ')'})"
    drop = ", ".join(["_x0", "_xb", "_x1", "_x2", "_x3", "_x4", "_x5", "_x6", "_x7"])
    return f"(SELECT * EXCLUDE ({drop}) FROM {q})"
