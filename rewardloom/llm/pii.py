"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern, a validator and context words. Its matches are found from the
left without overlap; a match that its validator refuses is dropped and its characters
are not tried again. Card numbers pass Luhn's check, IBANs leave 1 modulo 97, parts of
an ip address are at most 255, phone numbers have 8 to 15 digits. A score starts at the
kind's prior, rises when a context word of the kind stands within ``CONTEXT`` code points
of the match, and falls when a word before it names something else. Context ends at the
next match of the same kind.

The four base kinds (email, ip, card, phone) stay whatever their score. The method adds
spans that score ``threshold`` or more: IBANs, social security numbers, and numbers that
the base patterns lose (a card among longer digit runs, a phone number without its
``+``), which need a context word to pass. An added span that overlaps a base span of
its kind is left out.

All is done with column functions. Patterns take a time that grows with the text: runs
are matched possessively and from their start only. Positions come from the
lengths of matches and gaps, summed by chunks, so texts with many matches stay cheap.

Cases: a null or empty text has no spans; texts of any length are read whole; repeated
rows and null ids give a row each; an empty table gives no rows; other columns are not
read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, THRESHOLD = 40, 0.5
#: How much a context word, or a word that names something else, moves a score.
RAISE, LOWER = 0.3, 0.3
#: Matches whose lengths are summed at once.
CHUNK = 256
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL = "A-Za-z0-9._%+-"
#: Words that name a number as something else.
OTHER_NUMBER = r"(?i)\b(?:order|invoice|version|isbn|serial|tracking|build|part|item)\b"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def place(total: Column, at: Column) -> Column:
        d = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), place) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def place(rest: Column, at: Column) -> Column:
        value = F.instr(F.lit(_ALNUM), F.substring(turned, at, F.lit(1))) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), place) == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, least: int) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(least, 19), luhn(digits)).otherwise(False)


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def _iban(value: Column) -> Column:
    return mod97(F.regexp_replace(value, " ", ""))


def _social(value: Column) -> Column:
    return ~value.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """How one kind of personal data is found.

    :param needs: a character that every match holds; texts without it are not searched.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    context: str
    base: bool = False
    needs: str | None = None


#: The order of kinds in results is that of their first entry here.
KINDS = (
    Kind(
        "email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.7,
        r"(?i)\b(?:e-?mail|contact|write to|mailto|from|cc)\b", base=True, needs="@",
    ),
    Kind(
        "ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", _ip, 0.5,
        r"(?i)\b(?:ip|host|address|server|client|login)\b", base=True, needs=".",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda v: _card(v, 16), 0.6,
        r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|expir\w*|cvv)\b", base=True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6,
        r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp)\b", base=True, needs="+",
    ),
    Kind(
        "iban",
        r"[A-Z][A-Z](?<![A-Za-z0-9]..)[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _iban, 0.8,
        r"(?i)\b(?:iban|account|bank|transfer|konto)\b",
    ),
    Kind(
        "ssn", r"[0-9](?<![0-9A-Za-z-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _social, 0.3,
        r"(?i)\b(?:ssn|social security)\b", needs="-",
    ),
    Kind(
        "card", r"[0-9](?<![0-9].)[0-9]{3}(?:[0-9]{9,15}|(?:[\x20-][0-9]{4}){3}|[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
        lambda v: _card(v, 13), 0.3, r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cvv)\b",
    ),
    Kind(
        "phone", r"[(0-9](?<![0-9A-Za-z+.(-].)(?:(?<=\()[0-9]{2,5}\)|(?<!\()[0-9]{1,4})[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])",
        _phone, 0.3, r"(?i)\b(?:phone|tel|telephone|mobile|cell|fax|whatsapp)\b",
    ),
)
_SPANS = "array<struct<place:int,start:int,end:int,kind:string,base:boolean,score:double,value:string>>"
_ORDER = list(dict.fromkeys(k.name for k in KINDS))


def _values(kind: Kind) -> Column:
    found = F.regexp_extract_all("content", F.lit(kind.pattern), F.lit(0))
    return found if kind.needs is None else F.when(F.contains("content", F.lit(kind.needs)), found).otherwise(F.array().cast("array<string>"))


def _gaps(kind: Kind, k: int) -> Column:
    """The texts between the valid kind's matches; null where no match is valid."""
    return F.when(F.exists(f"values{k}", kind.valid), F.split("content", kind.pattern, -1))


def _spans(kind: Kind, k: int, threshold: float) -> Column:
    """The kind's spans that stay, from its matches, gaps and summed sizes."""
    values, gaps, sizes, sums = (F.col(f"{name}{k}") for name in ("values", "gaps", "sizes", "sums"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    def span(i: Column) -> Column:
        value, gap, after = F.get(values, i), F.get(gaps, i), F.get(gaps, i + 1)
        chunk = F.floor(i / CHUNK).cast("int")
        start = total(F.slice(sums, F.lit(1), chunk)) + total(F.slice(sizes, chunk * CHUNK + 1, i % CHUNK)) + F.length(gap)
        before = F.right(gap, F.lit(CONTEXT))
        near = F.concat(before, F.lit("\n"), F.left(after, F.lit(CONTEXT)))
        moved = F.when(near.rlike(kind.context), RAISE).otherwise(0.0) - F.when(before.rlike(OTHER_NUMBER), LOWER).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.lit(kind.prior) + moved, 3)))
        return F.struct(
            F.lit(_ORDER.index(kind.name)).alias("place"), start.alias("start"), (start + F.length(value)).alias("end"),
            F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"), score.alias("score"), value.alias("value"),
        )

    fine = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: kind.valid(F.get(values, i)))
    spans = F.transform(fine, span)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= threshold)
    return F.when(gaps.isNotNull(), spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans): one row a document.

    ``spans`` is an array of (place, start, end, kind, base, score, value) by kind, then start;
    ``place`` is the kind's number.
    """
    every = range(len(kinds))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    # One select a step: what a step reads several times is computed once.
    rows = rows.select("doc_id", "content", *[_values(kinds[k]).alias(f"values{k}") for k in every])
    rows = rows.select("doc_id", *[f"values{k}" for k in every], *[_gaps(kinds[k], k).alias(f"gaps{k}") for k in every])
    size = lambda k: F.transform(F.arrays_zip(f"gaps{k}", f"values{k}"), lambda x: F.length(x[f"gaps{k}"]) + F.coalesce(F.length(x[f"values{k}"]), F.lit(0)))
    rows = rows.select("*", *[size(k).alias(f"sizes{k}") for k in every])
    chunks = lambda k: F.sequence(F.lit(0), F.floor((F.size(f"sizes{k}") - 1) / CHUNK).cast("int"))
    summed = lambda k: F.transform(
        chunks(k), lambda c: F.aggregate(F.slice(F.col(f"sizes{k}"), c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, b: a + b)
    )
    rows = rows.select("*", *[F.when(F.col(f"gaps{k}").isNotNull(), summed(k)).alias(f"sums{k}") for k in every])
    rows = rows.select("doc_id", *[_spans(kinds[k], k, threshold).alias(f"spans{k}") for k in every])
    none = F.array().cast(_SPANS)
    joined = lambda base: F.concat(none, *[F.coalesce(F.col(f"spans{k}"), none) for k in every if kinds[k].base is base])
    rows = rows.select("doc_id", joined(True).alias("own"), joined(False).alias("added"))
    clear = lambda s: ~F.exists("own", lambda b: (b["place"] == s["place"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select("doc_id", F.array_sort(F.concat("own", F.filter("added", clear))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
