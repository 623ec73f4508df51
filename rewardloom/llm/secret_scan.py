"""Secret scans: candidates by pattern, a random forest to remove false positives.

Candidates are quoted values after ``=`` or ``:``, private key blocks, JWTs, unquoted values
of 8 or more characters after a credential's name and ``=`` or ``:`` or after ``Bearer``, and
runs of 16 or more key characters that hold a digit or begin as a known key does. A name
before ``=`` is no part of the value. Each has figures of its length,
its kinds of characters and the changes between them, the letter pairs that words
of the corpus also have, the share that words of the corpus cover, marks of paths
and urls, and its neighbouring words. A random forest of Spark ML, trained on
labelled findings, scores them; findings below ``threshold`` are dropped as false
positives. All is done with DataFrame operations.

The dictionary is the ``DICTIONARY`` most frequent words of the whole corpus, counted
over all documents; the pairs are those of its words.
Labelled findings may be given; without them, ``reviewed`` labels the corpus's own
candidates by strict rules: known prefixes, and values with digits assigned to a
credential's name (no urls or dotted names), are secrets; the rest, with placeholders among it, are not. The
forest sees a bounded sample of the findings; every candidate is scored.

Cases: a null or empty text has no findings; texts of any length are scanned whole;
a secret that stands in a text twice gives two findings; repeated rows give
findings of their own; a null id is kept; with findings of one kind only, or
none, no forest is trained and the strict rules decide, with score 0 or 1;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import saved

DICTIONARY, MIN_WORD = 5000, 3
ROWS_PER_CLASS, TREES, DEPTH, SEED = 5000, 20, 6, 7
THRESHOLD = 0.5
CONTEXT = 40
MARK = "[SECRET]"

_KEY = r"A-Za-z0-9_+/\-"
_KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_\-]{30,}"
_NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credential|authorization|bearer)"
#: An unquoted value: to white space, a quote or a bracket, without marks of a sentence at its end.
_VALUE = r"(?![=:>])[^\s\"'<>&(){}\[\]]{7,}[^\s\"'<>&(){}\[\],;.:]"
#: Fixed patterns.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
    r"|(?<=[=:] {0,2}[\"'])[^\s\"']{8,}+"
    rf"|(?<![{_KEY}.])eyJ[A-Za-z0-9_\-]{{5,}}+\.[A-Za-z0-9_\-]{{5,}}+(?:\.[A-Za-z0-9_\-]*+)?"
    rf"|(?<=[=:>] {{0,2}})(?<=(?i:{_NAMES})\w{{0,40}}[\"']? {{0,2}}(?:=>|=|:) {{0,2}})(?!(?i:bearer) ){_VALUE}"
    rf"|(?<=[Bb](?:earer|EARER) {{1,2}}){_VALUE}"
    rf"|(?<![{_KEY}])(?=[A-Za-z_+/\-]*+[0-9]|{_KNOWN})[{_KEY}]{{16,}}+(?:={{1,2}}(?![{_KEY}=]))?"
)
PREFIX = rf"^(?:-----BEGIN|{_KNOWN}|eyJ[A-Za-z0-9_\-]+\.)"
NAME = "(?i)" + _NAMES
ASSIGNED = NAME + r"\w*[\"']? {0,2}(?:=|:|=>) {0,2}[\"']?$|bearer {1,2}$"
#: Unquoted values that name something else.
REFERENCE = r"(?i)^(?:https?://.*|[a-z_]\w*(?:\.[a-z_]\w*)+)$"
PLACEHOLDER = r"(?i)^(?:(.)\1*|.*(?:example|changeme|placeholder|your[_\-]).*|x{4,}.*)$"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FROM = _LETTERS + _LETTERS.upper() + "0123456789"
_TO = "a" * 26 + "A" * 26 + "0" * 10

FIGURES = [
    "size", "digits", "upper", "lower", "other", "changes", "distinct", "known_pairs", "known_words",
    "slashes", "dots", "url", "extension", "hex", "prefix", "named", "assigned", "quoted", "number_before", "placeholder",
]


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of the whole corpus."""
    words = docs.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # Marks beside a word fall off once each distinct form has been counted.
    plain = words.select(F.regexp_extract("word", r"^\P{L}*(\p{L}+)\P{L}*$", 1).alias("word"), "n").where(F.length("word") >= MIN_WORD)
    top = plain.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, value, start, before, after): every candidate of every text."""
    content = F.col("content")
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("content")).where(content.rlike(CANDIDATE))
    found = found.select(
        "doc_id", F.xxhash64("content").alias("text_hash"),
        F.regexp_extract_all("content", F.lit(CANDIDATE), 0).alias("values"), F.split("content", CANDIDATE, -1).alias("gaps"),
    )
    # Candidate k lies between gap k and gap k + 1, so it starts where both sequences' first k end.
    sizes = F.transform(F.arrays_zip("gaps", "values"), lambda x: F.length(x["gaps"]) + F.coalesce(F.length(x["values"]), F.lit(0)))
    ends = F.aggregate(
        sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    )
    rows = found.withColumn("ends", ends).select("doc_id", "text_hash", "gaps", "ends", "values", F.posexplode("values").alias("k", "value"))
    before, after = F.get("gaps", F.col("k")), F.get("gaps", F.col("k") + 1)
    # What is before: the gap, and the candidate before it, which may be the value's name.
    context = F.concat(F.when(F.col("k") > 0, F.get("values", F.col("k") - 1)).otherwise(""), before)
    return rows.select(
        "doc_id", "text_hash", "value", (F.get("ends", F.col("k")) + F.length(before)).alias("start"),
        F.right(context, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
    )


def _count(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")


def with_figures(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with the columns of FIGURES."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    size = F.length(value).cast("double")
    share = lambda n: n / F.greatest(size, F.lit(1.0))
    kinds = F.translate(value, _FROM, _TO)
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")).cast("double") - 1
    pairs = sorted({w[i : i + 2] for w in words for i in range(len(w) - 1)})
    lower = F.lower(value)
    own_pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substring(lower, i, F.lit(2)))
    runs = F.filter(F.split(lower, r"\P{L}+"), lambda r: F.length(r) >= MIN_WORD)
    covered = F.aggregate(F.filter(runs, lambda r: r.isin(words)), F.lit(0), lambda a, r: a + F.length(r))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    figures = {
        "size": size,
        "digits": share(_count(value, "[0-9]")), "upper": share(_count(value, "[A-Z]")), "lower": share(_count(value, "[a-z]")),
        "other": share(_count(value, "[^A-Za-z0-9]")), "changes": share(changes),
        "distinct": share(F.size(F.array_distinct(F.split(value, ""))).cast("double")),
        "known_pairs": share(F.size(F.filter(own_pairs, lambda p: p.isin(pairs))).cast("double")),
        "known_words": share(covered.cast("double")),
        "slashes": _count(value, "/"), "dots": _count(value, r"\."),
        "url": flag(value.rlike(r"(?i)^(?:https?:|www\.|//)") | before.rlike(r"(?i)(?:https?://|www\.)\S*$")),
        "extension": flag(value.rlike(r"(?i)\.(?:html?|js|css|png|jpe?g|py|java|txt|json|xml|md)$")),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")), "prefix": flag(value.rlike(PREFIX)),
        "named": flag(before.rlike(NAME)), "assigned": flag(before.rlike(r"[=:] {0,2}[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "number_before": flag(before.rlike(r"[0-9][ \-]?$")), "placeholder": flag(value.rlike(PLACEHOLDER)),
    }
    return found.withColumns(figures)


def reviewed() -> Column:
    """The label of a finding by strict rules: 1 secret, 0 not."""
    named = F.col("before").rlike(ASSIGNED) & F.col("value").rlike("[0-9]") & (F.length("value") >= 8) & ~F.col("value").rlike(REFERENCE)
    return ((F.col("value").rlike(PREFIX) | named) & ~F.col("value").rlike(PLACEHOLDER)).cast("double")


@dataclass(frozen=True)
class SecretModel:
    words: list[str]
    #: None where the findings were of one kind: the strict rules decide.
    forest: RandomForestClassificationModel | None


def fit(found: DataFrame, words: list[str], label: Column | None = None, rows_per_class: int = ROWS_PER_CLASS) -> SecretModel:
    """Trains the forest on a sample of labelled findings.

    :param found: findings as ``candidates`` gives them, with what ``label`` reads.
    :param label: 1.0 for a secret, 0.0 for a false positive.
    """
    labelled = found.withColumn("label", reviewed() if label is None else label).where(F.col("label").isin(0.0, 1.0))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return SecretModel(words, None)
    place = F.pmod(F.xxhash64("value", "before", "text_hash", "start"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1.0, min(1.0, rows_per_class / counts[1.0])).otherwise(min(1.0, rows_per_class / counts[0.0]))
    rows = with_figures(labelled.where(place < share), words)
    rows = saved(VectorAssembler(inputCols=FIGURES, outputCol="features").transform(rows).select("features", "label"), "findings")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    return SecretModel(words, forest)


def scored(found: DataFrame, model: SecretModel) -> DataFrame:
    """``found`` with a column ``score``: how likely a secret."""
    if model.forest is None:
        return found.withColumn("score", reviewed())
    kept = found.columns
    rows = VectorAssembler(inputCols=FIGURES, outputCol="features").transform(with_figures(found, model.words))
    return model.forest.transform(rows).select(*kept, vector_to_array("probability")[1].alias("score"))


def secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: SecretModel | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, text_hash, value, start, before, after, score) of all findings that stay."""
    found = saved(candidates(docs, doc_id, text), "candidates")
    if model is None:
        model = fit(found, dictionary(docs, text))
    return scored(found, model).where(F.col("score") >= threshold)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = MARK, **scan) -> DataFrame:
    """``docs`` with every finding that stays replaced by ``mark``, all columns kept.

    Texts without candidates pass as they are; only the others meet their findings
    in a join, on the id and the text's hash.
    """
    found = secrets(docs, doc_id, text, **scan)
    # A document's own values, the longest first, so that none is replaced within another.
    by_size = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    values = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("value"), by_size).alias("values"))
    has = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    rows = docs.where(has).select(F.struct("*").alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.col(text).cast("string")).alias("own_hash"))
    joined = rows.join(values, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    clean = F.aggregate(F.coalesce("values", F.array().cast("array<string>")), F.col(f"row.{text}"), lambda t, v: F.replace(t, v, F.lit(mark)))
    columns = [(clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return docs.where(~has).unionAll(joined.select(*columns))
