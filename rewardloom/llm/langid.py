"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sampled text. Dictionary
and text are in lower case, with a space for each run of ASCII characters that
are no letters. A text is cut into blocks, each block is compressed with each dictionary, and the language
with the fewest bytes over the whole text wins. Blocks keep a long text from
becoming its own dictionary, so that its length doesn't drown the difference.
The margin is the share of bytes that the best dictionary saves over the next
best; a margin below ``min_margin`` is a rejection. The score is
``margin / (margin + min_margin)``, at least one half exactly if not rejected.

The dictionaries come from ``rows_per_lang`` sampled distinct texts a language, with a
slice of ``slice_chars`` from each, up to ``dict_bytes``. Only these slices pass
through the driver. All texts are scored, and whole.

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; with one language learned, its margin is the saving over no dictionary;
with none, everything is ``und``; equal sizes take the first language in
alphabetical order; texts of any length are scored whole; repeated rows get equal
results; a null ``lang`` or null id is no training row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bytes compressed at once.
BLOCK = 2048
LEVEL = 6
MIN_MARGIN = 0.01
ROWS_PER_LANG, SLICE_CHARS, DICT_BYTES = 400, 300, 128 << 10
#: The most languages that may be learned; more raise.
MAX_LANGS = 2000

_LETTER = regex.compile(r"\p{L}")
RESULT = "struct<lang_pred: string, score: double, margin: double, rejected: boolean>"


#: ASCII bytes that are no letters become spaces.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "


@dataclass(frozen=True)
class LangModel:
    dictionaries: dict[str, bytes]
    min_margin: float = MIN_MARGIN

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: LangModel):
        self.langs = sorted(model.dictionaries)
        self.min_margin = model.min_margin
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compress = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, **plain).compress)
        if len(self.langs) == 1:
            self.compress.append(zstandard.ZstdCompressor(**plain).compress)

    def score(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        content = letters(text)
        blocks = [content[k : k + BLOCK] for k in range(0, len(content), BLOCK)]
        sizes = np.array([sum(len(f(b)) for b in blocks) for f in self.compress], dtype=np.float64)
        best = int(np.argmin(sizes[: len(self.langs)]))
        rival = float(np.delete(sizes, best).min())
        margin = max(0.0, (rival - sizes[best]) / rival)
        return self.langs[best], margin / (margin + self.min_margin), margin, margin < self.min_margin


def fit(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
    rows_per_lang: int = ROWS_PER_LANG, slice_chars: int = SLICE_CHARS, dict_bytes: int = DICT_BYTES, min_margin: float = MIN_MARGIN,
) -> LangModel:
    """Learns a dictionary for each non-null language of the rows that meet ``train``."""
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Distinct texts, for the draw below is one of texts: copies must not lower a language's share. Only hashes are dealt.
    prints = known.select("lang", F.xxhash64("text").alias("print")).distinct()
    # Languages are few.
    counts = {r["lang"]: r["n"] for r in prints.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return LangModel({}, min_margin)
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * rows_per_lang / n))])
    # A text shorter than the slice is taken whole; a longer one from a place that its hash names.
    start = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - slice_chars + 1, F.lit(1)))
    slices = known.where(place < share[F.col("lang")]).select("lang", F.substring("text", start, F.lit(slice_chars)).alias("slice")).distinct()
    parts: dict[str, list[str]] = {}
    for row in slices.orderBy("lang", F.xxhash64("slice"), "slice").collect():
        parts.setdefault(row["lang"], []).append(row["slice"])
    return LangModel({k: letters(" ".join(v[:rows_per_lang]))[-dict_bytes:] for k, v in parts.items()}, min_margin)


def predict_column(model: LangModel, text: Column) -> Column:
    """lang_pred, score, margin and rejected of a column of texts."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)  # at most dict_bytes a language
    made = []

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(held.value.scorer())
        return pd.DataFrame([made[0].score(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return run(text)
