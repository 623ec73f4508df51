from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from rewardloom.llm import pii
from rewardloom.llm import queries as Q

from .conftest import SF_MORE


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute(text, kinds=BASE):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, fine in kinds for m in re.finditer(p, text or "") if fine(m.group())]


def spans(spark, *texts):
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return [r["spans"] for r in rows]


def shown(found, base=None):
    return [f"{s.kind}:{s.start}:{s.end}" for s in found if base is None or s.base is base]


def test_base_spans_equal_the_patterns_as_stated(spark):
    rng = random.Random(5)
    pieces = ["a", "b_", "@", ".", "-", "+", " ", "(", ")", "1", "4", "256", "12.3", "+1 ", "é", "\U0001f600", "\n", "@x.y", "4111 1111 1111 1111", "9.9.9.9"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, found in zip(texts, spans(spark, *texts)):
        assert shown(found, True) == brute(text), text


def test_planted_kinds(spark):
    texts = {
        "write to a.b+c@mail.example.com.": ["email:9:31"],
        "from 010.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8": ["ip:5:16", "ip:35:42", "ip:43:50"],
        "4111 1111 1111 1111, 4111111111111112, 4111-1111-1111-1111": ["card:0:19", "card:39:58"],
        "call +1 (017) 555-7713 or +12 34": ["phone:5:22"],
        "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013001": ["iban:5:32"],
        "\U0001f600 GB82WEST12345698765432.": ["iban:2:24"],
        "SSN 123-45-6789 and SSN 000-45-6789 and 123-45-6780": ["ssn:4:15"],
        "visa 4111111111111111 4111111111111112": ["card:5:21"],  # the base pattern takes both as one run of 32 digits
        "4111111111111111 4111111111111112": [],
        "tel (0171) 555 7713, order 0171 555 7713": ["phone:4:19"],
        "card order no 378282246310005 tracking": [],
    }
    for text, found in zip(texts, spans(spark, *texts)):
        assert shown(found) == texts[text], text


def test_context_moves_the_score(spark):
    plain, raised, lowered, far = [s[0].score for s in spans(
        spark, "x 4111111111111111", "credit 4111111111111111", "invoice 4111111111111111", "credit" + " x" * 40 + " 4111111111111111"
    )]
    assert lowered < plain == far < raised


def test_checksums(spark):
    codes = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "DE88370400440532013000"]
    numbers = ["4111111111111111", "79927398713", "79927398710", "0"]
    rows = spark.createDataFrame(list(zip(codes, numbers)), "c string, n string").select(pii.mod97(F.col("c")), pii.luhn(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (True, True), (True, False), (False, True)]


def test_very_long_texts_take_linear_time(spark):
    """Runs that could be tried from each of their characters, and many matches."""
    mail = "a.b@" + "c." * 100_000
    runs = "a" * 300_000 + " " + "1.2.3" * 50_000 + " " + "+1" + " " * 300_000 + "7 " * 100_000 + mail
    many = "x@y.zz, " * 20_000 + "1 " * 10
    first, second = spans(spark, runs, many)
    own = f"email:{len(runs) - len(mail)}:{len(runs) - 1}"
    assert shown(first, True) == [own, *brute(runs, BASE[1:])] and len(second) == 20_000
    assert (second[-1].start, second[-1].end) == (8 * 19_999, 8 * 19_999 + 6)


def test_awkward_rows_and_empty_tables(spark, awkward):
    rows = Q.personal_data(awkward).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in awkward.collect())
    assert all(tuple(r)[1:] == (0, 0, 0, 0, empty, "") for r in rows)
    assert Q.personal_data(awkward.limit(0)).collect() == []


def test_query_equals_brute_force_without_python(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").select("doc_id", "text").collect()}
    df = Q.op12_pii(spark, SF_MORE)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    rows = {r["doc_id"]: r for r in df.collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        want = brute(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(rows[i]["spans"].split(",") if rows[i]["spans"] else [])
        assert [rows[i][f"n_{k}"] for k, _, _ in BASE] == [sum(w.startswith(k) for w in want) for k, _, _ in BASE]
