"""One-letter names, letters that run out, and international telephone numbers."""

import re
import string

from factorweave.llm import pii


def said(spark, texts):
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_one_letter_names_get_other_names(spark):
    texts = ["Mr X came. X left, A dog stayed.", "Mr J Smith met Mrs Smith.", "Mr. O met Mr. X.", "Ms A-B and Mr D'E.", "г-н Ж ушёл."]
    out = said(spark, texts)
    one = re.fullmatch(r"Mr (\w+) came\. (\w+) left, A dog stayed\.", out[0])
    assert one and one[1] == one[2] != "X"
    two = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+)\.", out[1])
    assert two and two[1] != "J" and two[2] == two[3] != "Smith"
    three = re.fullmatch(r"Mr\. (\w+) met Mr\. (\w+)\.", out[2])
    assert three and three[1] not in ("O", one[1]) and three[2] == one[1]
    four = re.fullmatch(r"Ms (\w+)-B and Mr (\w+)'E\.", out[3])
    assert four and four[1] != "A" and four[2] != "D"
    assert re.fullmatch(r"г-н [А-Я][а-я]* ушёл\.", out[4]) and "Ж" not in out[4]


def test_letters_run_out_and_names_stay_distinct(spark):
    letters = string.ascii_uppercase
    out = said(spark, [f"Mr {c}." for c in letters] + ["Mr Smith."])
    names = [re.fullmatch(r"Mr (\w+)\.", t)[1] for t in out]
    assert len(set(names)) == 27 and not set(names) & set(letters) and all(2 <= len(n) <= 6 for n in names[:26])


def test_rounds_only_move_those_that_lost(spark):
    from pyspark.sql import functions as F

    calls = []

    def make(key, kind, canonical, attempt):
        calls.append(1)
        return F.when(attempt < F.substring(canonical, 2, 2).cast("int"), F.lit("same")).otherwise(F.concat(F.lit("v"), canonical))

    found = spark.createDataFrame([("ip", f"a{i:02d}") for i in range(5)], "kind string, canonical string")
    moved = {r["canonical"]: r["attempt"] for r in pii.attempts_table(found, "k", make=make).collect()}
    assert moved == {"a02": 2, "a03": 3, "a04": 4} and len(calls) == 5  # a01 takes "same", which a00 does not want


def test_international_numbers(spark):
    numbers = ["+33 1 42 68 53 00", "+49 30 1234567", "+44 (20) 7946 0958", "+39-06-1234-5678"]
    kept = ["+1", "+12 34", "1 42 68 53 00", "C++11 22 33"]
    out = said(spark, [f"Call {n} now" for n in numbers] + [f"see {k} end" for k in kept])
    for n, t in zip(numbers, out):
        shape = re.sub(r"\d", "0", n)
        assert re.sub(r"\d", "0", t) == f"Call {shape} now" and n not in t
    assert out[4:] == [f"see {k} end" for k in kept]
