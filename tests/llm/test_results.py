"""Operators against brute force, libraries and SQL."""

import collections
import gzip
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorweave.llm import attention, exact_dedup, fixity, jaccard_join, line_dedup, lm_scoring, ngram_quality, packing, pii, piece_transducer, textkit
from factorweave.llm import queries as Q

DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, sql = Q.queries()[name](spark, DIR), con.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(map(str, (r[i] for i in at))) for r in sql.fetchall())


def test_near_copies_chain_into_one_component(spark):
    random.seed(5)
    base = [f"w{i}" for i in range(120)]
    rows, text = [], base
    for i in range(30):  # each is like the one before, the ends are not alike
        text = [*text]
        text[4 * i % 120] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(f"other{i}x{j}" for j in range(50))) for i in range(5)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label and len(set(label.values())) < 20


def components_brute(rows):
    """The smallest id each document reaches by links of 80 per cent; rows are (id, text)."""
    words = {i: WORD.findall(t.translate(FOLD)) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    label = {i: i for i in sets}
    todo = list(sets)
    while todo:
        i = todo.pop()
        for j in sets:
            if label[j] > label[i] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[j] = label[i]
                todo.append(j)
    return label


def test_large_group_of_near_copies_and_a_shared_passage(spark):
    """One group whose copies differ in up to a dozen places, some too far from the others, and documents that only share a passage."""
    random.seed(9)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        t = [*base]
        for k in random.sample(range(150), random.randint(0, 7)):
            t[k] = random.choice([f"m{k}", f"r{i}x{k}"])  # some changes recur in other copies
        rows.append((i, " ".join(t)))
    for i in range(120, 180):
        own = [f"o{i}x{k}" for k in range(random.choice([3, 10, 40]))]
        rows.append((i, " ".join(own + passage + [f"c{k}" for k in range(i % 4)])))
    random.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_brute(rows) and 3 < len(set(got.values())) < 150


def test_texts_that_share_an_id_link_on_their_own(spark):
    one, two = ([f"{x}{i}" for i in range(40)] for x in "ab")
    rows = [(3, " ".join(one)), (3, " ".join(two)), (4, " ".join(one[:20] + two[:20])), (5, " ".join(two)), (None, " ".join(one) + " end")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 37, 3), (3, 36, 3), (3, 36, 3), (4, 36, 4), (5, 36, 3)]


def test_weak_digests_do_not_merge_different_texts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup_report(rows, digest=lambda t: F.length(t)).collect()}
    assert got == {i: max(j for j in range(50) if j % 7 == i % 7) for i in range(50)}


def test_surrogates(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Mrs. Anna Smith 4539578763621486 bob@x.org +1 (246) 555-1219"), (2, "Mr. Smith 4539 5787 6362 1486 BOB@X.ORG 246-555-1219"), (3, "г-жа Анна Иванова 10.2.3.4"), (4, "nothing here, 12 apples")]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[4] == rows[3][1]
    one, two = out[1].split(), out[2].split()
    assert one[2] == two[1] and one[1].endswith("a") and one[3] == "".join(two[2:6])
    digits = [int(c) for c in reversed(one[3])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert one[4].upper() == two[6] and re.sub(r"\D", "", "".join(one[5:]))[1:] == re.sub(r"\D", "", two[7])
    assert re.fullmatch(r"г-жа [а-я]+на [а-я]+ [\d.]+", out[3].replace(out[3].split()[1], out[3].split()[1].lower()).replace(out[3].split()[2], out[3].split()[2].lower()))
    real = pii.surrogate
    weak = lambda key, kind, canonical, attempt: F.when(attempt < 2, F.lit("1.1.1.1")).otherwise(real(key, kind, canonical, attempt))
    found = spark.createDataFrame([("ip", f"1.1.1.{i}") for i in range(1, 6)], "kind string, canonical string")
    assert {r["canonical"]: r["attempt"] for r in pii.attempts_table(found, "k", make=weak).collect()} == {f"1.1.1.{i}": 2 for i in range(1, 6)}


def test_names_of_every_form_are_replaced_with_their_later_mentions(spark):
    texts = [
        "Mr McDonald met Mrs Anne-Marie O'Brien. McDonald's dog bit O'Brien, and ANNE-MARIE laughed; mcdonald is no name here.",
        "Frau Müller-Lüdenscheidt und Prof. Dr. Ludwig van Beethoven: Ludwig sah Müller-Lüdenscheidt. Beethovenstraße.",
        "Mr. J. R. Smith and Mrs. Smith. Smith paid, Anna did not. Mrs. Anna Smith came. Dr. Jones saw Smith.",
        "Version 10.12.13.14 and v1.2.3.4, but 10.12.13.14 is an address and 10.12.13.999 is none.",
        "Don Quijote de la Mancha, г-н Иванов. Иванов ушёл.",
    ]
    rows = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    said = [r["text"] for r in pii.replace_pii(rows).orderBy(pii.F.coalesce("doc_id", pii.F.lit(1))).collect()]
    for word in ("McDonald", "Anne", "Marie", "Brien", "ANNE", "Müller", "Lüdenscheidt", "Ludwig", "Smith", "Anna", "Jones", "Quijote", "Иванов", "J. R."):
        assert not any(re.search(rf"(?<!\w){word}(?!\w)", t) for t in said), (word, said)
    assert re.search(r"Beethoven(?!s)", said[1]) is None and said[1].endswith(" Beethovenstraße.") and "mcdonald is" in said[0]
    one = re.fullmatch(r"Mr (\w+) met Mrs (\w+-\w+) (O'\w+)\. (\w+)'s dog bit (O'\w+), and (\w+-\w+) laughed.*", said[0])
    assert one and one[1] == one[4] and one[3] == one[5] and one[2].upper() == one[6] and one[2].split("-")[0] != one[2].split("-")[1]
    two = re.fullmatch(r"Frau (\w+-\w+) und Prof\. Dr\. (\w+) van (\w+): (\w+) sah (\S+)\. .*", said[1])
    assert two and two[1] == two[5] and two[2] == two[4]
    three = re.fullmatch(r"Mr\. (\w)\. (\w)\. (\w+) and Mrs\. (\w+)\. (\w+) paid, (\w+) did not\. Mrs\. (\w+) (\w+) came\. Dr\. (\w+) saw (\w+)\.", said[2])
    assert three and len({three[3], three[4], three[5], three[8], three[10]}) == 1 and three[6] == three[7] and three[1] != "J" and three[9] != three[3] and three[6].endswith("a")
    assert said[3].startswith("Version 10.12.13.14 and v1.2.3.4, but ") and said[3].endswith("10.12.13.999 is none.") and said[3].count("10.12.13.14") == 1
    four = re.fullmatch(r"Don (\w+) de la (\w+), г-н ([А-я]+)\. ([А-я]+) ушёл\.", said[4])
    assert four and four[3] == four[4] and four[2] != "Mancha"


def test_surrogates_are_distinct_and_corefer_over_a_corpus(spark):
    """Brute force: a bijection between the entities written into the texts and what stands there afterwards."""
    random.seed(6)
    kinds = {
        "surname": lambda i: "N" + "".join(chr(97 + int(d)) for d in f"{i:04d}"), "email": lambda i: f"user{i}@host{i % 7}.org", "ip": lambda i: f"10.{i % 250}.{i // 250}.77", "ssn": lambda i: f"{100 + i % 800}-{10 + i % 80}-{1000 + i}",
        "phone": lambda i: f"+1 (2{i % 90 + 10}) 555-{1000 + i}",
    }
    texts = [" ; ".join((k, ("Mr. " if k == "surname" else "") + kinds[k](i))[1] for k, i in ((random.choice(list(kinds)), random.randrange(300)) for _ in range(12))) for _ in range(200)]
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    new_of, old_of = {}, {}
    for r in rows:
        old, new = texts[r["doc_id"]].split(" ; "), r["text"].split(" ; ")
        assert len(old) == len(new) == r["n_entities"]
        for a, b in zip(old, new):
            assert a != b and new_of.setdefault(a, b) == b and old_of.setdefault(b, a) == a
    assert not set(new_of) & set(old_of)


def test_fixity_finds_exactly_the_damage(spark, docs):
    records = fixity.archived(docs)
    good = fixity.with_offsets(fixity.leaves(records))
    assert {r["status"] for r in fixity.audit(good, good).collect()} == {"intact"}
    victim = good.orderBy("archive", "slot").first()
    bad = good.withColumn("hash", __import__("pyspark.sql.functions", fromlist=["x"]).expr(f"if(archive = '{victim['archive']}' and slot = {victim['slot']}, 'x', hash)"))
    faults = [(r["archive"], r["slot"], r["offset"], r["status"]) for r in fixity.audit(good, bad).collect() if r["status"] != "intact"]
    assert faults == [(victim["archive"], victim["slot"], victim["offset"], "altered")]


@pytest.mark.parametrize("damaged", [[5], [5000], [5, 4095, 4096, 5000, 8999], [8999, 9000]])
def test_fixity_above_one_tree_of_three_levels(spark, damaged):
    from pyspark.sql import functions as F

    good = spark.range(9000).select(F.lit("a").alias("archive"), F.col("id").alias("slot"), (F.col("id") * 10).alias("offset"), F.lit(10).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    small = good.where("slot < 20").withColumn("archive", F.lit("b"))
    good = good.unionByName(small)
    bad = good.withColumn("hash", F.when(F.col("slot").isin(damaged) & (F.col("archive") == "a"), "x").otherwise(F.col("hash")))
    if 9000 in damaged:
        bad = bad.unionByName(good.where("archive = 'a' and slot = 0").withColumn("slot", F.lit(9000).cast("long")))
    rows = fixity.audit(good, bad).collect()
    assert sorted((r["archive"], r["slot"], r["status"]) for r in rows) == [*(("a", i, "extra in b" if i == 9000 else "altered") for i in damaged), ("b", -1, "intact")]


def test_many_warc_records_are_read_once_each():
    record = lambda i: (b"WARC/1.0\r\nContent-Length: 2000\r\n\r\n" + bytes([65 + i % 20]) * 2000 + b"\r\n\r\n")
    for pack in (bytes, gzip.compress):
        data = b"".join(pack(record(i)) for i in range(12000))
        rows = list(fixity.split_records(data))
        assert len(rows) == 12000 and rows[-1][0] + rows[-1][1] == len(data) and all(r[4] == bytes([65 + i % 20]) * 2000 for i, r in enumerate(rows))
        assert list(fixity.split_records(data[:-9]))[-1][3] is None


def test_warc_files_are_read_by_record(spark, tmp_path):
    record = lambda i: f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {len(f'body {i}')}\r\n\r\nbody {i}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i) for i in range(3)) + b"WARC/1.0\r\ncut")
    rows = fixity.read_warc(spark, str(tmp_path)).orderBy("archive", "slot").collect()
    assert [bytes(r["payload"]) for r in rows[:8]] == [f"body {i}".encode() for i in [0, 1, 2, 3, 4, 0, 1, 2]]
    assert rows[8]["headers"] is None and all(b["offset"] == a["offset"] + a["length"] for a, b in zip(rows[:4], rows[1:5]))


def test_quality_base_figures(spark, docs, texts):
    for r in ngram_quality.quality_report(docs).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:]))
        times = collections.Counter(grams)
        again = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t)) and r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["log10_lower"] <= r["log10_perplexity"] <= r["log10_upper"])


def test_kneser_ney_probabilities_sum_to_one(docs):
    model = ngram_quality.Model(ngram_quality.model_table(ngram_quality.counts_by_order(ngram_quality.count_grams(docs, 3), 3)).toArrow(), 3)
    for p in model.pools:
        table = 10 ** model.log10(p, np.arange(64**3)).reshape(-1, 64)
        assert np.allclose(table.sum(1), 1, atol=1e-9) and table.min() > 0


def kneser_ney_brute(texts, order):
    """log10 probability of each text under modified Kneser-Ney trained on texts, straight from its recursion."""
    padded = [(*[0] * (order - 1), *ngram_quality.classes(t).tolist(), 0) for t in texts]
    counts = {order: collections.Counter(s[i : i + order] for s in padded for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        t = collections.Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        discount[k] = [max(0.1, min(i - 0.1, i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i)) for i in (1, 2, 3)]

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / 64
        seen = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not seen:
            return prob(gram[1:])
        cut = lambda n: discount[k][min(n, 3) - 1]
        total = sum(seen.values())
        own = (seen[gram] - cut(seen[gram])) / total if gram in seen else 0
        return own + sum(map(cut, seen.values())) / total * prob(gram[1:])

    return [sum(math.log10(prob(s[i : i + order])) for i in range(len(s) - order + 1)) for s in padded]


def test_perplexity_equals_brute_force(spark):
    random.seed(4)
    texts = ["".join(random.choices("abc DÉ#|\n7;ж漢", k=random.randint(0, 60))) for _ in range(12)] + ["", "ab ab ab"]
    rows = ngram_quality.judged(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), 3, 4.0, 6.0).collect()
    for r, t, wanted in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, kneser_ney_brute(texts, 3)):
        lettered = sum(any(3 <= c < 30 for c in ngram_quality.classes(w)) for w in re.split(r"[ \n]", t))
        assert r["n_lettered"] == lettered and math.isclose(r["log10_prob"], wanted, rel_tol=1e-9), t
        assert math.isclose(r["log10_ppl"], -wanted / max(1, lettered), rel_tol=1e-9)


def test_quality_bands_reject_junk_and_keep_clean(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    report = [r for r in ngram_quality.quality_report(spark.read.parquet(f"{at}/documents.parquet")).collect() if not r["base_failed"]]
    junk, clean = ([r["kept"] for r in report if labels.get(r["doc_id"]) == q] for q in (0, 1))
    assert len(junk) > 10 and sum(junk) <= 0.02 * len(junk) and sum(clean) >= 0.98 * len(clean)


def test_quality_filter_tells_rows_apart_by_id_language_and_text(spark):
    good = spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'en'").orderBy("doc_id").select("text").collect()
    report = ngram_quality.quality_report(spark.createDataFrame([(i, r["text"], "en") for i, r in enumerate(good)], "doc_id long, text string, lang string"))
    kept = [good[r["doc_id"]]["text"] for r in report.orderBy("doc_id").collect() if r["kept"]]
    rows = [(i, t, "en") for i, t in enumerate(kept)] + [(None, kept[0], "en"), (None, "too short", "en"), (1, "short too", "en"), (2, kept[2], "en")]
    out = ngram_quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not {"too short", "short too"} & {r["text"] for r in out} and sum(r["doc_id"] is None for r in out) == 1 and sum(r["doc_id"] == 2 for r in out) == 2


def test_quality_bands_keep_clean_and_reject_noise(spark, docs):
    random.seed(2)
    noise = [(10_000 + i, "".join(random.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(900)), "en") for i in range(5)]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    report = ngram_quality.quality_report(rows).collect()
    clean = [r["kept"] for r in report if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(clean) >= 0.95 * len(clean) and not any(r["kept"] for r in report if r["doc_id"] >= 10_000)


def test_quality_bands_are_of_each_language(spark, monkeypatch):
    random.seed(3)
    letters = {"ru": "оеаинтсрвл", "el": "αοιετσνηυρ", "it": "eaionlrtsc"}
    words = {x: ["".join(random.choices(s, k=random.randint(2, 8))) for _ in range(size)] for (x, s), size in zip(letters.items(), (300, 20, 300))}
    rows = [(f"{x} {i}", x, " ".join(random.choices(words[x], k=200))) for x, n in (("ru", 60), ("el", 12), ("it", 12)) for i in range(n)]
    rows += [("rare", "xx", " ".join(random.choices(words["it"], k=200))), ("none", None, " ".join(random.choices(words["it"], k=200)))]
    docs = spark.createDataFrame([(i, x, t) for i, (_, x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    assert ngram_quality.languages(docs) == {"ru", "el", "it"}

    def report():
        return {rows[r["doc_id"]][0]: r for r in ngram_quality.quality_report(docs).collect()}

    many = report()
    bands = {x: {r["log10_upper"] for k, r in many.items() if k.startswith(x)} for x in letters}
    assert all(len(b) == 1 for b in bands.values()) and len(set.union(*bands.values())) == 3
    assert all(sum(r["kept"] for k, r in many.items() if k.startswith(x)) >= 0.9 * sum(k.startswith(x) for k in many) for x in letters)
    assert many["rare"]["log10_upper"] == many["none"]["log10_upper"] not in set.union(*bands.values())
    monkeypatch.setattr(ngram_quality, "HELD", 50)  # tasks add up and hand on all the time
    monkeypatch.setattr(ngram_quality, "HANDED", 100)
    few = report()
    assert all(few[k]["kept"] == r["kept"] and math.isclose(few[k]["log10_perplexity"], r["log10_perplexity"], rel_tol=1e-9) for k, r in many.items())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60) | st.text("ab ÉéΣ'.,!<|>\n\t①́", max_size=40))
def test_word_and_piece_ids_equal_the_libraries(text):
    import sentencepiece

    text = text.encode("utf-8", "replace").decode()
    coder = packing.encoder(WORDS)
    assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    if "\0" not in text:
        pieces, library = piece_transducer.compiled(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        ids = pieces.encode(text).tolist()
        assert ids == library.encode(text) and pieces.decode(ids) == library.decode(ids)


def message(*parts):
    """A protocol-buffer message of (field, value): whole numbers, bytes, or a 32-bit float."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in parts:
        if isinstance(value, float):
            out += varint(field << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(field << 3) + varint(value)
        else:
            out += varint(field << 3 | 2) + varint(len(value)) + value
    return out


def small_model(kind, rules, squeeze, fallback, user):
    """A model of syllables, words and letters, scored by a rule; nothing is trained."""
    import sentencepiece

    letters = "▁abdefhinorstxfi1é"
    words = [a + b for a in "▁thnr" for b in "aeio"] + ["▁the", "▁than", "the", "er", "▁er", "her", "tha", "than", "ra", "ro", "▁a", "in", "1a", "fi"]
    pieces = list(dict.fromkeys([*letters, *words]))
    rows = [message((1, b"<unk>"), (2, 0.0), (3, 2)), message((1, b"<s>"), (2, 0.0), (3, 3))]
    rows += [message((1, f"<0x{i:02X}>".encode()), (2, 0.0), (3, 6)) for i in range(256)] if fallback else []
    rows += [message((1, u.encode()), (2, 0.0), (3, 4)) for u in user]
    rows += [message((1, p.encode()), (2, -1.0 - (i * i * 31 + i * 17) % 997 / 311 if kind == 1 else float(-i if len(p) > 1 else -100 - i))) for i, p in enumerate(pieces)]
    charsmap = dict(piece_transducer.fields(dict(piece_transducer.fields(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()))[3])).get(2, b"") if rules else b""
    trainer = message((3, kind), (35, int(fallback)), (40, 0), (41, 1))
    return message(*[(1, r) for r in rows], (2, trainer), (3, message((1, b"own"), (2, charsmap), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("rules, squeeze, fallback, user", [("nmt_nfkc", True, True, ()), ("nfkc_cf", False, False, ()), ("", True, False, ("<sep>", "the1")), ("nmt_nfkc", True, True, ("<sep>",))])
def test_models_with_normalisers_and_user_pieces_equal_the_library(kind, rules, squeeze, fallback, user):
    import sentencepiece

    random.seed(kind)
    model = small_model(kind, rules, squeeze, fallback, user)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), piece_transducer.Transducer(model)
    parts = ["the", "than", " ", "  ", "er", "ﬁ", "ﬃ", "Ａ", "①", "e\u0301", "é", "\u00a0", "\t", "\n", "Z", "漢", "<sep>", "the1", "ra", "in", "▁", "x", "㌔", "\u200b", "H"]
    for _ in range(400):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        ids = own.encode(text).tolist()
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids), text


def test_piece_queries_on_documents(spark, docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in piece_transducer.encode(docs, PIECES).collect())
    assert all(r["text"] == texts[r["doc_id"]] for r in piece_transducer.decode(piece_transducer.encode(docs, PIECES), PIECES).collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_are_those_of_whole_texts_under_any_vocabulary(name, texts):
    coder = packing.WordIds(public_tokenizers.path(name), 300)
    assert coder.by_word == name.startswith("word")
    for t in [*list(texts.values())[:40], "", "A  b\n", "Ünïcode's, end."]:
        assert np.frombuffer(coder.encode(t.encode()), "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_in_many_shares(docs, monkeypatch):
    one = [tuple(r) for r in packing.pack(docs, WORDS).collect()]
    monkeypatch.setattr(packing, "LEAST_RANKED", 2)
    other = [tuple(r) for r in packing.pack(docs, WORDS).collect()]
    assert sorted(r[:5] for r in one) == sorted(r[:5] for r in other) and sorted(r[5:] for r in one) == sorted(r[5:] for r in other)


def test_packing_is_whole_and_gapless(docs, texts):
    coder = packing.encoder(WORDS)
    rows = packing.pack(docs, WORDS).collect()
    wanted = set()
    for i, t in texts.items():
        ids = [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        wanted |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r)[:5] for r in rows} == wanted
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=12))
def test_minimum_bin_slack_packs_all_and_fills_best(histogram):
    left = dict(histogram)
    for chosen, bins in packing.minimum_bin_slack(histogram, 40):
        for _ in range(bins):
            seed = max(n for n, c in left.items() if c)
            sums = {seed}
            for n, c in left.items():
                for _ in range(c - (n == seed)):
                    sums |= {s + n for s in sums if s + n <= 40}
            assert sum(n * k for n, k in chosen) == max(sums)
            for n, k in chosen:
                left[n] -= k
    assert not any(left.values())


def line_brute(docs, least):
    """Each document without the lines of any stretch of enough words that occurs, not overlapping, at an earlier place; all stretches are compared."""
    numbered = {i: [(p, x) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in docs}
    places = collections.defaultdict(list)
    for i, lines in sorted(numbered.items()):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                places[tuple(x for _, x in lines[a:b])].append((i, a))
    gone = collections.defaultdict(set)
    for stretch, found in places.items():
        if sum(len(WORD.findall(x)) for x in stretch) >= least:
            for i, a in found:
                if any((j, c) < (i, a) and (j != i or c + len(stretch) <= a) for j, c in found):
                    gone[i] |= {a + k for k in range(len(stretch))}
    out = {}
    for i, t in docs:
        units, own = [], -1
        for p, x in enumerate(t.split("\n")):
            own += p in dict(numbered[i])
            units.append((own, x))
        out[i] = "\n".join(x for k, x in units if k not in gone[i])
    return out


@pytest.mark.parametrize("least", [3, 5, 9])
def test_line_runs_equal_brute_force(spark, least):
    random.seed(least)
    rows = [(i, "\n".join(random.choice(["a b", "c", "d e f", "", "g", " \t", f"h {random.randint(0, 30)}"]) for _ in range(random.randint(0, 16)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(df, least).collect()
    assert {r["doc_id"]: r["text"] for r in got} == line_brute(rows, least)
    for r in got:
        old, new = dict(rows)[r["doc_id"]], r["text"]
        assert r["n_lines"] == old.count("\n") + 1 and (r["n_deleted"] == old.count("\n") - new.count("\n") or new == "" and r["n_deleted"] in (0, r["n_lines"], r["n_lines"] - 1))


def test_lines_of_an_original_stay(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, "\n".join([line] * 12)), (2, "\n".join(["new", *[line] * 5, "", "end"])), (3, "\n".join([line] * 4))]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("\n".join([line] * 5), 7), 2: ("new\nend", 6), 3: (rows[2][1], 0)}


def test_line_runs_of_documents_equal_brute_force(spark, docs, texts):
    rows = [(i, t) for i, t in texts.items() if t.count("\n") < 60]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == line_brute(rows, 50) and any(r["n_deleted"] for r in got)


def test_lm_base_and_gradients(docs, texts):
    rows = lm_scoring.score(docs, WORDS).collect()
    words = {i: WORD.findall(t.translate(FOLD)) for i, t in texts.items()}
    training = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in training for w in words[i])
    total, kinds = sum(counts.values()) + len(training), len(counts) + 1
    log = lambda c: math.log10((c + 1) / (total + kinds + 1))
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (r["doc_id"] not in training, len(own) + 1, total)
        assert r["n_known"] == 1 + sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(log(counts[w]) for w in own) + log(len(training)), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def codes(rng, n):
    return rng.integers(0, attention.INPUTS, n) | rng.integers(0, attention.INPUTS, n) << 16 | rng.integers(0, attention.END, n) << 32


def test_lm_does_not_depend_on_the_layout(docs):
    one, other = ({r["doc_id"]: r["score"] for r in lm_scoring.score(d, WORDS).collect()} for d in (docs.repartition(3, "lang"), docs.coalesce(1).orderBy("n_chars")))
    assert all(math.isclose(one[i], other[i], rel_tol=1e-6) for i in one)


def test_lm_classes_and_codes():
    coder = lm_scoring.Coder(WORDS, 60)  # a store that starts anew
    for k in range(4):
        words = [f"word{i % 50 + k}x".encode() for i in range(200)] + [b"the", b"the", b"a"]
        hashes, begins, ends, _, data = textkit.located_words([b" ".join(words)])
        found, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        assert coder.codes(found, begins[first], ends[first], data)[of].tolist() == coder.encoded(words).tolist() and len(coder.hashes) <= 60
    the = int(coder.encoded([b"the"])[0])
    assert the & 0xFFFF == the >> 16
    counts = np.zeros(attention.Vocabulary.IDS)
    counts[[the & 0xFFFF, 7, 9]] = 5, 3, 1
    own = attention.Vocabulary(counts, counts, counts).codes(np.array([the, 7 | 7 << 16, 7 | 9 << 16]))
    assert (own >> 32).tolist()[:2] == [0, 1] and own[2] >> 32 >= attention.SINGLE and own[2] & 0xFFFF == own[1] & 0xFFFF


def test_lm_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in attention.fresh(rng.random(attention.OUTPUTS)).items()}
    x, y, begins, _ = attention.blocked([codes(rng, n) for n in (5, 40, 0)])
    _, g = attention.gradients(p, x, y, begins)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, two = p[k][at], []
        for e in (1e-4, -1e-4):
            p[k][at] = old + e
            two.append(attention.gradients(p, x, y, begins)[0])
        p[k][at] = old
        assert math.isclose((two[0] - two[1]) / 2e-4, g[k][at], rel_tol=2e-3, abs_tol=1e-7), k


def test_lm_probabilities_sum_to_one_and_do_not_see_ahead():
    rng = np.random.default_rng(0)
    p, text = attention.fresh(rng.random(attention.OUTPUTS)), codes(rng, 50)
    x, y, begins, _ = attention.blocked([text])
    whole = attention.log_probabilities(p, x, y, begins).ravel()[:51]
    cut = attention.log_probabilities(p, *attention.blocked([text[:20]])[:3]).ravel()[:20]
    assert np.allclose(whole[:20], cut, atol=1e-4)
    total = sum(np.exp(attention.log_probabilities(p, x, np.full_like(y, i), begins)) for i in range(attention.OUTPUTS))
    assert np.allclose(total.ravel()[:51], 1, atol=1e-3)


def test_lm_trains_on_every_word_and_end_once():
    rng = np.random.default_rng(0)
    texts = [codes(rng, n) for n in (0, 5, 31, 32, 70, 3 * lm_scoring.BATCH * attention.STRIDE + 40, 16)]
    p, (x, y, begins, _) = attention.fresh(rng.random(attention.OUTPUTS)), attention.blocked(texts)
    big = {k: v * 400 for k, v in p.items()}  # beyond the range of exp()
    assert np.isfinite(attention.log_probabilities(big, x, y, begins)).all()
    steps = list(lm_scoring.steps_of(texts))
    targets = np.concatenate([t.ravel() for _, t, _, _ in steps])
    wanted = np.concatenate([np.append(t >> 32, attention.END) for t in texts])
    assert targets[targets >= 0].tolist() == wanted.tolist()
    assert sum(n for *_, n in steps) == len(x) and max(n for *_, n in steps) <= lm_scoring.BATCH
    whole = attention.log_probabilities(p, x, y, begins)
    parts = np.concatenate([attention.log_probabilities(p, *step[:3])[-step[3] :] for step in steps])
    assert np.allclose(whole, parts, atol=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t\né\x1c\xa0", max_size=20), max_size=6))
def test_hashed_words_follow_the_word_rule(texts):
    words, bounds = textkit.hashed_words([t.encode() for t in texts])
    found = [WORD.findall(t) for t in texts]
    assert np.diff(bounds).tolist() == list(map(len, found))
    names = dict(zip(words.tolist(), (w for f in found for w in f)))
    assert len(names) == len({w for f in found for w in f}) and [names[h] for h in words.tolist()] == [w for f in found for w in f]


def test_pipeline_stages_hand_on_documents(spark):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in out} <= ids
    kept = ngram_quality.quality_filter(docs)
    assert kept.columns == columns
    report = {r["doc_id"] for r in ngram_quality.quality_report(docs).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"].translate(FOLD) for r in docs.collect() if r["doc_id"] in report}
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t, i in last.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert {r["doc_id"] for r in out} == {i for i in label if label[i] == i}
