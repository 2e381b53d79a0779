import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from palaver.llm import private


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def base(text):
    text, found = text or "", []
    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(part) <= 255 for part in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


TEXTS = [
    "", None, "mail a.b+c@x-y.co.uk, a@b.c%d@e.f and a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.00.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "+1 (437) 555-0689. +12345 +1 2 3 4 5 6 7 8.",
    "日本🙂 x@y.zz é +44 20 7946 0958\n+44\n20 7946 0958", "a@b" * 300, "9" * 20000, "a" * 20000 + "@", "1." * 5000,
    "a@" + "b." * 3000 + "c", "x@y.z " * 700, "+1" + "(" * 5000 + "2",
]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    found = private.find_private(docs)
    rows = found.select("doc_id", private.shown(private.of_kinds(F.col("spans"), *private.KINDS)).alias("base")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.base == ",".join("%s:%d:%d" % span for span in base(texts[row.doc_id])), texts[row.doc_id]


def test_base_spans_against_brute_force(spark):
    chance = random.Random(4)
    made = ["".join(chance.choice("1234 .-+()@ab\n4111") for _ in range(chance.randrange(80))) for _ in range(600)]
    numbers = [" ".join(str(chance.randrange(10**15, 10**19)) for _ in range(5)) for _ in range(60)]
    check(spark, TEXTS + made + numbers)


def test_disclosing_terms_and_rewriting(spark):
    texts = [f"word{'abcdefghij'[i % 10]} said Zanzibar wrote from kim@corp.example {'lorem ipsum dolor'.split()[i % 3]} {'the old town ' * 9}"
             for i in range(12)]
    texts += ["nothing to see here " * 30, "mail ann@other.example " + "the old town " * 9] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = private.find_private(docs, threshold=0.5)
    rows = {row.doc_id: row for row in found.withColumn("clean", private.sanitise(F.col("text"), F.col("spans"))).collect()}
    for number in range(12):
        values = {span.value for span in rows[number].spans}
        assert {"kim@corp.example", "zanzibar", "wrote"} <= values and "the" not in values
        assert "Zanzibar" not in rows[number].clean and "kim@" not in rows[number].clean
        assert "[EMAIL]" in rows[number].clean and "town" in rows[number].clean
    assert [span.kind for span in rows[13].spans] == ["email"]
    assert rows[12].clean == texts[12] and rows[12].spans == []


def test_a_rare_term_is_not_drowned_by_others(spark):
    """Two million words of their own would fill any small number of buckets."""
    def name(number):
        return F.translate(F.concat(F.lit("x"), number.cast("string")), "0123456789", "abcdefghij")

    words = F.transform(F.sequence(F.lit(0), F.lit(1_999)), lambda k: name(F.lit(10_000_000) + F.col("id") * 2_000 + k))
    others = spark.range(1_000).select(F.array_join(words, " ").alias("text"))
    mails = spark.range(30_000).select(F.concat(F.lit("mail "), name(F.col("id") + 90_000_000), F.lit(" u"), "id",
                                                F.lit("@other.example")).alias("text"))
    rare = spark.range(3).select(F.concat(name(F.col("id") + 80_000_000), F.lit(" Zanzibar kim@corp.example ")).alias("text"))
    docs = others.union(mails).union(rare)
    near = private.surroundings(private.mentioning(docs, "text"))
    shares = {(row.entity, row.term): row.share for row in private.disclosures(near, docs, "text", 3, 0.0).collect()}
    total, chance = 2_060_006, 3 * (2 * private.AROUND / 6)
    assert math.log2(total / chance) > math.log2((30_003 + 1) / 3)
    assert shares["email:kim@corp.example", "zanzibar"] == 1.0


def test_terms_meet_texts_from_either_side(spark):
    docs = spark.createDataFrame([(1, "Alpha beta a@b.example alpha"), (2, "Alpha " + "gamma " * 40 + "a@b.example")],
                                 "doc_id long, text string")
    known = spark.createDataFrame([("email:a@b.example", term, 0.8) for term in ["alpha", *(f"t{n}" for n in range(20))]],
                                  "entity string, term string, share double")
    found = private.disclosed(private.mentioning(docs, "text"), known).filter("term IN ('alpha', 'beta', 'gamma')").collect()
    assert len({row.key for row in found}) == 2 and [row.term for row in found] == ["alpha"] * 2


def test_a_disclosing_term_is_marked_in_the_whole_text(spark):
    far = "the old town " * 20
    texts = [f"word{'abcdefghij'[i % 10]} said Zanzibar and kim@corp.example {'lorem ipsum dolor'.split()[i % 3]} {far}"
             for i in range(12)]
    texts[0] = f"Zanzibar {far} kim@corp.example {far} ZANZIBAR kim@zanzibar.example Zanzibar"
    texts += ["mail ann@other.example " + "the old town " * 9] * 20 + [f"Zanzibar alone {far}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {row.doc_id: row for row in private.find_private(docs, threshold=0.5).collect()}
    found = [(span.start, span.end) for span in rows[0].spans if span.value == "zanzibar"]
    outside = [m.span() for m in re.finditer("zanzibar", texts[0].lower()) if texts[0][m.end():m.end() + 1] != "."]
    assert len(outside) == 3 and found == outside
    for number in range(1, 12):
        assert [span.start for span in rows[number].spans if span.value == "zanzibar"] == [texts[number].index("Zanz")]
    assert rows[len(texts) - 1].spans == []


def test_digest_of_nothing_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    row = private.find_private(docs).select(F.sha2(private.shown(F.col("spans")), 256).alias("sha")).first()
    assert row.sha == hashlib.sha256(b"").hexdigest()
    assert private.find_private(docs.limit(0)).collect() == []


def test_overlapping_spans_are_cut_once(spark):
    spans = [("card", 3, 10, ""), ("phone", 0, 12, ""), ("email", 14, 15, "")]
    frame = spark.createDataFrame([("0123456789abcdefgh", spans)], f"text string, spans {private.SPAN}")
    assert frame.select(private.sanitise(F.col("text"), F.col("spans")).alias("t")).first().t == "[PHONE]cd[EMAIL]fgh"


def test_many_mentions_in_one_text_cost_as_much_each_as_few(spark):
    """Each mention has its own surroundings; terms inside other mentions are left out."""
    count = 20_000
    parts = [f"w{'abcdefghij'[n % 10] * 3} 10.{n // 65_536}.{n // 256 % 256}.{n % 256}" for n in range(count)]
    text = " ".join(parts) + " name kim@corp.example end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.perf_counter()
    near = private.surroundings(private.mentioning(docs, "text")).groupBy("term").count()
    rows = {row["term"]: row["count"] for row in near.collect()}
    assert time.perf_counter() - started < 120
    assert {"name", "end"} <= set(rows) and not {"kim", "corp", "example"} & set(rows)
    assert sum(rows.values()) > 4 * count
    found = private.find_private(docs).select(F.size("spans").alias("n")).first()["n"]
    assert found == count + 1 and time.perf_counter() - started < 240
