import random
import re

from palaver.llm import decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    tokens, hit, found = words(text), set(), set()
    for item, value in items:
        own = words(value)
        size = min(len(own), window)
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(tokens) - size + 1 if size else 0):
            if tuple(tokens[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found |= {item} - {None}
    return len(tokens), len(hit), sorted(found)


def made():
    chance = random.Random(6)
    letters = [f"w{n}" for n in range(12)] + ["É", "x-y", "B2"]
    items = [(n, " ".join(chance.choice(letters) for _ in range(chance.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for n in range(25)]
    items += [(None, "n1 n2 n3 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, "n9"), (3, "another text of item three w1 w2 w3 w4 w5 w6"), (50, None), (51, " .,"), (52, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    texts = ["N1, n2 n3 w1 w2 w3 w4 w5 w6 w7 w8; n9 n9", None, "", "...", "W1,W1;w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"]
    for _ in range(60):
        parts = [" ".join(chance.choice(letters) for _ in range(chance.randrange(30)))]
        own = words(chance.choice(items)[1])
        at = chance.randrange(len(own) + 1)
        parts += [" ".join(own[at:at + chance.randrange(25)]).upper(), "end"]
        texts.append(" -- ".join(parts))
    return texts, items


def test_against_brute_force_in_one_block_and_many(spark):
    texts, items = made()
    docs = spark.createDataFrame([(n, t, 7, "x") for n, t in enumerate(texts)], "doc_id long, text string, n_words int, items string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10_000, 40):
        found = decontaminate.find_contamination(docs, table, block_words=block_words).collect()
        assert len(found) == len(texts)
        for row in found:
            assert (row.n_words, row.n_hit, row.items) == brute(texts[row.doc_id], items), texts[row.doc_id]
            assert row.n_hit == sum(span.end - span.first for span in row.spans)


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    clean = "nothing of that kind stands here. " * 5
    docs = spark.createDataFrame([(1, f"{clean}{passage.upper()}, and {clean}"), (2, passage + " x"), (3, clean), (4, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = {row.doc_id: row.text for row in
            decontaminate.remove_contamination(decontaminate.find_contamination(docs, items)).collect()}
    assert set(kept) == {1, 3, 4} and kept[3] == clean and kept[4] is None
    assert "SEVEN" not in kept[1] and kept[1].startswith(clean.rstrip()) and kept[1].endswith(f", and {clean}")


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.find_contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.spans, row.items) == (2, 0, [], [])
    assert decontaminate.find_contamination(docs.limit(0), none).collect() == []


def cut_by_python(text, spans):
    value, parts, done = text.encode(), [], 0
    places = [match.span() for match in decontaminate.WORD.finditer(value)]
    for span in spans:
        parts.append(value[done:places[span.first][0]].rstrip(b" "))
        done = places[span.end - 1][1]
    return b" ".join([*parts, value[done:]]).decode() if spans else text


def test_removal_is_that_of_python_and_streams_each_text_once(spark):
    texts, items = made()
    texts += ["\xc9t\xe9  n9 \xe9t\xe9  \xa0n9, \U0001f389 w1 n9\tend  ", "a n9 b n9  c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_words, blocks in ((10_000, 1), (200, None)):
        found = decontaminate.find_contamination(docs, table, block_words=block_words)
        cleaned = decontaminate.remove_contamination(found, max_coverage=1.0)
        want = {row.doc_id: None if row.text is None else cut_by_python(row.text, row.spans) for row in found.collect()}
        assert {row.doc_id: row.text for row in cleaned.collect()} == want
        if blocks:
            plan = cleaned.select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
            # A node of its own for the filter, the spans and the cutting would be a Python worker a task each.
            assert plan.count("ArrowEvalPython") == blocks
