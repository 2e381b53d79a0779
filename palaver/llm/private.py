"""Personal data, by patterns and by what terms reveal about it, in Spark expressions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by patterns over the whole text. They are
the protected entities. The corpus then says which other terms give an entity away: over the surroundings of all its
mentions, a term's pointwise mutual information with the entity is set against the entity's own information content.
A term with a share of at least ``threshold``, seen in at least ``support`` different surroundings, discloses the
entity. In a text that mentions it, such a term is generalised wherever it stands, or removed where it reveals nearly
all (``removal``).

Surroundings that repeat, as in copies of a document, count once. How common a term is comes from exact counts over all
texts, so a share means the same at every size.

Patterns use possessive quantifiers, and may start only where a run of their characters starts or where the last match
ended; the matches are the same, and long runs cost linear time.

Defined cases: a null or empty text has no spans; repeated rows get equal results; an empty table gives none.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, fresh, keep, let, salted_left_join

KINDS = ("email", "ip", "card", "phone")
TERM, REMOVED_TERM = "term", "revealing"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
TERMS = r"\p{L}{3,}+"

AROUND = 80
SUPPORT = 3
THRESHOLD = 0.7
REMOVAL = 0.95
SALTS = 16
STEP = 256
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def running_sums(sizes: Column) -> Column:
    """Running sums of an array, in blocks, so that long arrays are not copied for each element."""
    def within(block, start):
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(block, empty, lambda done, size: F.struct(
            (done["at"] + size).alias("at"), F.concat(done["all"], F.array(done["at"] + size)).alias("all")),
            lambda done: done["all"])

    def blocks(all_sizes):
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_sizes), F.lit(1)), F.lit(STEP))
        return F.transform(starts, lambda start: F.slice(all_sizes, start, STEP))

    def placed(parts):
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda sum, size: sum + size))
        return F.flatten(F.zip_with(parts, F.concat(F.array(F.lit(0)), within(totals, F.lit(0))),
                                    lambda part, start: within(F.coalesce(part, F.array().cast("array<int>")), start)))

    return let(let(sizes, blocks), placed)


def located(text: Column, pattern: str, kind: str, offset: Column) -> Column:
    """All matches as spans, leftmost and without overlap."""
    def spans(both):
        found, gaps = both["found"], both["gaps"]
        sizes = F.transform(found, lambda value: F.length(value))
        ends = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), lambda gap: F.length(gap)), sizes, lambda a, b: a + b)
        return F.zip_with(running_sums(ends), found, lambda end, value: F.struct(
            F.lit(kind).alias("kind"), (offset + end - F.length(value)).alias("start"), (offset + end).alias("end"),
            value.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.filter(let(both, spans), lambda span: span["value"].isNotNull())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    def doubled(digit):
        return F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)

    def total(turned):
        places = F.sequence(F.lit(1), F.length(turned))
        return F.aggregate(places, F.lit(0), lambda sum, at: sum + let(
            F.substring(turned, at, F.lit(1)).cast("int"), lambda digit: F.when(at % 2 == 0, doubled(digit)).otherwise(digit)))

    return let(F.reverse(digits), total) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and then by start. Cheap tests keep most texts from the searches."""
    nothing = F.array().cast(SPAN)
    zero = F.lit(0)

    def where(test, pattern, kind, valid=None):
        found = located(text, pattern, kind, zero)
        return F.when(test, F.filter(found, lambda span: valid(span["value"])) if valid else found).otherwise(nothing)

    def is_card(value):
        return let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))

    def is_phone(value):
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)

    return F.when(text.isNull() | (text == ""), nothing).otherwise(F.concat(
        where(F.contains(text, F.lit("@")), EMAIL, "email"),
        where(text.rlike(r"[0-9]\.[0-9]"), IP, "ip", lambda value: value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        where(text.rlike("[0-9](?:[ -]?+[0-9]){15}"), CARD, "card", is_card),
        where(F.contains(text, F.lit("+")), PHONE, "phone", is_phone)))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.md5(F.coalesce(text, F.lit("")))


def mentioning(docs: DataFrame, text: str) -> DataFrame:
    """(key, text, spans) of every different text that mentions an entity."""
    found = docs.select(F.col(text).alias("text"), base_spans(F.col(text)).alias("spans")).filter(F.size("spans") > 0)
    return found.select(text_key(F.col("text")).alias("key"), "text", "spans").dropDuplicates(["key"])


def entity_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["value"])


def surroundings(held: DataFrame) -> DataFrame:
    """A row for each term near a mention in the texts of ``mentioning``: (key, entity, term, start, end, context).

    A text is cut into pieces of ``STEP`` characters once, and what surrounds a mention is put together from two of them,
    so a text of many mentions costs as much a mention as one of few, and no row carries the text or its other spans.
    """
    def cut(both, first, size):
        place = F.floor(first / STEP).cast("int")
        two = F.concat(F.coalesce(F.get(both["pieces"], place), F.lit("")), F.coalesce(F.get(both["pieces"], place + 1), F.lit("")))
        return F.substring(two, first - place * STEP + 1, size)

    def around(both):
        def one(span):
            return let(F.greatest(span["start"] - AROUND, F.lit(0)), lambda first: F.struct(
                entity_of(span).alias("entity"), first.alias("first"), span["start"].alias("start"), span["end"].alias("end"),
                cut(both, first, span["start"] - first).alias("before"),
                cut(both, span["end"], F.lit(AROUND)).alias("after")))

        return F.transform(both["spans"], one)

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))
    mentions = held.select("key", F.explode(let(F.struct("spans", pieces.alias("pieces")), around)).alias("m")).select("key", "m.*")
    terms = F.concat(located(F.col("before"), TERMS, TERM, F.col("first")),
                     located(F.col("after"), TERMS, TERM, F.col("end")))

    def whole(term):  # not cut by the edge of the surroundings
        return ~(((term["start"] == F.col("first")) & (F.col("first") > 0)) | (term["end"] == F.col("end") + AROUND))

    found = mentions.select("key", "entity", F.xxhash64("before", "after").alias("context"),
                            F.explode(F.filter(terms, whole)).alias("term"))
    found = found.select("key", "entity", F.lower("term.value").alias("term"), "term.start", "term.end", "context")
    return outside_of_mentions(found, held)


def outside_of_mentions(found: DataFrame, held: DataFrame) -> DataFrame:
    """The rows (key, start, end, ...) that overlap no mention of their text. Both meet by text and stretch of ``STEP``
    characters, however many a text has."""
    def stretches(start, end):
        return F.explode(F.sequence(F.floor(start / STEP), F.floor((end - 1) / STEP))).alias("stretch")

    spans = held.select("key", F.explode("spans").alias("span")).select(
        "key", F.col("span.start").alias("from"), F.col("span.end").alias("until"), stretches(F.col("span.start"), F.col("span.end")))
    places = found.select("key", "start", "end").distinct()
    placed = places.select("key", "start", "end", stretches(F.col("start"), F.col("end")))
    inside = placed.join(spans, ["key", "stretch"]).filter((F.col("start") < F.col("until")) & (F.col("from") < F.col("end")))
    return found.join(inside.select("key", "start", "end").distinct(), ["key", "start", "end"], "left_anti").select(*found.columns)


def disclosures(near: DataFrame, docs: DataFrame, text: str, support: int, threshold: float) -> DataFrame:
    """(entity, term, share): terms that disclose an entity, with the share of its information they give."""
    contexts = near.select("entity", "context").distinct()
    per_entity = contexts.groupBy("entity").agg(F.count("*").alias("n_entity"))
    per_pair = keep(
        near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_pair"))
        .filter(F.col("n_pair") >= support), "term-pairs")
    found = F.regexp_extract_all(F.col(text), F.lit(TERMS), F.lit(0))
    words = docs.select(F.explode(found).alias("word")).select(F.lower("word").alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n_term")).join(per_pair.select("term").distinct(), "term")
    total_words = docs.agg(F.sum(F.size(found).cast("long")).alias("n")).first()["n"] or 0
    total_contexts = contexts.agg(F.count("*").alias("n")).first()["n"]
    # About as many terms as fit around a mention: how likely one of them is the term, if it comes by chance.
    # A piece cut off by a mention may be no word of any text; then it is as common as it was seen to be.
    chance = F.least(F.lit(1.0), F.coalesce("n_term", "n_pair") * (2 * AROUND / 6) / max(1, total_words))
    gained = F.log2(F.col("n_pair") / F.col("n_entity") / chance)
    content = F.log2(F.lit(max(2, total_contexts + 1)) / F.col("n_entity"))
    return (
        salted_left_join(per_pair.join(per_entity, "entity"), counts, ["term"], F.col("entity"), SALTS)
        .select("entity", "term", F.least(F.lit(1.0), gained / content).alias("share"))
        .filter(F.col("share") >= threshold)
    )


def disclosed(held: DataFrame, known: DataFrame) -> DataFrame:
    """(key, term, share): the terms that disclose an entity of the text, wherever in the text they stand."""
    entities = held.select("key", F.size(F.regexp_extract_all("text", F.lit(TERMS), F.lit(0))).alias("n_words"),
                           F.explode(F.array_distinct(F.transform("spans", entity_of))).alias("entity"))
    per_entity = known.groupBy("entity").agg(F.count("*").alias("n_known"))
    pairs = salted_left_join(entities, per_entity, ["entity"], F.col("key"), SALTS).filter(F.col("n_known").isNotNull())
    # Either the entity's terms or the text's words are spread out, whichever are fewer: an entity of very many terms,
    # or a text of very many entities, multiplies nothing.
    few = salted_left_join(pairs.filter("n_known <= n_words"), known, ["entity"], F.col("key"), SALTS)
    many = pairs.filter("n_known > n_words").join(held.select("key", "text"), "key").select(
        "key", "entity", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERMS), F.lit(0)))).alias("word"))
    many = many.select("key", "entity", F.lower("word").alias("term"))
    many = salted_left_join(many, known, ["entity", "term"], F.col("key"), SALTS).filter(F.col("share").isNotNull())
    return few.select("key", "term", "share").union(many.select("key", "term", "share")).groupBy("key", "term").agg(
        F.max("share").alias("share"))


def find_private(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD,
                 removal: float = REMOVAL) -> DataFrame:
    """All rows and columns with ``spans`` appended: base spans by kind and start, then disclosing terms by start."""
    held = keep(mentioning(docs, text), "mentioning")
    near = keep(surroundings(held), "surroundings")
    known = keep(disclosures(near, docs, text, support, threshold), "disclosures")
    terms = keep(disclosed(held, known), "disclosed")
    # All words of the texts concerned; those near a mention also as the mention cuts them.
    concerned = held.join(terms.select("key").distinct(), "key", "left_semi")
    everywhere = concerned.select("key", F.explode(located(F.col("text"), TERMS, TERM, F.lit(0))).alias("word")).select(
        "key", F.lower("word.value").alias("term"), "word.start", "word.end")
    places = everywhere.union(near.select("key", "term", "start", "end")).join(terms, ["key", "term"])
    strongest = places.groupBy("key", "term", "start", "end").agg(F.max("share").alias("share"))
    # Words of the mentions themselves are no terms.
    strongest = outside_of_mentions(keep(strongest, "places"), held)
    span = F.struct(F.when(F.col("share") >= removal, F.lit(REMOVED_TERM)).otherwise(F.lit(TERM)).alias("kind"),
                    F.col("start"), F.col("end"), F.col("term").alias("value"))
    own = fresh(docs.columns, "_key")
    more = fresh([*docs.columns, own], "_more")
    marked = strongest.groupBy(F.col("key").alias(own)).agg(
        F.array_sort(F.collect_list(span), lambda a, b: a["start"] - b["start"]).alias(more))
    spread = F.monotonically_increasing_id()
    joined = salted_left_join(docs.withColumn(own, text_key(F.col(text))), marked, [own], spread, SALTS)

    whole = F.concat(base_spans(F.col(text)), F.coalesce(F.col(more), F.array().cast(SPAN)))
    return add_struct(joined, F.struct(whole.alias("spans")), ["spans"]).drop(own, more)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    def name(kind):
        return F.when(kind == REMOVED_TERM, F.lit(TERM)).otherwise(kind)

    return F.array_join(F.transform(spans, lambda span: F.concat_ws(
        ":", name(span["kind"]), span["start"].cast("string"), span["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda span: span["kind"].isin(*kinds))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, or by nothing where a term reveals nearly all. A span
    that overlaps an earlier one only cuts off the rest of it."""
    def rebuild(ordered):
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

        def step(done, span):
            gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
            label = F.when((span["kind"] == REMOVED_TERM) | (span["start"] < done["at"]), F.lit("")).otherwise(
                F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
            return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["done"], gap, label).alias("done"))

        return F.aggregate(ordered, start, step, lambda done: F.concat(
            done["done"], F.substring(text, done["at"] + 1, F.length(text))))

    ordered = F.array_sort(F.transform(spans, lambda span: F.struct(
        span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(ordered, rebuild)).otherwise(text)
