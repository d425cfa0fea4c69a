"""Personal data and what reveals it: patterns find protected entities, corpus co-occurrence finds the terms that give them away.

A term t discloses an entity c by their pointwise mutual information, log2(p(c, t) / (p(c) p(t))), measured against the
entity's information -log2 p(c): at 1 the term never stands without the entity. All probabilities are counts of different
texts, each word once per text and outside entities, so copies and repeats are no evidence. They are smoothed by leaving out
one text each: a pair seen in one text only says nothing. Neither does a pair seen in near copies of one text only, which share
nearly all their words: the texts that hold entities are put into classes by sketches of their word runs, and a pair counts where
texts of two classes hold it. Terms from `GENERALISE` of the entity's information on are replaced
by their class, from `REMOVE` on they are removed, at every place of every text.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .components import components

# The kinds in their listed order. Possessive quantifiers and the look-behinds change no match; they keep the
# matcher from recursion and from trying every place of a long run.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RUN = r"[0-9 -]{12,}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Words, and the characters of the shortest term.
WORD, SHORTEST = r"[\p{L}\p{N}]++", 3
#: Near copies are told by runs of RUN words: of those of a text, the SKETCH smallest hashes.
RUN, SKETCH = 3, 64
#: Shares of the entity's information.
GENERALISE, REMOVE = 0.7, 0.95

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def located(text: Column, pattern: str | Column) -> Column:
    """Matches of a pattern as structs (start, end, value), in code points."""
    values = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, zero, step)["found"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    digit = lambda i: F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    each = F.transform(F.sequence(F.lit(1), F.length(number)), digit)
    return F.aggregate(each, F.lit(0), lambda s, d: s + d % 10 + F.floor(d / 10).cast("int")) % 10 == 0


def card_runs(text: Column) -> Column:
    """Digits joined by single blanks or hyphens, from every run that is long enough to hold a card."""
    # What can't be inside a number becomes one 'x' each, so places stay.
    inner = lambda v: located(F.regexp_replace(v, r"(?<![0-9])[ -]|[ -](?![0-9])", "x"), "[0-9 -]++")
    each = F.transform(
        located(text, CARD_RUN),
        lambda run: F.transform(inner(run["value"]), lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["value"].alias("value"))),
    )
    return F.flatten(each)


def base_spans(text: Column) -> Column:
    """All personal data of a text (null: none) as sorted structs (start, kind, end, value); kind is a place in KINDS."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    a_digit = t.rlike("[0-9]")
    emails = F.when(F.contains(t, F.lit("@")), located(t, EMAIL)).otherwise(none)
    octets = lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    ips = F.when(a_digit, F.filter(located(t, IP), lambda m: octets(m["value"]))).otherwise(none)
    cards = F.when(a_digit, F.filter(card_runs(t), lambda m: F.length(digits(m["value"])).between(12, 19) & luhn(digits(m["value"])))).otherwise(none)
    phones = F.when(F.contains(t, F.lit("+")), F.filter(located(t, PHONE), lambda m: F.length(digits(m["value"])).between(9, 15))).otherwise(none)

    def tag(found: Column, k: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    tagged = [tag(found, k) for k, found in enumerate((emails, ips, cards, phones))]
    return F.array_sort(F.concat(*tagged)).cast(_SPAN)


def named(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*KINDS, "term", "term"))), kind + 1)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", named(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in place of each span: places stay, and the words left are those outside the spans."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["at"])
        piece = F.concat(F.substring(text, state["at"] + 1, start - state["at"]), F.repeat(F.lit(" "), s["end"] - start))
        done = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(piece)).alias("parts"))
        return F.when(s["end"] <= state["at"], state).otherwise(done)

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(spans, zero, step, finish))


def words(text: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def terms(text: Column) -> Column:
    """The different lower-cased words of a text that are long enough to be terms."""
    return F.filter(F.array_distinct(F.transform(words(text), F.lower)), lambda w: F.length(w) >= SHORTEST)


def sketch(text: Column) -> Column:
    """The SKETCH smallest hashes of a text's runs of RUN words (shorter ones at its end); empty without words."""
    h = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    runs = h
    for k in range(1, RUN):
        runs = F.zip_with(runs, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH)


def near_copies(holders: DataFrame) -> DataFrame:
    """(text_hash, kin): a class of near copies for every row of `holders` (text_hash, sketch).

    The smallest text that has a run leads it. A text is tied to the one that leads more than half of its sketch, and tied texts
    are one class.
    """
    runs = holders.select("text_hash", F.explode("sketch").alias("run"))
    leaders = runs.groupBy("run").agg(F.min("text_hash").alias("leader"))
    led = runs.join(leaders, "run").groupBy("text_hash", "leader").agg(F.count(F.lit(1)).alias("n"))
    most = led.groupBy("text_hash").agg(F.max(F.struct("n", "leader")).alias("most"), F.sum("n").alias("all"))
    ties = most.where("2 * most.n > all and most.leader <> text_hash").select(F.col("text_hash").alias("a"), F.col("most.leader").alias("b"))
    labels = components(materialise(ties, "pii-ties")).select(F.col("v").alias("text_hash"), "label")
    return holders.select("text_hash").join(labels, "text_hash", "left").select("text_hash", F.coalesce("label", "text_hash").alias("kin"))


def disclosures(texts: DataFrame) -> DataFrame:
    """(entity, term, share): terms that carry at least GENERALISE of an entity's information.

    `texts`: (text_hash, rest, entities, sketch), one row per different text: the text without its entities, these, and the
    sketch of it.
    """
    n = float(max(2, texts.count() - 1))
    # One count of all words of the corpus, by their hashes: partial sums shrink it before the shuffle.
    codes = F.transform(terms(F.col("rest")), lambda w: F.xxhash64(w))
    seen = texts.select(F.explode(codes).alias("code")).groupBy("code").agg((F.count(F.lit(1)) - 1).alias("t")).where("t > 0")
    holders = texts.where(F.size("entities") > 0)
    kin = materialise(near_copies(holders), "pii-kin")
    mentions = holders.select("text_hash", F.explode("entities").alias("entity")).join(kin, "text_hash")
    two = (F.min("kin") < F.max("kin")).alias("two")
    others = mentions.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("e"), two).where("e > 0 and two").drop("two")
    near = holders.select("text_hash", F.explode(terms(F.col("rest"))).alias("term")).withColumn("code", F.xxhash64("term"))
    # No text but the one at hand, no evidence. As a pair has no more texts than its entity, a term in more than
    # n^(1 - GENERALISE) e^GENERALISE other texts can't reach the share; this leaves out no pair that could.
    could = F.col("t") <= F.lit(n ** (1 - GENERALISE) * 1.000001) * F.pow(F.col("e").cast("double"), F.lit(GENERALISE))
    pair = mentions.join(others, "entity").join(near.join(seen, "code"), "text_hash").where(could)
    pair = pair.groupBy("entity", "term", "e", "t").agg((F.count(F.lit(1)) - 1).alias("both"), two).where("both > 0 and two")
    mutual = F.log2(F.col("both") * F.lit(n) / (F.col("e") * F.col("t").cast("double")))
    share = F.least(mutual / F.greatest(F.log2(F.lit(n) / F.col("e")), F.lit(1e-9)), F.lit(1.0))
    return pair.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, base, spans): every row of `docs` as a struct, and what stands in its text; no column of `docs` can clash."""
    text, key = F.col("row.text"), ["of_id", "text_hash"]
    found = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = found.select("row", F.col("row.doc_id").alias("of_id"), F.xxhash64("row.text").alias("text_hash"), base_spans(text).alias("base"))
    rest = blanked(text, F.col("base"))
    once = found.where(text.isNotNull()).select("text_hash", rest.alias("rest"), F.array_distinct(F.col("base.value")).alias("entities"))
    once = once.groupBy("text_hash").agg(F.first("rest").alias("rest"), F.first("entities").alias("entities"))
    once = once.withColumn("sketch", F.when(F.size("entities") > 0, sketch(F.col("rest"))))
    told = disclosures(materialise(once, "pii-texts")).groupBy("term").agg(F.max("share").alias("share"))
    told = materialise(told.select(F.xxhash64("term").alias("code"), (F.col("share") >= REMOVE).alias("out")), "pii-terms")
    # Words as they are spelt in a row, so that a pattern of them finds all their places and nothing else.
    spelt = found.select(*key, F.explode(words(rest)).alias("word")).withColumn("code", F.xxhash64(F.lower("word")))
    extra = spelt.join(told, "code").groupBy(*key).agg(*(F.collect_set(F.when(F.col("out") == out, F.col("word"))).alias(c) for c, out in (("general", False), ("gone", True))))
    same = found["of_id"].eqNullSafe(extra["of_id"]) & (found["text_hash"] == extra["text_hash"])
    whole = found.join(extra, same, "left").select(found["row"], found["base"], extra["general"], extra["gone"])
    more = F.concat(placed(rest, F.col("general"), 4), placed(rest, F.col("gone"), 5))
    return whole.select("row", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with `base` and `spans` (sorted structs start, kind, end, value) and `clean`, the sanitised text.

    Kinds 0 to 3 are KINDS; 4 is a term to generalise, 5 a term to remove, wherever it stands, beside an entity or not. A null
    text stays null in `clean` and has no spans; a text without entities and such terms is unchanged. Rows are told apart by
    doc_id and text, so ids may be null or repeated; equal rows get equal results. An empty table gives no rows. Other columns
    stay, but for clashing names of the three new ones.
    """
    others = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("base", "spans", "clean")]
    return _scanned(docs).select(*others, "base", "spans", rewritten(F.col("row.text"), F.col("spans")).alias("clean"))


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with the sanitised text in place of the text; all other columns unchanged, whatever their names. See `sanitise`."""
    clean = rewritten(F.col("row.text"), F.col("spans"))
    return _scanned(docs).select(*((clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def placed(text: Column, listed: Column, kind: int) -> Column:
    """Every place of the listed words in a text, as spans of this kind."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(listed, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.lower(m["value"]).alias("value"))
    return F.when(F.size(listed) > 0, F.transform(located(text, pattern), span)).otherwise(F.array()).cast(_SPAN)


def rewritten(text: Column, spans: Column) -> Column:
    """The text with spans replaced; of overlapping spans the first one counts."""
    what = lambda s: F.element_at(F.array(F.lit("[EMAIL]"), F.lit("[IP]"), F.lit("[CARD]"), F.lit("[PHONE]"), F.when(s["value"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]")), F.lit("")), s["kind"] + 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), what(s))
        done = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(piece)).alias("parts"))
        return F.when(s["start"] < state["at"], state).otherwise(done)

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(spans, zero, step, finish))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones and terms) of every row of `docs`; see `sanitise`."""
    rows = sanitise(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
