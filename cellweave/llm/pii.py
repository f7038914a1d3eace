"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

All of it is DataFrame expressions. Base spans (email, ip, card, phone) come from four patterns and their
checks. Each distinct value found is a protected entity. A term (a word of four letters or more), wherever it
stands in a text that holds an entity, reveals it as far as the corpus says so:

    PMI(t; e) / IC(e) = log2(p(e | t) / p(e)) / log2(1 / p(e))

A term at or over `generalise_at` is generalised in all texts of that entity, at or over `remove_at` removed.
Counts are of distinct texts, over the whole corpus. Of the texts that show an entity in the same surroundings (up to
`REACH` characters on each side, no further than the next match of the kind) only one is a witness, the least by key; of
those, for each of `WITNESS` hashes in turn, only the least of the texts whose rare terms (of sqrt(n) texts at most) agree
in their least hash. Copies of a passage so prove nothing, and near copies of a text hardly ever do: two texts that
share a part j of their rare terms are two witnesses with a chance of (1 - j) ** WITNESS. Small counts weigh less: n_e
texts witness the entity, k of them hold the term, and of n_t texts with the term those with the entity that are no
witnesses do not count; then

    p(e) = n_e / n        p(e | t) = (k - 1 + p(e)) / (n_t - others)

since the text that brings a pair up says nothing for it. One text alone gives at most p(e), two that no other text
speaks against about a half. Texts without an entity are never touched.

A term can be at `generalise_at` g only if n_t - others <= n_e / p(e) ** (1 - g); words of all other frequencies are
left out before any pair is made.

Offsets are code points, ends exclusive. Kinds in `spans`: email, ip, card, phone, term.

Nulls: a null text is empty and has no spans; a null doc_id is passed through. Repeated rows each get a
row (their text counts once). Empty input gives an empty result. Further columns are not read. Work on one text is
in proportion to its length and its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import checkpoint

KINDS = ["email", "ip", "card", "phone", "term"]
# The four patterns. Lookbehinds and possessive groups only spare the engine hopeless starts
# and recursion; what matches, and where, is as without them.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to match at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"(?<!\p{L})\p{L}{4,}+"
REACH, WITNESS = 80, 8
#: Sanitising terms of up to so many rows are broadcast (about 60 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 100_000
SPAN = "array<struct<start:int,kind:int,end:int>>"
EXTRA = "array<struct<start:int,end:int,removed:boolean>>"
#: Entries that one fold goes over: longer arrays are folded in blocks, so that what a fold copies stays small.
BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def in_blocks(entries: Column, width: Callable[[Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """fold(block, sum of the widths before it) of each block of entries, one after another."""
    def use(own: Column) -> Column:
        count = F.ceil(F.size(own) / F.lit(float(BLOCK))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(own, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
        return F.when(count > 0, bound(blocks, placed)).otherwise(F.array())

    def placed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + width(x))
        starts = F.aggregate(blocks, zero, lambda acc, block: F.struct((acc["at"] + total(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.zip_with(blocks, starts, fold)

    return bound(entries, use)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, hit, around>> of the matches of pattern; around is a hash of what is beside a match."""
    def use(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        after = F.slice(gaps, F.lit(2), F.size(gaps))
        sides = F.zip_with(gaps, after, lambda g, h: F.struct(F.char_length(g).alias("gap"), F.xxhash64(F.right(g, F.lit(REACH)), F.left(h, F.lit(REACH))).alias("around")))
        return F.zip_with(F.slice(sides, F.lit(1), F.size(hits)), hits, lambda x, h: F.struct(x["gap"].alias("gap"), h.alias("hit"), x["around"].alias("around")))

    def fold(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            return F.struct((at + F.char_length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), x["hit"].alias("hit"), x["around"].alias("around")))).alias("out"))

        none = F.array().cast("array<struct<start:int,hit:string,around:bigint>>")
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step)["out"]

    return F.flatten(in_blocks(bound(F.split(text, pattern, -1), use), lambda x: x["gap"] + F.char_length(x["hit"]), fold))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, d).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _of_kinds(text: Column, make: Callable[[int, Column], Column], kind_of_array: str) -> Column:
    """make(kind's number, match) of all valid matches of all kinds."""
    def of(k: int, kind: str) -> Column:
        found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["hit"])), lambda m: make(k, m))
        return F.when(text.rlike(HINTS[kind]), found.cast(kind_of_array)).otherwise(F.array().cast(kind_of_array))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS[:4])))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start, then kind."""
    return F.array_sort(_of_kinds(text, lambda k, m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.char_length(m["hit"])).alias("end")), SPAN))


def protected(text: Column) -> Column:
    """The entities of a text, as hashes of kind and value, each with a hash of what is beside it; repeats included."""
    make = lambda k, m: F.struct(F.xxhash64(F.lit(k), F.lower(m["hit"])).alias("entity"), m["around"].alias("around"))
    return _of_kinds(text, make, "array<struct<entity:bigint,around:bigint>>")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty) and base (its spans)."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans(F.col("text")))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), _term))


def term_places(text: Column, base: Column, wanted: Column) -> Column:
    """The spans of the wanted terms (array<struct<term, removed>>) in a text, outside its base spans."""
    gaps, hits = F.split(text, TERM, -1), F.regexp_extract_all(text, F.lit(TERM), F.lit(0))

    def use(keys: Column) -> Column:
        def fold(block: Column, start: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                at = acc["at"] + x["gap"]
                end = at + F.char_length(x["hit"])
                found = F.array(F.struct(at.alias("start"), end.alias("end"), x["nth"].alias("nth")))
                return F.struct(end.alias("at"), F.when(x["nth"] > 0, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

            none = F.array().cast("array<struct<start:int,end:int,nth:bigint>>")
            return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), step)["out"]

        words = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit"), F.array_position(keys, _term(h)).alias("nth")))
        return F.flatten(in_blocks(F.filter(words, lambda x: x["hit"].isNotNull()), lambda x: x["gap"] + F.char_length(x["hit"]), fold))

    outside = lambda spans: F.filter(bound(F.transform(wanted, lambda w: w["term"]), use), lambda p: ~F.exists(spans, lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])))
    places = bound(base, outside)
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.element_at(wanted, p["nth"].cast("int"))["removed"].alias("removed"))).cast(EXTRA)


def revealing(docs: DataFrame, *, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame | None:
    """text_key, extra: the term spans (start, end, removed) of the texts in which terms reveal an entity; None without any."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    texts = docs.select("text").where("text is not null").withColumn("text_key", F.unhex(F.md5("text")))
    hinted = texts.where(F.col("text").rlike("|".join(f"(?:{h})" for h in HINTS.values())))
    held = hinted.withColumn("found", protected(F.col("text"))).where(F.size("found") > 0).dropDuplicates(["text_key"])
    held = checkpoint(held.withColumn("terms", terms_of(F.col("text"))))
    own = held.select("text_key", F.explode("found").alias("f")).select("text_key", "f.entity", "f.around").distinct()
    several = own.groupBy("entity").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.min("around").alias("c"), F.max("around").alias("d")).where("a < b and c < d")
    own = checkpoint(own.join(small(checkpoint(several.select("entity"))), "entity"))
    if own.isEmpty():
        return None
    # Each of the copies of a text counts its share, so the texts need not be shuffled to count them once.
    every = texts.groupBy("text_key").agg(F.count("*").alias("copies"))
    copied = checkpoint(every.where("copies > 1"))
    n = texts.count() - (copied.agg(F.sum("copies") - F.count("*")).first()[0] or 0)
    shared = texts.join(small(copied), "text_key", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    # A hot term is one row a task.
    counted = shared.select("share", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t"))
    words = held.join(own.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode("terms").alias("term"))
    words = checkpoint(words.join(counted, "term"))
    leasts = [f"least{k}" for k in range(WITNESS)]
    rare = words.where(F.col("n_t") <= math.sqrt(n)).groupBy("text_key").agg(*(F.min(F.xxhash64("term", F.lit(k))).alias(c) for k, c in enumerate(leasts)))
    # One text stands for those that share an entity's surroundings or a least hash.
    one = F.min(F.struct("text_key", *leasts)).alias("s")
    stands = own.join(rare, "text_key", "left").groupBy("entity", "around").agg(one).select("entity", "s.*").distinct()
    for c in leasts:
        stands = stands.groupBy("entity", c).agg(one).select("entity", "s.*")
    stands = checkpoint(stands.select("entity", "text_key"))
    entity = checkpoint(stands.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1"))
    own = own.select("entity", "text_key").distinct().join(small(entity), "entity")
    own = checkpoint(own.join(stands.withColumn("counts", F.lit(1)), ["entity", "text_key"], "left").withColumn("counts", F.coalesce("counts", F.lit(0))))
    words = words.where("n_t > 1")
    base_rate = F.col("n_e") / F.lit(float(n))
    limit = F.col("n_e") / F.pow(base_rate, F.lit(1 - generalise_at))
    pairs = own.join(words, "text_key").groupBy("entity", "n_e", "term", "n_t").agg(F.count("*").alias("both"), F.sum("counts").alias("k")).where("k > 1")
    pairs = pairs.withColumn("with_term", F.col("n_t") - F.col("both") + F.col("k")).where((F.col("with_term") <= limit * (1 + 1e-9)) & (F.col("n_e") < n))
    given = (F.col("k") - 1 + base_rate) / F.col("with_term")
    known = pairs.withColumn("ratio", F.log2(given / base_rate) / F.greatest(-F.log2(base_rate), F.lit(1e-9)))
    known = checkpoint(known.where(F.col("ratio") >= generalise_at).select("entity", "term", (F.col("ratio") >= remove_at).alias("removed")))
    if known.isEmpty():
        return None
    # Only terms that stand in the text: an entity's terms are not in all of its texts.
    wanted = own.select("entity", "text_key").join(small(known), "entity").groupBy("text_key", "term").agg(F.max("removed").alias("removed"))
    wanted = wanted.join(words.select("text_key", "term"), ["text_key", "term"], "left_semi")
    wanted = checkpoint(wanted.groupBy("text_key").agg(F.collect_list(F.struct("term", "removed")).alias("wanted")))
    marked = with_spans(held.select("text_key", "text").join(small(wanted), "text_key"))
    return checkpoint(marked.select("text_key", term_places(F.col("text"), F.col("base"), F.col("wanted")).alias("extra")).where(F.size("extra") > 0))


def find(docs: DataFrame, **options: float) -> DataFrame:
    """docs (doc_id, text, ...) with base (pattern spans) and extra (revealing term spans); a null text becomes empty."""
    extra = revealing(docs, **options)
    none = F.array().cast(EXTRA)
    if extra is None:
        return with_spans(docs).withColumn("extra", none)
    keyed = with_spans(docs).withColumn("text_key", F.unhex(F.md5("text")))
    small = extra.count() <= BROADCAST_ROWS // 10
    return keyed.join(F.broadcast(extra) if small else extra, "text_key", "left").withColumn("extra", F.coalesce("extra", none)).drop("text_key")


def all_spans() -> Column:
    """base and extra together, by start, then kind."""
    extra = F.transform("extra", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(F.col("base"), extra))


def sanitised() -> Column:
    """The text with base spans and generalised terms replaced by their kind in brackets and removed terms left out.

    Of spans that overlap, the text from the first start to the last end goes, under the kind of the first.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("by")))
    extra = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(F.get(names, F.lit(4))).alias("by")))
    text = F.col("text")

    def reach(spans: Column) -> Column:
        """For each block of spans, where the last of the spans before it ends."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        last = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))
        return F.aggregate(spans, zero, lambda acc, block: F.struct(F.greatest(acc["at"], last(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def block_text(block: Column, before: Column) -> Column:
        """What takes the place of the text from the end of earlier spans to the end of these."""
        def step(acc: Column, s: Column) -> Column:
            at = acc["at"]
            kept = F.concat(F.substring(acc["own"], at - before + 1, F.greatest(s["start"] - at, F.lit(0))), F.when(s["start"] >= at, s["by"]).otherwise(F.lit("")))
            return F.struct(F.greatest(at, s["end"]).alias("at"), acc["own"].alias("own"), F.concat(acc["out"], F.array(kept)).alias("out"))

        stop = F.array_max(F.transform(block, lambda s: s["end"]))
        own = F.substring(text, before + 1, F.greatest(stop - before, F.lit(0)))
        zero = F.struct(before.alias("at"), own.alias("own"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(block, zero, step)["out"], "")

    def rebuilt(spans: Column) -> Column:
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        count = F.ceil(F.size(spans) / F.lit(float(BLOCK))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(spans, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
        done = bound(blocks, lambda own: F.zip_with(own, reach(own), block_text))
        return F.concat(F.array_join(done, ""), F.substring(text, end + 1, F.char_length(text)))

    return F.when(F.size("base") + F.size("extra") == 0, text).otherwise(bound(F.array_sort(F.concat(base, extra)), rebuilt))


def count_of(kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def sanitise(docs: DataFrame, **options: float) -> DataFrame:
    """docs with the sanitised text in place of text, all columns kept whatever their names."""
    names, at = docs.columns, docs.columns.index("text")
    inner = [f"c{k}" for k in range(len(names))]
    inner[at] = "text"
    found = find(docs.toDF(*inner), **options).withColumn("text", sanitised())
    return found.select(*inner).toDF(*names)
