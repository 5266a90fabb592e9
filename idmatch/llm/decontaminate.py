"""Benchmark decontamination by question templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.llm.copies import keyed
from idmatch.llm.words import typed
from idmatch.session import durable

#: Template words in a window, and how many of them must be words of the text rather than placeholders.
WINDOW, LITERAL = 8, 4
#: Template words of an item that a document must share.
ENOUGH = 13
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Units that may follow a number: fixed values.
UNITS = ("mm cm m km in inch inches ft feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml l liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh k usd eur dollar dollars "
         "euro euros cent cents pound pounds percent degree degrees")


def spaced(text: Column) -> Column:
    """The text with single spaces between words, and without characters that stand for placeholders."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}]", "")
    return F.trim(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", " "))


def templated(line: Column) -> Column:
    """A spaced text as a template, with as many spaces: a capitalised word (not all capitals) inside a sentence becomes a name, a number a
    number, a unit after a number a unit; other words lose punctuation and capitals (and may be empty then)."""
    line = F.regexp_replace(line, r"(?<=[^\s.!?:] )\p{Lu}[\p{M}'’]*\p{Ll}[\p{L}\p{M}'’-]*", NAME)
    line = F.regexp_replace(line, r"(?<![\p{L}\p{N}])[+-]?\p{Nd}[\p{Nd}.,:/-]*", NUMBER)
    line = F.regexp_replace(line, f"(?<={NUMBER}[ %$-]?)(?:{'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{N}}])", UNIT)
    return F.lower(F.regexp_replace(line, f"[^\\p{{L}}\\p{{M}}\\p{{N}} {NAME}{NUMBER}{UNIT}]+", ""))


def word_pairs(text: Column) -> Column:
    """(raw, word): the words of a template next to the words of the text, without those that are empty in the template."""
    zipped = F.arrays_zip(F.split(spaced(text), " ").alias("raw"), F.split(templated(spaced(text)), " ").alias("word"))
    return F.filter(zipped, lambda x: x["word"] != "")


def template_words(text: Column) -> Column:
    return F.array_remove(F.split(templated(spaced(text)), " "), "")


def plain_words(pairs: Column) -> Column:
    """The words of the text without the punctuation around them and without capitals."""
    return F.transform(pairs["raw"], lambda x: F.lower(_value(x)))


def generated(**columns: Column) -> Column:
    """A struct of the columns; as a generated row, so that what reads it does not make it anew for each window."""
    return F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _places(words: Column, length: Column) -> Column:
    """The places of the windows of ``length`` words."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1, F.lit(1))).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, at: Column, length: Column, raw: Column) -> Column:
    """(at, key) of the windows at these places of a list of words."""
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i, length), length, raw).alias("key")))


def item_table(benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(item_key, item_id, item, length, raw, n_held, windows): each different row of the benchmark that has words, with
    its words, the length of its windows, the number of its words in windows, and (at, key) of the windows.

    Windows with fewer than ``literal`` different words of the text are left out. An item that has no others keeps them
    all, of words as they stand (``raw``). The first window is also made as its first word is templated after another
    word and after a number.
    """
    rows = typed(benchmark, item_id="long", text="string").withColumn("item_key", F.xxhash64("item_id", "text")).dropDuplicates(["item_key"])
    after = lambda led: F.array_remove(F.slice(F.split(templated(F.concat(F.lit(led), spaced(F.col("text")))), " "), F.lit(2), F.size(F.split(spaced(F.col("text")), " "))), "")
    pairs = word_pairs(F.col("text"))
    told = rows.select("item_key", "item_id", generated(item=pairs, word=pairs["word"], plain=plain_words(pairs), after_word=after("x "), after_number=after("1 ")).alias("t"))
    told = told.select("item_key", "item_id", "t.*").filter("size(item) > 0").withColumn("length", F.least(F.lit(window), F.size("item")))
    literals = lambda i: F.size(F.array_distinct(F.filter(F.slice("word", i, F.col("length")), lambda x: ~x.isin(NAME, NUMBER, UNIT))))
    every = told.withColumn("every", _places(F.col("word"), F.col("length")))
    kept = every.withColumn("kept", F.filter("every", lambda i: literals(i) >= literal)).withColumn("raw", F.size("kept") == 0)
    kept = kept.withColumn("at", F.when(F.col("raw"), F.col("every")).otherwise(F.col("kept")))
    first = F.filter("at", lambda i: i == 1)
    windows = [_windows(F.when(F.col("raw"), F.col("plain")).otherwise(F.col(c)), at, F.col("length"), F.col("raw")) for c, at in [("word", F.col("at")), ("after_word", first), ("after_number", first)]]
    held = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("length") - 1))))
    return kept.select("item_key", "item_id", "item", "length", "raw", F.size(held).alias("n_held"), F.concat(*windows).alias("windows"))


def _whole(words: Column, at: Column) -> Column:
    """The text of the words with one placeholder around a place: a name of several words."""
    same = lambda q: F.forall(F.sequence(F.least(at, q), F.greatest(at, q)), lambda r: F.get(words, r - 1)["word"] == F.get(words, at - 1)["word"])
    near = F.sequence(F.greatest(F.lit(1), at - WINDOW), F.least(F.size(words), at + WINDOW))
    return F.concat_ws(" ", F.transform(F.filter(near, same), lambda q: _value(F.get(words, q - 1)["raw"])))


def _value(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _line(line: Column) -> Column:
    """The matches of one shift as [(at, slots)]: the places in the item, and what stands against its placeholders.

    Where a name or number goes on at one side only, the line is given a second time with the whole of both as the slot.
    """
    item, doc, shift = F.col("item"), F.col("pairs"), line["shift"]
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(line["ats"], lambda a: F.sequence(a, a + F.col("length") - 1)))))
    goes_on = lambda words, p, step: F.coalesce(F.get(words, p + step - 1)["word"] == F.get(words, p - 1)["word"], F.lit(False))
    torn = lambda i: (goes_on(item, i, -1) != goes_on(doc, i + shift, -1)) | (goes_on(item, i, 1) != goes_on(doc, i + shift, 1))
    plain = lambda i: F.struct(_value(F.get(item, i - 1)["raw"]).alias("item"), _value(F.get(doc, i + shift - 1)["raw"]).alias("doc"))
    whole = lambda i: F.when(torn(i), F.struct(_whole(item, i).alias("item"), _whole(doc, i + shift).alias("doc"))).otherwise(plain(i))
    holders = F.filter(at, lambda i: F.concat(F.get(item, i - 1)["word"], F.get(doc, i + shift - 1)["word"]).rlike(f"[{NAME}{NUMBER}{UNIT}]"))
    return F.array(*[F.struct(at.alias("at"), F.array_sort(F.array_distinct(F.transform(holders, slot))).alias("slots")) for slot in (plain, whole)])


def _consistent(slots: Column) -> Column:
    return (F.size(F.array_distinct(slots["item"])) == F.size(slots)) & (F.size(F.array_distinct(slots["doc"])) == F.size(slots))


def _equal(slots: Column) -> Column:
    return F.forall(slots, lambda v: v["item"] == v["doc"])


def _occurrence(lines: Column, need: Column) -> Column:
    """(at, slots) of an occurrence that covers ``need`` places, else null: all verbatim lines together, or else the
    first line that does with those that agree with it, longest first."""
    kind = "struct<at:array<int>,slots:array<struct<item:string,doc:string>>>"
    none = F.from_json(F.lit('{"at":[],"slots":[]}'), kind)
    both = lambda a, b: F.struct(F.array_union(a["at"], b["at"]).alias("at"), F.array_union(a["slots"], b["slots"]).alias("slots"))
    pooled = lambda some: F.aggregate(some, none, both)
    enough = lambda c: F.size(c["at"]) >= need
    longest = F.reverse(F.array_sort(F.transform(F.filter(lines, lambda x: _consistent(x["slots"])), lambda x: F.struct(F.size(x["at"]).alias("n"), x.alias("line")))))["line"]
    agreeing = lambda first: F.aggregate(longest, first, lambda c, x: F.when(_consistent(F.array_union(c["slots"], x["slots"])), both(c, x)).otherwise(c))
    passed = lambda first: F.get(F.filter(F.array(agreeing(first)), enough), 0)
    any_of = F.aggregate(longest, F.lit(None).cast(kind), lambda c, x: F.when(c.isNotNull(), c).otherwise(passed(x)))
    verbatim = pooled(F.filter(lines, lambda x: _equal(x["slots"])))
    reach = F.size(F.array_distinct(F.flatten(lines["at"])))
    return F.when(enough(verbatim), verbatim).when(reach >= need, any_of)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, uid, covered, n_slots, consistent, kind): the benchmark items that each document contains.

    Words become template words; windows of them are joined by hash. A search over the distinct windows of each document
    finds those that share any window with any item; only those are joined window by window. An item counts as contained when at least ``enough`` of its template words (all that its windows hold, if fewer) lie in
    shared windows of one occurrence: windows at one distance, with those at other distances that agree with them. Its
    slots must be consistent: one value of the item always stands against one value of the document, and the other way
    round. ``kind`` is ``verbatim`` when all those values are equal, else ``reparameterised``; an occurrence that is
    verbatim goes before others, and what does not agree with an occurrence does not count against it.

    An item shorter than a window is one window of its own length. Windows with fewer than ``LITERAL`` different words
    besides placeholders match nothing, but an item without others matches word for word, as it stands (so an item of one
    word is in every document that has the word). Each different (item_id, text) of the benchmark is an item; its id may
    be null or repeated. Null and empty texts match nothing; repeated documents give repeated pairs; without rows on
    either side there are none. Windows that fill many documents cost one row for each place in those documents.
    """
    rows = keyed(docs).select("doc_id", "uid", "text")
    items = durable(item_table(benchmark, window))
    keys = durable(items.select("item_key", F.explode("windows").alias("w")).select("item_key", "w.at", "w.key").distinct())
    kinds = [(r.length, r.raw) for r in items.select("length", "raw").distinct().collect()]  # 2 * window at most
    windows = lambda x: F.concat(F.array().cast("array<struct<at:int,key:bigint>>"), *[
        _windows(list_, _places(list_, F.lit(length)), F.lit(length), F.lit(raw)) for length, raw in kinds for list_ in [x["plain" if raw else "word"]]])
    words, pairs = F.col("words"), F.col("pairs")
    some_raw = any(raw for _, raw in kinds)
    plain = lambda of: {"plain": plain_words(of)} if some_raw else {}
    listed = rows.select("uid", generated(word=template_words(F.col("text")), **plain(word_pairs(F.col("text")))).alias("words"))
    looked = listed.select("uid", F.explode(F.array_distinct(windows(words)["key"])).alias("key"))
    hit = looked.join(keys.select("key").distinct(), "key", "left_semi").select("uid").distinct()
    found = durable(rows.join(hit, "uid", "left_semi").dropDuplicates(["uid"]).select("uid", word_pairs(F.col("text")).alias("pairs")))
    parted = found.select("uid", generated(word=pairs["word"], **plain(pairs)).alias("words"))
    every = parted.select("uid", F.explode(windows(words)).alias("w")).select("uid", F.col("w.key").alias("key"), F.col("w.at").alias("doc_at"))
    matched = every.join(keys, "key").groupBy("uid", "item_key", (F.col("doc_at") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    lines = matched.groupBy("uid", "item_key").agg(F.collect_list(F.struct("shift", "ats")).alias("lines"))
    sided = lines.join(items.drop("windows"), "item_key").join(found, "uid")
    read = sided.select("uid", "item_key", "item_id", "n_held", F.explode(F.flatten(F.transform("lines", _line))).alias("line"))
    told = read.groupBy("uid", "item_key", "n_held").agg(F.first("item_id").alias("item_id"), F.collect_set("line").alias("lines"))
    best = told.withColumn("best", _occurrence(F.col("lines"), F.least(F.lit(enough), F.col("n_held")))).filter("best IS NOT NULL")
    held = best.select("uid", "item_id", F.size("best.at").alias("covered"), F.size("best.slots").alias("n_slots"), F.lit(True).alias("consistent"),
                       F.when(_equal(F.col("best.slots")), "verbatim").otherwise("reparameterised").alias("kind"))
    return rows.select("doc_id", "uid").join(held, "uid").select("doc_id", "item_id", "uid", "covered", "n_slots", "consistent", "kind")
