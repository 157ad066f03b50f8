"""Benchmark items in documents, also with other numbers, names and units, in built-in expressions only.

Texts become templates: numbers in digits or words, names and units, also glued to a number, turn into typed placeholders, other words are folded. Runs of
template words are joined by hash; for the pairs found, the words that stand in an item's slots are lined up
with the document's, and a pair counts only if equal slot words of the item are equal words of the document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillworks.functions.once import once
from rillworks.llm import shared
from rillworks.llm.hosts import split_words

WINDOW = 8
COVERAGE = 0.5

#: Units by their usual signs and names.
UNITS = """mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet
 mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons
 ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
 mph kmh km/h m/s hz khz mhz ghz w kw mw wh kwh j kj cal kcal v kv a ma pa kpa bar k °c °f
 % percent $ € £ ¥ usd eur gbp dollar dollars cent cents euro euros kb mb gb tb""".split()

NUMBER, NAME, UNIT = "\x01n", "\x01p", "\x01u"
#: English number words; tens also take one of the first nine, with or without a hyphen.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split()
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#&$%+-_/\\~^`=@«»„“”‘’…"
_AROUND = "\\p{Punct}«»„“”‘’…"
_WHITE = "\\x20\\x09-\\x0D"
_BOUNDARY = f"(?=[{_WHITE}{_AROUND}]|$)"
#: A capital after a word that doesn't end a sentence; a number as a word of its own, perhaps within punctuation; a unit right after one.
#: Each begins with what is rare and looks back only from there.
_NAME_AT = f"\\p{{Lu}}(?<=[^\\s.!?:…][{_WHITE}]\\p{{Lu}})[^{_WHITE}]*+"
_DIGITS = f"[0-9](?<![^{_WHITE}{_AROUND}][0-9])[0-9]*+(?:[.,:/][0-9]++)*+"
_NUMBER_AT = f"{_DIGITS}{_BOUNDARY}"
_UNIT = f"(?i:{'|'.join(re.escape(u) for u in UNITS)})"
_GLUED_AT = f"({_DIGITS})({_UNIT}){_BOUNDARY}"
_UNIT_AT = f"({NUMBER}[{_WHITE}]){_UNIT}{_BOUNDARY}"
#: Number words as they stand without punctuation.
_SPELLED = ONES + TENS + [t + o for t in TENS for o in ONES] + NUMBER_WORDS
#: Any other word with a capital: it begins a text or sentence or stands behind a quote or bracket, and may be a name.
_CAPITAL = "^\\p{Lu}"


def spaced(text: Column) -> Column:
    """The text, NULL as empty, with a space between a number and the unit glued to it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _GLUED_AT, "$1 $2")


def marked(text: Column) -> Column:
    """The text with placeholders for its slots: names, numbers and units.

    A name is a word with a capital that doesn't begin a text or follow the end of a sentence; a unit is a
    unit's sign or name right after a number. White space stays as it is.
    """
    named = F.regexp_replace(text, _NAME_AT, NAME)
    numbered = F.regexp_replace(named, _NUMBER_AT, NUMBER)
    return F.regexp_replace(numbered, _UNIT_AT, f"$1{UNIT}")


def plain(text: Column) -> Column:
    """The text without punctuation."""
    return F.translate(text, _PUNCTUATION, "")


def _plain_words(text: Column) -> Column:
    """The words of a text without punctuation, by one translation and a split at single spaces."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r" + _PUNCTUATION, " " * 5), " "), "")


def templates(rows: DataFrame, text: str) -> DataFrame:
    """Adds tokens and named, the words of the template, and words, those of the text in the same places.

    Words with a capital that may or may not be names are words in tokens and names in named.
    """
    # one split of the text: placeholders leave its white space, so both arrays have the same places
    made = once(rows, _t=spaced(F.col(text)))
    made = once(made, _marked=F.transform(split_words(marked(F.col("_t"))), plain), _raw=split_words(F.col("_t")))
    both = F.zip_with("_marked", "_raw", lambda m, w: F.struct(m.alias("m"), F.lower(F.coalesce(F.nullif(plain(w), F.lit("")), w)).alias("w")))
    made = once(made, _both=F.filter(both, lambda x: x["m"] != ""))
    made = once(made, _low=F.transform("_both", lambda x: F.lower(x["m"])), words=F.col("_both.w"))
    made = once(made, tokens=_with_number_words("_low"))
    named = F.zip_with("_both", "tokens", lambda x, t: F.when(x["m"].rlike(_CAPITAL) & (t != NUMBER), NAME).otherwise(t))
    return once(made, named=named).drop("_t", "_marked", "_raw", "_both", "_low")


def _with_number_words(low: str) -> Column:
    """Words in small letters with placeholders for number words and for units right after one."""
    before = F.concat(F.array(F.lit("")), F.slice(low, 1, F.greatest(F.size(low) - 1, F.lit(0))))
    told = F.zip_with(low, before, lambda w, b: F.when(w.isin(_SPELLED), NUMBER).when(b.isin(_SPELLED) & w.isin(UNITS), UNIT).otherwise(w))
    return F.when(F.size(low) > 0, told).otherwise(F.col(low))


def _hashed_templates(rows: DataFrame, text: str) -> DataFrame:
    """Adds tokens_1 and named_1: the hashes of the words that `templates` gives, without these. named_1 is empty if both readings are the same."""
    made = once(rows, _words=_plain_words(marked(spaced(F.col(text)))))
    made = once(made, _low=F.transform("_words", F.lower))
    made = once(made, _tokens=_with_number_words("_low"))
    made = once(made, tokens_1=_word_hashes("_tokens"))
    number, name = F.xxhash64(F.lit(NUMBER)), F.xxhash64(F.lit(NAME))
    named = F.zip_with("_words", "tokens_1", lambda w, h: F.when(w.rlike(_CAPITAL) & (h != number), name).otherwise(h))
    named = F.when(F.exists("_words", lambda w: w.rlike(_CAPITAL)), named).otherwise(F.array().cast("array<bigint>"))
    return once(made, named_1=named).drop("_words", "_low", "_tokens")


def _runs(rows: DataFrame, of: str, length: int) -> DataFrame:
    """Adds {of}_{length}: the hashes of all runs of `length` words, from those of single words in {of}_1.

    A run's hash is that of its two halves' hashes, so the work grows with the logarithm of the length.
    """
    if f"{of}_{length}" in rows.columns:
        return rows
    left, right = length // 2, length - length // 2
    rows = _runs(_runs(rows, of, left), of, right)
    n = F.greatest(F.size(f"{of}_1") - (length - 1), F.lit(0))
    halves = F.slice(f"{of}_{left}", 1, n), F.slice(f"{of}_{right}", 1 + left, n)
    return once(rows, **{f"{of}_{length}": F.zip_with(*halves, lambda a, b: F.xxhash64(a, b))})


def _starts(words: str, window: int) -> Column:
    n = F.size(words)
    return F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))


def _word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _exact_hashes(words: str) -> Column:
    """Hashes of words as they are, other than those of any template."""
    return F.transform(words, lambda w: F.xxhash64(F.lit("exact"), F.lower(w)))


def _exact_words(text: str) -> Column:
    return _plain_words(F.coalesce(F.col(text), F.lit("")))


def _usable(tokens: Column, window: int) -> Column:
    return 2 * F.size(F.filter(tokens, lambda w: w.startswith("\x01"))) <= window


def items(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item_id, place, reading, h, wid, slots, length, n_windows): the windows of each distinct text, under its least key.

    A window wid has up to two hashes h: capitals that may be names are words (reading 0) or names (1). slots
    are those in the window. Texts without a usable window of either reading have runs of their own words
    (reading 2), `window` words each or all if there are fewer; length is that of the runs.
    """
    one = benchmark.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.min(key).alias("item_id"))
    made = once(once(templates(one, "_text"), tokens_1=_word_hashes("tokens"), named_1=_word_hashes("named"), _exact=_exact_words("_text")), exact_1=_exact_hashes("_exact"))
    for of in ("tokens", "named"):
        made = _runs(made, of, window)
    for n in range(1, window + 1):
        made = _runs(made, "exact", n)
    made = shared.stored(made.drop("_text", "_exact"))

    def reading(number: int, tokens: str) -> Column:
        def window_at(i: Column) -> Column:
            run = F.slice(tokens, i, window)
            slots = F.zip_with(run, F.slice("words", i, window), lambda t, w: F.struct(t.alias("t"), w.alias("w")))
            slots = F.transform(slots, lambda s, j: F.struct(j.alias("i"), s["w"].alias("own"), s["t"].startswith("\x01").alias("slot")))
            slots = F.transform(F.filter(slots, lambda s: s["slot"]), lambda s: F.struct(s["i"].alias("i"), s["own"].alias("own")))
            return F.struct((i - 1).alias("place"), F.lit(number).alias("reading"), F.get(f"{tokens}_{window}", i - 1).alias("h"), F.get(f"tokens_{window}", i - 1).alias("wid"), slots.alias("slots"), _usable(run, window).alias("usable"))
        return F.transform(_starts(tokens, window), window_at)

    read = made.select("item_id", F.inline(F.concat(reading(0, "tokens"), reading(1, "named")))).filter("usable").drop("usable").withColumn("length", F.lit(window))
    read = read.filter("reading = 0 OR h <> wid")
    rest = made.join(read.select("item_id").distinct(), "item_id", "left_anti").filter(F.size("exact_1") > 0)
    lengths = F.least(F.size("exact_1"), F.lit(window))
    no_slots = F.array().cast(read.schema["slots"].dataType)
    runs = None
    for n in range(1, window + 1):
        part = rest.filter(lengths == n).select("item_id", F.posexplode(f"exact_{n}").alias("place", "h"))
        part = part.select("item_id", "place", F.lit(2).alias("reading"), "h", F.col("h").alias("wid"), no_slots.alias("slots"), F.lit(n).alias("length"))
        runs = part if runs is None else runs.union(part)
    every = read.union(runs)
    return every.join(every.groupBy("item_id").agg(F.countDistinct("wid").alias("n_windows")), "item_id")


def _text_id(text: str) -> Column:
    """128 bits of a text, the same wherever and how often it is read: rows of one text are judged as one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("second"), t).alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(key, item_id, coverage, n_slots, n_changed): pairs of a document and an item that it holds, given or re-parameterised.

    coverage is the share of the item's distinct template windows that the document has; pairs below `coverage`
    are left out. For the rest, item and document are lined up at each shared window, and slots within shared
    windows compared. n_slots of the best alignments are their slots, n_changed those with other words. Pairs
    are left out if no consistent alignments (an item's slot word always the same word in the document) hold
    `coverage` of the windows.

    Items without a usable template window, short or mostly numbers, are found as given only: by all their words,
    or runs of `window` of them. Items with the same text count as the one with the least key; NULL texts and keys
    of items are passed over, and items without words match nothing. Documents with NULL texts hold nothing.
    Each text is judged by itself; a key (NULL too) with several texts has one row per item, that of the text
    that holds most of it.
    """
    found = shared.stored(_text_pairs(docs, benchmark, text, item_key, item_text, window, coverage))
    rows = docs.select(F.col(key).alias("key"), _text_id(text).alias("id"))
    best = rows.join(found, "id").groupBy("key", "item_id").agg(F.max(F.struct("coverage", -F.col("n_changed"), "n_slots", "n_changed")).alias("b"))
    return best.select("key", "item_id", "b.coverage", "b.n_slots", "b.n_changed")


def _text_pairs(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str, window: int, coverage: float) -> DataFrame:
    """(id, item_id, coverage, n_slots, n_changed): as `leaks`, for each distinct text."""
    index = shared.stored(items(benchmark, item_key, item_text, window))
    exact = sorted(r[0] for r in index.filter("reading = 2").select("length").distinct().collect())
    rows = docs.select(_text_id(text).alias("id"), F.col(text).alias("_text"))
    made = _hashed_templates(rows, "_text")
    if exact:
        made = once(once(made, _exact=_exact_words("_text")), exact_1=_exact_hashes("_exact"))
    asked = [("tokens", window), ("named", window), *(("exact", n) for n in exact)]
    for of, n in asked:
        made = _runs(made, of, n)
    hashed = made.select("id", F.array_distinct(F.concat(*[f"{of}_{n}" for of, n in asked])).alias("hs"))
    met = hashed.select("id", F.explode("hs").alias("h")).join(index.select("item_id", "h", "wid", "n_windows", (F.col("reading") == 2).alias("exact")).distinct(), "h")
    shares = met.groupBy("id", "item_id").agg((F.countDistinct("wid") / F.first("n_windows")).alias("coverage"), F.first("exact").alias("exact")).filter(F.col("coverage") >= coverage)
    found_pairs = shared.stored(shares)
    pairs = found_pairs.filter("NOT exact").drop("exact")
    given = found_pairs.filter("exact").select("id", "item_id", "coverage", F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"))

    # the documents of pairs only are read once more and lined up with their items
    again = rows.join(pairs.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    lined = once(templates(again, "_text"), tokens_1=_word_hashes("tokens"), named_1=_word_hashes("named"))
    lined = _runs(_runs(lined, "tokens", window), "named", window)

    def places(of: str) -> Column:
        return F.transform(_starts(of, window), lambda i: F.struct((i - 1).alias("at"), F.get(f"{of}_{window}", i - 1).alias("h"), F.slice("words", i, window).alias("others")))

    lined = lined.select("id", F.inline(F.concat(places("tokens"), places("named"))))
    found = lined.join(index.filter("reading < 2"), "h")
    found = found.join(pairs.select("id", "item_id"), ["id", "item_id"], "left_semi")
    slots = F.transform("slots", lambda s: F.struct((F.col("place") + s["i"]).alias("p"), s["own"].alias("own"), F.get("others", s["i"]).alias("other")))
    # a window that fits with its capitals as words isn't read with names
    found = found.groupBy("id", "item_id", (F.col("at") - F.col("place")).alias("shift"), "place").agg(F.min(F.struct("reading", "wid", slots.alias("slots"), "n_windows")).alias("w"))
    shifts = found.groupBy("id", "item_id", "shift").agg(
        F.sort_array(F.collect_set("w.wid")).alias("hs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("w.slots")))).alias("slots"), F.first("w.n_windows").alias("n_windows"))
    return _consistent(pairs, shifts, coverage).union(given)


def _fits(slots: Column) -> Column:
    """True if equal words of the item are equal words of the document."""
    return F.size(F.array_distinct(F.transform(slots, lambda s: s["own"]))) == F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["own"], s["other"]))))


def _consistent(pairs: DataFrame, shifts: DataFrame, coverage: float) -> DataFrame:
    """Pairs whose alignments hold `coverage` of the item's windows without contradiction, with slots and changed slots.

    An edited item is spread over several shifts. From each shift that fits by itself the others are added, those with
    most windows first, as long as their slots don't contradict those taken; equal shifts count once.
    """
    one = shifts.filter(_fits(F.col("slots"))).groupBy("id", "item_id", "hs", "slots").agg(F.first("n_windows").alias("n_windows"))
    all_of = one.groupBy("id", "item_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct(F.size("hs").alias("n"), "hs", "slots")))).alias("parts"), F.first("n_windows").alias("n_windows"))

    def chain(seed: Column) -> Column:
        start = F.struct(seed["hs"].alias("hs"), seed["slots"].alias("slots"))

        def step(now: Column, part: Column) -> Column:
            both = F.array_union(now["slots"], part["slots"])
            return F.when(_fits(both), F.struct(F.array_union(now["hs"], part["hs"]).alias("hs"), both.alias("slots"))).otherwise(now)

        return F.aggregate("parts", start, step)

    # where one shift has enough windows the others needn't be chained from each
    enough = lambda hs: F.size(hs) >= F.lit(coverage) * F.col("n_windows")
    seeds = F.when(enough(F.get("parts", F.lit(0))["hs"]), F.slice("parts", 1, 1)).otherwise(F.col("parts"))
    chains = all_of.withColumn("_seeds", seeds).select("id", "item_id", "n_windows", F.explode(F.transform("_seeds", chain)).alias("c")).filter(enough(F.col("c.hs")))
    told = once(chains, _slots=F.array_distinct(F.transform("c.slots", lambda s: F.struct(s["p"], s["own"] != s["other"]))))
    told = told.withColumn("n_slots", F.size("_slots")).withColumn("n_changed", F.size(F.filter("_slots", lambda s: s["col2"])))
    best = told.groupBy("id", "item_id").agg(F.max(F.struct(F.size("c.hs"), -F.col("n_changed"), "n_slots", "n_changed")).alias("b"))
    best = best.select("id", "item_id", F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.n_changed").cast("long").alias("n_changed"))
    return pairs.join(best, ["id", "item_id"]).select("id", "item_id", "coverage", "n_slots", "n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows and columns of `docs`, whatever their names, whose text holds no item; other rows of the same key, NULL or not, stay."""
    bad = _text_pairs(docs, benchmark, text, item_key, item_text, window, coverage).select("id").distinct()
    own, a, b = (shared.fresh(n, docs.columns) for n in ("_id", "_a", "_b"))
    bad = shared.stored(bad).select(F.col("id.a").alias(a), F.col("id.b").alias(b))
    rows = docs.withColumn(own, _text_id(text))
    return rows.join(bad, (F.col(own)["a"] == F.col(a)) & (F.col(own)["b"] == F.col(b)), "left_anti").drop(own)
