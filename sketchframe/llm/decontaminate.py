"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: runs of digits, units of measure after a number, and names turn into placeholders of one
character each, all other words are lower-cased.  A capitalised word may be a name or not, so a text has two templates:
all of its capitalised words are names in one and words in the other, whatever stands before them.  Windows of
both count; a window without capitalised words has one hash, others two.  Windows of
``width`` template words are hashed and joined between benchmark and documents, then compared
word by word.  The slots of a window must be consistent: each value in the item must stand for one value in the
document within that window, as it does in a question that was asked again with other numbers or names.  Only windows
with a conflict are left out, so one slot that differs costs the windows around it and equal values
far apart may be different variables.  Windows that cover at least ``share`` of an item's windows make a leak.

Words are hashed once a text, windows by the hashes of their words.  What unfolds is a row of few numbers a window; texts and words
stay behind.  Windows whose hash the benchmark has become hits: up to ``BROADCAST_ROWS`` distinct hashes, a number each, are sent to
all tasks, and beyond that a bitmap turns most windows away before both sides are exchanged.  Documents with hits
meet their text again, once each, for a comparison word by word.  The cost of a text is linear in its length.

Defined cases: null texts are empty and match nothing.  An item of fewer than ``width`` words is one window
of all its words.  Windows with fewer than ``literals`` ordinary words (or half the words of a short item)
tell little: they match only where all values are equal.  A leak has ``share`` of all of an item's windows or of
those that tell more, and the greater of the two is reported.  Items without any ordinary word are
not compared.  Items with equal ids and texts count once.  Rows that repeat id and text
give one row per item.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import in_bitmap, packed, text_key, texts
from sketchframe.session import BROADCAST_ROWS, write_out

# Characters of the private use area that stand for a number, a name and a unit.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# Units of measure, as written after a number.
UNITS = (
    "mm cm m km inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons "
    "ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years hz khz mhz ghz w kw mw v kv ma kj pa kpa mol "
    "kb mb gb tb usd eur gbp dollar dollars cent cents euro euros percent kmh mph"
).split()
_NAME = "\\p{Lu}\\p{Ll}+"
_SPLIT = f"[^\\p{{L}}\\p{{N}}{NUMBER}{NAME}{UNIT}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPLIT), "")


def _apart(text: Column) -> Column:
    """The text without the placeholders' characters, with a blank where digits and letters touch."""
    plain = F.when(F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(UNIT)), F.translate(text, NUMBER + NAME + UNIT, "   "))
    plain = plain.otherwise(text)
    return F.when(text.rlike("\\p{N}"), F.regexp_replace(plain, "(?<=\\p{N})(?=\\p{L})|(?<=\\p{L})(?=\\p{N})", " ")).otherwise(plain)


def raw_words(text: Column) -> Column:
    """Words as written, where digits and letters that touch are words of their own."""
    return _words(_apart(text))


def template_words(text: Column, names: bool = True) -> Column:
    """The same words with placeholders, one for one; capitalised words are names if ``names``."""
    apart = _apart(text)
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    united = F.regexp_replace(apart, f"(?<=\\p{{N}})([ -]+)(?i:{units})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}")
    named = F.when(text.rlike("\\p{N}"), united).otherwise(apart)
    if names:
        named = F.regexp_replace(named, f"(?<![\\p{{L}}\\p{{N}}]){_NAME}(?![\\p{{L}}\\p{{N}}])", NAME)
    numbered = F.when(text.rlike("\\p{N}"), F.regexp_replace(named, "\\p{N}+", NUMBER)).otherwise(named)
    # U+0130 is the one letter whose lower case is longer
    return _words(F.lower(F.replace(numbered, F.lit("\u0130"), F.lit("i"))))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _named(raw: Column, plain: Column) -> Column:
    """The plain template with names as placeholders: what ``template_words`` gives, from words that are known already."""
    return F.zip_with(raw, plain, lambda r, p: F.when(r.rlike(f"^{_NAME}$") & ~_is_slot(p), F.lit(NAME)).otherwise(p))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(plain: Column, named: Column, sizes: list[int]) -> Column:
    """(size, pos, h, g) of every window of each size, from the hashes of words: h of the plain template, g of that with names."""

    def of(n: int) -> Column:
        def window(i: Column) -> Column:
            h, g = (F.xxhash64(*[F.get(c, i + k) for k in range(n)]) for c in (plain, named))
            return F.struct(F.lit(n).alias("size"), i.alias("pos"), h.alias("h"), g.alias("g"))

        return F.when(F.size(plain) >= n, F.transform(F.sequence(F.lit(0), F.size(plain) - n), window))

    if len(sizes) == 1:
        return of(sizes[0])
    return F.flatten(F.filter(F.array(*map(of, sizes)), lambda w: w.isNotNull()))


def item_windows(benchmark: DataFrame, width: int, literals: int) -> DataFrame:
    """(item_id, item_key, at, size, pattern, named, values, windows, telling, telling_at, told, h): every item's windows.

    A window has a row per template.  ``windows`` counts windows and ``telling`` those with enough ordinary words besides
    names, as ``telling_at`` says of each; ``told`` says it of the template.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = items.select("item_id", "text", template_words(F.col("text")).alias("t"), template_words(F.col("text"), False).alias("p"), raw_words(F.col("text")).alias("r"))
    words = words.where(F.size("t") > 0).withColumn("size", F.least(F.size("t"), F.lit(width)))
    words = words.where(F.exists("p", lambda w: ~_is_slot(w)))

    def told(pattern: Column) -> Column:
        return F.size(F.filter(pattern, lambda w: ~_is_slot(w))) >= F.least(F.lit(literals), F.ceil(F.col("size") / 2))

    places = F.sequence(F.lit(0), F.size("t") - F.col("size"))
    telling = F.size(F.filter(places, lambda i: told(F.slice("t", i + 1, F.col("size")))))
    # the counts are the row's own, so that nothing is joined and items without an id stay
    words = words.withColumn("windows", (F.size("t") - F.col("size") + 1).cast("bigint")).withColumn("telling", telling.cast("bigint"))
    cut = words.select("*", F.explode(places).alias("at"))
    plain, named = (F.slice(c, F.col("at") + 1, F.col("size")) for c in ("p", "t"))
    # whether a window tells enough is judged with names as slots
    spread = cut.select("*", told(named).alias("telling_at"), F.explode(F.array_distinct(F.array(plain, named))).alias("pattern"))
    return spread.select(
        "item_id", text_key().alias("item_key"), "at", "size", "pattern", F.array_contains("pattern", NAME).alias("named"),
        F.transform(F.slice("r", F.col("at") + 1, F.col("size")), F.lower).alias("values"),
        "windows", "telling", "telling_at", told(F.col("pattern")).alias("told"), F.xxhash64(_word_hashes(F.col("pattern"))).alias("h"),
    )


def _hits(base: DataFrame, hashes: DataFrame, sizes: list[int], limit: int) -> DataFrame:
    """(doc_id, key, size, pos, h), stored: windows of the texts whose hash is among ``hashes(h)``."""
    if not sizes:
        return base.select("doc_id", F.lit("").alias("key"), F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("h")).where("false")
    cut = base.select("doc_id", text_key().alias("key"), raw_words(F.col("text")).alias("r"), template_words(F.col("text"), False).alias("p"))
    hashed = cut.select("doc_id", "key", _word_hashes(F.col("p")).alias("hp"), _word_hashes(_named(F.col("r"), F.col("p"))).alias("ht"))
    windows = hashed.select("doc_id", "key", _windows(F.col("hp"), F.col("ht"), sizes).alias("w"))
    # the outer form: the plain one gets a filter on the size of its array, which Spark moves down and evaluates per window
    spread = windows.select("doc_id", "key", F.inline_outer("w")).where("h is not null")
    either = F.explode(F.array_distinct(F.array("h", "g"))).alias("h")
    if hashes.count() <= limit:  # 8 bytes each
        # most windows leave at two look-ups, before any of them is doubled
        own, other = (F.broadcast(hashes.select(F.col("h").alias(name))) for name in ("_h", "_g"))
        known = spread.join(own, F.col("h") == F.col("_h"), "left").join(other, F.col("g") == F.col("_g"), "left").where("_h is not null or _g is not null")
        return write_out(known.select("doc_id", "key", "size", "pos", either).join(F.broadcast(hashes), "h", "left_semi"), "hits")
    doubled = spread.select("doc_id", "key", "size", "pos", either)
    return write_out(in_bitmap(doubled, "h", hashes.select(F.col("h").alias("id"))).join(hashes, "h", "left_semi"), "hits")


def _said(base: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with the window's words in both templates, and as written in lower case; each text is cut once."""
    places = F.collect_set(F.struct("size", "pos")).alias("places")  # windows of one text
    wanted = write_out(hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(places), "wanted")
    concerned = in_bitmap(base.withColumn("key", text_key()).withColumn("_hash", F.xxhash64("key", "doc_id")), "_hash", wanted.select(F.xxhash64("_key", "_id").alias("id")))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = concerned.join(wanted, same).select("doc_id", "key", "text", "places").dropDuplicates(["doc_id", "key"])
    cut = found.select("doc_id", "key", "places", raw_words(F.col("text")).alias("r"), template_words(F.col("text"), False).alias("p"))
    # stored, so that no expression over the whole text is evaluated again within a window
    cut = write_out(cut.select("doc_id", "key", "places", "p", _named(F.col("r"), F.col("p")).alias("t"), F.transform("r", F.lower).alias("r")), "words")

    def words(column: str, place: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), place["size"] - 1), lambda k: F.get(F.col(column), place["pos"] + k))

    each = F.transform("places", lambda w: F.struct(w["size"].alias("size"), w["pos"].alias("pos"), words("p", w).alias("plain"), words("t", w).alias("with_names"), words("r", w).alias("said")))
    windows = cut.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.inline_outer(each))
    windows = write_out(windows.withColumnRenamed("size", "_size").withColumnRenamed("pos", "_pos"), "windows")
    match = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("pos") == F.col("_pos"))
    # rows that repeat id and text have the same hits
    return hits.distinct().join(windows, match).select("doc_id", "key", "size", "pos", "h", "plain", "with_names", "said")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, share: float = 0.25, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, windows, matched, share, slots, changed) of every leak, and the document's ``key``.

    ``slots`` counts the placeholders met, ``changed`` those whose value in the document differs.
    """
    items = write_out(item_windows(benchmark, width, literals), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most `width` numbers
    hits = _hits(texts(docs), write_out(items.select("h").distinct(), "hashes"), sizes, limit)
    met = _said(texts(docs), hits).join(items, ["size", "h"])
    # a pattern without names is met by plain words
    hits = met.where(F.when(F.col("named"), F.col("with_names")).otherwise(F.col("plain")) == F.col("pattern"))
    pairs = F.filter(
        F.zip_with("pattern", F.arrays_zip("values", "said"), lambda p, v: F.struct(_is_slot(p).alias("slot"), v["values"].alias("value"), v["said"].alias("said"))),
        lambda s: s["slot"],
    )
    hits = hits.select("doc_id", "key", "item_id", "item_key", "windows", "telling", "telling_at", "told", "at", F.array_distinct(pairs).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda s: s["value"])))
    # one item's windows in one document: the sets are bounded by the item and the values met
    equal = F.forall("pairs", lambda s: s["value"] == s["said"])
    fits = equal | (F.col("told") & (F.size("pairs") == values))
    alike = hits.where(fits).groupBy("doc_id", "key", "item_id", "item_key", "windows", "telling").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("telling_at"), F.col("at"))).alias("told_at"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    matched = F.size("at").cast("bigint")
    whole = alike.select(
        "doc_id", "item_id", "windows", matched.alias("matched"), F.greatest(matched / F.col("windows"), F.when(F.col("telling") > 0, F.size("told_at") / F.col("telling"))).alias("share"),
        F.size("pairs").cast("bigint").alias("slots"), F.size(F.filter("pairs", lambda s: s["value"] != s["said"])).cast("bigint").alias("changed"), "key",
    )
    return whole.where(F.col("share") >= share)


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    found = write_out(found, "leaks")
    same = (F.col("mark") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    return packed(docs).join(found, same, "left_anti").select("row.*")
