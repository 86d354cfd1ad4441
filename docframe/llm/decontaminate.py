"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts are cut into tokens (runs of letters, digits, signs of numbers). A token becomes a typed placeholder if it is a
number, a unit, or a name (a capitalised word inside a sentence); other tokens are lower-cased. Windows of WINDOW
consecutive tokens are hashed and joined with those of the benchmark items, so a question whose numbers, names or units
were changed still matches. A document is reported for an item if enough different windows match and the slots agree:
within one occurrence, one value in the item always stands for one value in the document (re-parameterised questions
change a value everywhere; unrelated texts that share a frame do not). Occurrences are told apart by the distance between
a window's place in the document and in the item: each distance, each run of distances that differ by MAX_SHIFT at most
(values of another number of words) and the whole document (a copy in pieces) are judged by themselves, and one that
agrees is enough. So are enough windows whose slots all have the item's own values. Windows of the item with too few
literals, or too short, for a template are looked for as they are, letter case aside, and count among the latter.
Writing without blanks between words (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is cut into characters.

Scale: the document side is never shuffled for the search if the benchmark's windows fit MAX_BROADCAST (counted first);
beyond that the join is a shuffle join on window hashes whose skew Spark splits. Matched windows alone are aggregated,
and slots are read again only from documents that match.

Defined cases: null texts and items without a letter or digit match nothing; items shorter than WINDOW are matched by
their whole length, as templates down to MIN_WINDOW tokens and else as they are, so that an item of one word is found in
every text that holds this word; repeated rows and repeated items are treated one by
one under their ids (rows that share a doc_id are taken together); rows without doc_id are not searched, and `stage` keeps
them; an empty table gives no rows; other columns are not read. A window common to many items meets each of them in each
document that holds it, so the work follows documents times the items that share their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from docframe.cluster import durable

WINDOW = 8
MIN_WINDOW = 5
#: Tokens of a template that aren't placeholders, at least.
MIN_LITERAL = 4
#: Different item windows that a document shares at least, and as a share of the item's windows.
MIN_MATCHES, MIN_SHARE = 3, 0.05
#: Tokens that a changed value may have more or less, for windows around it to count as one occurrence.
MAX_SHIFT = 2
#: Slots that agree at least.
MIN_SAME = 0.8
#: Benchmark windows that are broadcast at most; about 40 bytes each.
MAX_BROADCAST = 500_000
# Units of measure.
SLOTS = ("<num>", "<name>", "<unit>")
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|cl|l|s|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years|inch|inches|ft|foot|feet|yard|yards|mile|miles|mph|kph|kmh|meter|meters|metre|metres|kilometer|kilometers|kilometre|kilometres|gram|grams|kilogram|kilograms|liter|liters|litre|litres|dollar|dollars|cent|cents|euro|euros|pound|pounds|percent|usd|eur|gbp|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|mw|v|a|ohm|ohms|pa|kpa|bar|celsius|fahrenheit|kelvin|degree|degrees"


# Scripts without blanks between words.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[\p{L}\p{N}]]"


def tokens(text) -> F.Column:
    """Array of raw tokens; a name inside a sentence is marked by a leading `^`."""
    text = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, rf"({_UNSPACED}\p{{M}}*)", " $1 ")).otherwise(text)
    # A capital after a lower-case letter, digit or comma and one blank starts a name.
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu}\p{Ll})", "^")
    return F.filter(F.split(marked, r"[^\p{L}\p{N}\p{M}^.]+|\.(?!\p{N})|(?<!\p{N})\."), lambda x: x != "")


def template(token) -> F.Column:
    """The token's template form."""
    units = F.lower(token).isin(*UNITS.split("|"))
    number = token.rlike(r"^[0-9]+(\.[0-9]+)*$")
    return F.when(token.startswith("^"), F.lit("<name>")).when(number, F.lit("<num>")).when(units, F.lit("<unit>")).otherwise(F.lower(token))


def _loose(part) -> F.Column:
    """The hash of a window of raw tokens as a template."""
    return F.xxhash64(F.transform(part, template))


def _exact(part) -> F.Column:
    """The hash of a window of raw tokens as it is, letter case and marks of names aside."""
    return F.xxhash64(F.lit("="), F.transform(part, lambda x: F.lower(F.ltrim(x, F.lit("^")))))


def _windows(rows: DataFrame, key: str, n: int, loose: bool) -> DataFrame:
    """key, h: the hashes of all windows of n tokens of column `t`, in order; null if there are fewer tokens."""
    form = template if loose else lambda x: F.lower(F.ltrim(x, F.lit("^")))
    rows = rows.select(key, F.transform("t", form).alias("f"))
    hashed = (lambda x: F.xxhash64(x)) if loose else lambda x: F.xxhash64(F.lit("="), x)
    whole = F.transform(F.sequence(F.lit(1), F.size("f") - (n - 1)), lambda i: hashed(F.slice("f", i, n)))
    return rows.select(key, F.when(F.size("f") >= n, whole).alias("h"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (window length), p, loose, h, raw, slots, size, loose_size: the windows of the items; loose: as templates."""
    t = benchmark.select("item_id", tokens(F.col("text")).alias("t")).withColumn("n", F.least(F.size("t"), F.lit(WINDOW))).where(F.col("n") >= 1)
    t = t.withColumn("p", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1))).select("item_id", "n", "p", F.slice("t", F.col("p"), F.col("n")).alias("raw"))
    t = t.withColumn("slots", F.size(F.filter("raw", lambda x: template(x).isin(*SLOTS))))
    t = t.withColumn("loose", (F.col("n") >= MIN_WINDOW) & (F.col("n") - F.col("slots") >= MIN_LITERAL))
    t = t.withColumn("h", F.when(F.col("loose"), _loose("raw")).otherwise(_exact("raw"))).withColumn("slots", F.when(F.col("loose"), F.col("slots")).otherwise(0))
    own = Window.partitionBy("item_id")
    return t.withColumn("size", F.count("*").over(own)).withColumn("loose_size", F.count_if("loose").over(own))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, share, n_changed of each document and item that it contains.

    n_windows: different windows of the item found; share: of the item's windows; n_changed: different slots whose value
    in the document is another than in the item (0: a plain copy).
    """
    items = durable(_items(benchmark))
    lengths = {(r["n"], r["loose"]): r["count"] for r in items.groupBy("n", "loose").count().collect()}
    small = F.broadcast if sum(lengths.values()) <= MAX_BROADCAST else lambda df: df
    text = docs.where("doc_id is not null and text is not null").select("doc_id", tokens(F.col("text")).alias("t"))
    flags = items.groupBy("h").agg(F.max("slots").alias("slots"))
    kind, other = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {other}, n_windows long, share double, n_changed long")
    # posexplode_outer: with posexplode, Spark adds a filter that computes all windows once more.
    found = [_windows(text, "doc_id", n, loose).select("doc_id", F.posexplode_outer("h").alias("q", "h")).join(small(flags), "h") for n, loose in sorted(lengths)]
    hits = durable(reduce(DataFrame.unionByName, found))
    pairs = hits.select("doc_id", "h").distinct().join(small(items), "h").groupBy("doc_id", "item_id").agg(F.countDistinct("p").alias("n_windows"), F.countDistinct(F.when(F.col("loose"), F.col("p"))).alias("n_loose"), F.max("size").alias("size"), F.max("loose_size").alias("loose_size"))
    enough = pairs.where(_enough(F.col("n_windows"), F.col("size")) | _enough(F.col("n_loose"), F.col("loose_size")))
    slotted = hits.where("slots > 0")
    if slotted.isEmpty():
        agreed = enough.withColumn("n_changed", F.lit(0))
    else:
        agreed = enough.join(_slots(docs, hits, slotted, small(items)), ["doc_id", "item_id"], "left").where("coalesce(agrees, true)")
    return agreed.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("size")).alias("share"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))


def _enough(n: F.Column, size: F.Column) -> F.Column:
    return (n > 0) & (n >= F.least(F.lit(MIN_MATCHES), size)) & (n >= MIN_SHARE * size)


def _slots(docs: DataFrame, hits: DataFrame, slotted: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, agrees, n_changed: whether each value of the item stands for one value of the document in one occurrence.

    n_changed is that of the occurrence with most windows that agrees. Only the documents with a match in a window that
    has slots are read again.
    """
    places = hits.join(slotted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("q", "h")).alias("at"))
    raw = docs.where("text is not null").select("doc_id", "text").join(places, "doc_id").select("doc_id", "at", tokens(F.col("text")).alias("t"))
    own = raw.select("doc_id", F.explode_outer(F.transform("at", lambda x: F.struct(x["q"].alias("q"), x["h"].alias("h"), F.slice("t", x["q"] + 1, WINDOW).alias("mine")))).alias("x"))
    pairs = own.select("doc_id", "x.*").join(items, "h").withColumn("mine", F.slice("mine", F.lit(1), F.size("raw")))
    # Rows that share a doc_id have the places of all of them.
    pairs = pairs.where(F.when(F.col("loose"), _loose("mine")).otherwise(_exact("mine")) == F.col("h"))
    zipped = F.filter(F.arrays_zip(F.col("raw").alias("a"), F.col("mine").alias("b")), lambda z: F.col("loose") & template(z["a"]).isin(*SLOTS))
    pairs = pairs.select("doc_id", "item_id", "p", "loose", "size", "loose_size", (F.col("q") - F.col("p")).alias("d"), zipped.alias("z"))
    along = Window.partitionBy("doc_id", "item_id").orderBy("d")
    pairs = pairs.withColumn("far", (F.col("d") - F.lag("d").over(along) > MAX_SHIFT).cast("int")).withColumn("band", F.coalesce(F.sum("far").over(along), F.lit(0)))
    group = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    plain = F.forall("z", lambda z: z["a"] == z["b"])
    judged = [F.when(F.col("loose"), group(kind, value)) for kind, value in (("all", F.lit(0)), ("band", F.col("band")), ("distance", F.col("d")))]
    groups = F.array(*judged, F.when(plain, group("plain", F.lit(0))))
    pairs = pairs.select("doc_id", "item_id", "p", "size", "loose_size", "z", F.explode(groups).alias("g")).where("g is not null")
    pairs = pairs.withColumn("size", F.when(F.col("g.kind") == "plain", F.col("size")).otherwise(F.col("loose_size")))
    keys = ["doc_id", "item_id", "g"]
    counts = pairs.groupBy(*keys).agg(F.countDistinct("p").alias("n"), F.max("size").alias("size"))
    values = pairs.select(*keys, F.explode("z").alias("z")).groupBy(*keys, F.col("z.a").alias("a")).agg(F.min("z.b").alias("lo"), F.max("z.b").alias("hi"))
    same = F.col("lo") == F.col("hi")
    values = values.groupBy(*keys).agg(F.count("*").alias("n_slots"), F.count_if(same).alias("n_same"), F.count_if(same & (F.col("lo") != F.col("a"))).alias("n_changed"))
    judged = counts.join(values, keys, "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
    agrees = _enough(F.col("n"), F.col("size")) & F.coalesce(F.col("n_same") >= MIN_SAME * F.col("n_slots"), F.lit(True))
    best = F.max(F.when(agrees, F.struct("n", (-F.col("n_changed")).alias("less"))))
    return judged.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best").isNotNull().alias("agrees"), (-F.col("best.less")).alias("n_changed"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
