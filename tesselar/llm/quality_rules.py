"""Quality rules on whole documents, in DataFrame functions only.

Base rules: at least 50 words, and at most half of the words inside repeated three-word windows.  The method's
verdict: the Jensen-Shannon distance (base 2, 0 to 1) of a document's character-class and common-word
histograms to those of its language, each judged only above a minimum length.  The references are sums over all
documents of the language.

Scale: features are computed once, inside each row, with no shuffle; they are written as a narrow table, from
which the references (at most one row per language of COMMON_WORDS) are summed and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import WHITE, stored

# Frequent function words per language.
COMMON_WORDS: dict[str, list[str]] = {
    "en": "the of and to in a is that for it as was with on be by at this are from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con una su para es al como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
}
# Limits of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.275
CLASSES = ("lower", "upper", "other", "digit", "white", "symbol", "punct")


def _removed(text: Column, pattern: str) -> Column:
    """How many code points of text match the character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _windows(words: Column, n: Column, of: object) -> Column:
    """`of` the three words of each window of a text of n words."""
    found = F.transform(F.sequence(F.lit(0), n - 3), lambda i: of(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, found)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_row: bool = False) -> DataFrame:
    """id, lang and the counts of every document; null text counts as no words.  with_row adds the input row as a struct."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_row else []
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col)
    df = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("t"), *row)
    row = ["row"] if with_row else []
    df = df.withColumn("w", F.filter(F.split("t", WHITE + "+"), lambda x: x != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n", F.size("w"))
    df = df.withColumn("grams", _windows(F.col("w"), F.col("n"), F.xxhash64))
    # hashes only tell texts in which no window can repeat
    df = df.withColumn("again", F.coalesce(F.size("grams") > F.size(F.array_distinct("grams")), F.lit(False)))
    # (window, place) pairs in order: a window repeats if a neighbour equals it; words hold no space
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    pairs = F.when(F.col("again"), F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    df = df.withColumn("pairs", pairs)
    same = lambda x, j, k: x["h"].eqNullSafe(F.get(F.col("pairs"), j + k)["h"])
    places = F.filter("pairs", lambda x, j: same(x, j, 1) | (same(x, j, -1) & (j > 0)))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    common = F.filter("w", lambda x: x.isin(sorted({w for ws in COMMON_WORDS.values() for w in ws})))
    df = df.withColumn("common", common)
    counts = F.lit(None).cast("array<int>")
    for code, listed in COMMON_WORDS.items():
        per_word = F.transform(F.array(*map(F.lit, listed)), lambda k: F.size(F.filter("common", lambda x: x == k)))
        counts = F.when(lang == code, per_word).otherwise(counts)
    df = df.select(
        "id", "lang", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars"),
        _removed(F.col("t"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        _removed(F.col("t"), "[A-Z]+").cast("long").alias("upper"),
        _removed(F.col("t"), r"[^\x00-\x7F]+").cast("long").alias("other"),
        _removed(F.col("t"), "[0-9]+").cast("long").alias("digit"),
        _removed(F.col("t"), r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]+").cast("long").alias("punct"),
        counts.alias("listed"), *row,
    )
    df = df.withColumn("white", F.col("n_chars") - F.col("word_chars")).withColumn("symbol", F.col("n_symbols"))
    rest = [F.col(c) for c in CLASSES[1:]]
    df = df.withColumn("lower", F.col("n_chars") - sum(rest[1:], rest[0]))
    others = F.col("n_words") - F.aggregate("listed", F.lit(0), lambda a, x: a + x)
    return df.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        F.array(*[F.col(c) for c in CLASSES]).alias("chars"),
        F.when(F.col("listed").isNotNull(), F.concat(F.col("listed").cast("array<bigint>"), F.array(others))).alias("common"), *row,
    )


def references(found: DataFrame) -> DataFrame:
    """The summed histograms of each language of COMMON_WORDS: at most len(COMMON_WORDS) rows."""
    wide = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(wide)]
    rows = found.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums)
    full = lambda p, k: F.filter(F.array(*[F.col(f"{p}{i}") for i in range(k)]), lambda x: x.isNotNull())
    return rows.select("lang", full("c", len(CLASSES)).alias("ref_chars"), full("w", wide).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if either sums up to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(terms)))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(bounded))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and the distances class_distance and word_distance (null where not judged).

    Null and empty texts have no words and fail the base rules.  A document whose language is null or has no
    reference, or that is shorter than a minimum length, isn't judged by that histogram.  Repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    found = stored(features(docs, id_col, text_col, lang_col), "quality-features")
    return judged(found, references(found)).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; rows are judged one by one."""
    found = stored(features(docs, id_col, text_col, lang_col, with_row=True), "quality-features")
    return judged(found, references(found)).where("kept").select("row.*")


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """found with base_failed, kept and the distances."""
    df = found.join(F.broadcast(refs), "lang", "left")
    df = df.withColumn("class_distance", F.when(F.col("n_chars") >= MIN_CLASS_CHARS, js_distance(F.col("chars"), F.col("ref_chars"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_COMMON_WORDS, js_distance(F.col("common"), F.col("ref_common"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    close = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return df.withColumns({"base_failed": failed, "kept": ~failed & close})
