"""Line-first quality rules (native): only built-in functions, one pass, no shuffle.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document is rejected when the lines removed held more than `max_loss` of its characters, or when a base
rule fails (under 50 words, or over half of its words in repeated 3-word windows).

Null or empty text: no words, base_failed, not kept. Very long texts: n log n in the words of one
document. Repeated rows are judged alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WS, WS_RE, let

SYMBOL = "[^#*$%&|<>]+"
#: A word's position takes so many bits of a sort key, the rest holds its hash.
POS_BITS = 24
NAVIGATION = "(?i)^\\W*(?:home|menu|log ?in|sign ?(?:in|up)|next|previous|back|search|contact(?: us)?|about(?: us)?|share|read more|skip to [a-z ]+)\\W*$"
BOILERPLATE = "(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|lorem ipsum|click here|subscribe to our|copyright (?:\\(c\\)|©|\\d{4})|spdx-license-identifier"
#: What a line may end with: the marks of Latin, Chinese and Japanese, Indic, Arabic, Ethiopic, Khmer, Burmese and Tibetan writing; Thai and Lao have none, so there any letter.
TERMINAL = "[.!?…:;\"'”’»)\\]。！？：；」』）】।॥؟۔؛።។៕။།ก-๛ກ-ໟ]\\s*$"
#: A line may break off after whole sentences. Some scripts put no space after them.
SENTENCES = "[.!?…؟۔।።]\\s|[。！？]"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RE))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails: a symbol in every third word or so, shouting, lists of links, boilerplate, or no end."""
    n = F.length(line)
    symbols = F.length(F.regexp_replace(line, SYMBOL, ""))
    bars = n - F.length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = (n - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        (bars >= 4)
        | (symbols * 20 > n)
        | (shouts >= 3)
        | (F.upper(line) == line) & (n >= 20) & (F.lower(line) != line)
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
        | ~line.rlike(TERMINAL) & ~line.rlike(SENTENCES)
    )


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows at these sorted positions."""
    return F.aggregate(
        F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1), p + 3) - p)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def judged(docs: DataFrame, max_loss: float = 0.5, whole: bool = False) -> DataFrame:
    """Base counts, the method's verdict and the cleaned text of every row of docs(doc_id, text); with whole, the row's other
    columns too, as one struct `row` that no name can clash with."""
    mask = (1 << POS_BITS) - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    a = docs.select("doc_id", text.alias("text"), *([F.struct(*rest).alias("row")] if whole else [])).withColumns({"words": words_of(F.col("text")), "lines": F.split("text", "\n")})
    w = F.col("words")
    a = a.withColumns({"n_words": F.size(w).cast("long"), "filled": F.filter("lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POS_BITS).bitwiseOR(i.cast("long")))
    a = a.withColumn("packed", F.sort_array(packed))
    s = F.col("packed")
    top = lambda x: F.shiftright(x, POS_BITS)
    a = a.withColumn("twice", F.filter(s, lambda x, i: (top(x) == top(F.get(s, F.when(i > 0, i - 1).otherwise(F.size(s))))) | (top(x) == top(F.get(s, i + 1)))))
    # The bits of a hash may agree by chance: compare the words themselves, and sort by them where they differ.
    t = F.col("twice")
    at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    same = lambda p, q: (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
    clash = F.coalesce(F.exists(F.transform(t, lambda x, i: F.when((i > 0) & (top(x) == top(F.get(t, F.greatest(i - 1, F.lit(0))))), ~same(at(x), at(F.get(t, F.greatest(i - 1, F.lit(0))))))), lambda x: x), F.lit(False))
    quick = let(F.sort_array(F.transform(t, at)), _covered)
    exact = let(
        F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))),
        lambda g: let(
            F.sort_array(F.transform(F.filter(g, lambda x, i: (x["g"] == F.get(g, F.when(i > 0, i - 1).otherwise(F.size(g)))["g"]) | (x["g"] == F.get(g, i + 1)["g"])), lambda x: x["i"])),
            _covered,
        ),
    )
    fits = F.size(w) <= mask
    chars = lambda lines: F.length(F.array_join(lines, ""))
    a = a.withColumns({
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("text", SYMBOL, "")).cast("long"),
        "n_dup_lines": (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long"),
        "n_repeat_words": F.when(F.size(t) == 0, F.lit(0).cast("long")).when(fits & ~clash, quick).otherwise(exact),
        "good": F.filter("lines", lambda x: ~line_fails(x) | ~x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    a = a.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "loss": F.when(chars(F.col("lines")) == 0, 1.0).otherwise(1 - chars(F.col("good")) / chars(F.col("lines"))),
        "n_lines_removed": (F.size("lines") - F.size("good")).cast("long"),
    })
    return a.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= max_loss))


def clean_documents(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """docs without the rejected rows, in their own columns, the failing lines of the others removed.

    Null, empty and blank texts are rejected; repeated rows stay repeated; an empty table stays empty; other columns,
    whatever their names and nulls, come back as they were, but for n_chars, the length of the new text.
    """
    # The row number keeps the optimizer from moving the filter into the expressions above, which it would multiply.
    kept = judged(docs, max_loss, True).withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0")
    text = F.array_join("good", "\n")
    return kept.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", F.round("loss", 6).alias("loss"))
