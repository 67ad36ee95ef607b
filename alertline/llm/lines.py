"""Quality rules that clean lines first: failing lines go, then documents that lost too much text.

All is column expressions; a document is worked on in its own row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertline.llm.text import SPACES, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_SHARE = 0.3
MIN_SEPARATORS = 2
MAX_SYMBOLS_PER_WORD = 0.3
SHOUTED_WORDS = 3
SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 3
POSITION_BITS = 24

# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
)

_SENTENCE_END = r"[.!?…。！？؟।][\"'”’»)\]]*(\s|$)"
_SEPARATORS = r"[|»›•·]|->|>>"


def failing(line: Column) -> dict[str, Column]:
    """The rules of a line; one that holds is enough to remove it."""
    n = F.greatest(F.size(words(line)), F.lit(1))
    shouted = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return {
        "punctuation": ~line.rlike(_SENTENCE_END),
        "navigation": F.regexp_count(line, F.lit(_SEPARATORS)) >= MIN_SEPARATORS,
        "symbols": F.regexp_count(line, F.lit(SYMBOLS)) > MAX_SYMBOLS_PER_WORD * n,
        "shouting": shouted & (n >= SHOUTED_WORDS),
        "boilerplate": F.lower(line).rlike("|".join(BOILERPLATE)),
    }


def _word_chars(text: Column) -> Column:
    return F.char_length(F.array_join(words(text), "")).cast("long")


def clean_lines(docs: DataFrame, max_lost_share: float = MAX_LOST_SHARE) -> DataFrame:
    """Add ``cleaned`` (the text of the lines that stay), ``lost_share`` and ``lines_kept`` (the verdict).

    Lines are cut at line feeds. A line without a word, one equal to an earlier line, and one that a rule
    of ``failing`` hits is removed. ``lost_share`` counts characters of words. A null or empty text, or
    one without words, has lost nothing, and an empty ``cleaned``. Columns of these names are replaced;
    names that start with an underscore are the function's own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_lines", F.array_distinct(F.split(text, "\n")))

    def stays(line: Column) -> Column:
        bad = F.lit(False)
        for rule in failing(line).values():
            bad = bad | rule
        return line.rlike("[^" + SPACES[1:]) & ~bad

    docs = docs.withColumn("cleaned", F.array_join(F.filter("_lines", stays), "\n")).drop("_lines")
    docs = docs.withColumn("_all", _word_chars(text)).withColumn("_left", _word_chars(F.col("cleaned")))
    lost = F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(1 - F.col("_left") / F.col("_all"))
    docs = docs.withColumn("lost_share", lost).drop("_all", "_left")
    return docs.withColumn("lines_kept", F.col("lost_share") <= max_lost_share)


def with_base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least twice in the text. Windows
    are compared by 64-bit hashes. To find them, the first bits of each hash and its position are packed
    in one number and sorted; only neighbours with the same bits are compared in full. A null text has no
    words and no lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_words", words(text))
    docs = docs.withColumn("n_words", F.size("_words").cast("long"))
    docs = docs.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    docs = docs.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    docs = docs.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^" + SPACES[1:])))
    docs = docs.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    docs = docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines")
    hashes = F.col("_hashes")
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW_WORDS - 1), F.lit(0)))
    docs = docs.withColumn(
        "_windows", F.transform(firsts, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    ).drop("_hashes")
    windows = F.col("_windows")
    packed = F.transform(windows, lambda x, i: x.bitwiseAND(F.lit(-(1 << POSITION_BITS))).bitwiseOR(i.cast("long")))
    docs = docs.withColumn("_packed", F.sort_array(packed))
    sorted_ = F.col("_packed")

    def bits(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def alike(x: Column, i: Column) -> Column:
        before = F.when(i > 0, bits(F.get(sorted_, i - 1)) == bits(x))
        return F.coalesce(before, F.lit(False)) | F.coalesce(bits(F.get(sorted_, i + 1)) == bits(x), F.lit(False))

    some = F.transform(
        F.filter(sorted_, alike), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    )
    every = F.sequence(F.lit(0), F.size(windows) - 1)
    none = F.array().cast("array<int>")
    places = F.when(F.size(windows) == 0, none).when(F.size(windows) >= 1 << POSITION_BITS, every).otherwise(some)
    docs = docs.withColumn("_places", places).drop("_packed")
    pairs = F.transform("_places", lambda p: F.struct(F.get(windows, p).alias("h"), p.alias("p")))
    docs = docs.withColumn("_pairs", F.sort_array(pairs)).drop("_windows", "_places")
    found = F.col("_pairs")

    def repeated(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(found, i - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False))

    docs = docs.withColumn("_repeated", F.sort_array(F.transform(F.filter(found, repeated), lambda x: x["p"])))
    again = F.col("_repeated")
    reach = F.transform(
        again, lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(again, i + 1) - p, F.lit(WINDOW_WORDS)))
    )
    docs = docs.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long"))
    return docs.drop("_pairs", "_repeated")


def quality_verdict(docs: DataFrame) -> DataFrame:
    """Add the base counts, ``base_failed``, the columns of ``clean_lines``, and ``kept``.

    Reads ``text``; every row stays. Null and empty texts have no words and fail the base rule. Rows that
    repeat an id are judged each for itself, and columns of the names added are replaced.
    """
    docs = clean_lines(with_base_counts(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return docs.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("lines_kept"))
