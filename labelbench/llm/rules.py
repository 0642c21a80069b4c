"""Line-first quality rules (native).

Every line is judged on its own: symbols, shouting, missing end punctuation, navigation and
boilerplate.  Failing lines are removed, and a document that loses too many of its words by
that is rejected.  Everything is an expression over one row, so there is no shuffle at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, as_docs, let, n_words

# Fixed by the contract.
SYMBOLS = "#*$%&|<>"
GRAM = 5
# Own rules.
END_MARKS = ".!?:;…。！？\"'”’»)]"
SURE = ("lorem ipsum",)  # boilerplate whatever else the line says
SIGNS = ("javascript", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe", "newsletter", "all rights reserved",
         "your browser", "accept all", "click here", "copyright")  # two of them in a line
NAVIGATION = r"(?i)^\W*(home|about( us)?|contact( us)?|log ?in|sign (in|up)|menu|next|previous|back to top|read more|share this)\W*$"
SEPARATORS = "|»›>•·"
SHOUT = "!!"


def is_boilerplate(line: Column) -> Column:
    """A sure phrase, or two different signs: one alone is a word of ordinary prose."""
    return let(F.lower(line), lambda x: reduce(Column.__or__, [x.contains(p) for p in SURE])
               | (reduce(Column.__add__, [x.contains(p).cast("int") for p in SIGNS]) >= 2))


def line_fails(line: Column, phrases: Column) -> Column:
    """Whether a line with words fails; a line without words never does (it has nothing to lose).

    The rules: its last character is no end mark; more than 3 symbols or 3 double exclamation marks to 10 words;
    three separators; a navigation line of any length; boilerplate.  Tests that need counts come
    behind a cheap test for the characters they count; ``phrases`` tells whether the whole text
    has a phrase of boilerplate anywhere.
    """
    def judge(x: Column) -> Column:
        no_end = F.instr(F.lit(END_MARKS), F.substring(x, -1, 1)) == 0
        symbols = x.rlike(f"[{SYMBOLS}]") & (10 * (F.length(x) - F.length(F.translate(x, SYMBOLS, ""))) > 3 * n_words(x))
        shouts = x.contains(SHOUT) & (10 * (F.length(x) - F.length(F.replace(x, F.lit(SHOUT), F.lit("")))) > 3 * n_words(x))
        separators = x.rlike(rf"[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}]")
        return (x != "") & (no_end | symbols | shouts | separators | x.rlike(NAVIGATION) | (phrases & is_boilerplate(x)))

    return let(F.btrim(line, F.lit(SPACES)), judge)


def repeat_words(words: Column) -> Column:
    """Words covered by a 5-word window that the text holds twice or more, the first included.

    Hashes of the windows only tell texts without a repeat apart (equal windows have equal
    hashes); where two hashes meet, the windows themselves are sorted with their positions.
    """
    def gram(w: Column, i: Column) -> Column:
        return F.array_join(F.slice(w, i, GRAM), " ")

    def covered(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - (GRAM - 1)), lambda i: F.struct(gram(w, i).alias("g"), i.alias("i")))
        sort = F.array_sort(pairs)
        hits = let(sort, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))))
        at = F.sort_array(F.transform(hits, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + i + GRAM - F.greatest(i, a["end"])).alias("n"), (i + GRAM).alias("end")),
                           lambda a: a["n"])

    def of(w: Column) -> Column:
        n = F.size(w) - (GRAM - 1)
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(GRAM)]))
        return F.when(n < 2, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(covered(w))

    return let(words, of)


def clean_lines(docs: DataFrame, max_lost: float = 0.3, min_words: int = 10, max_repeat: float = 0.2) -> DataFrame:
    """(doc_id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost, base_failed, kept).

    ``clean_text`` holds the lines that pass; ``n_lost`` counts the words of the others.  A
    document is kept unless it has fewer than ``min_words`` words, more than ``max_repeat`` of its
    words lie in repeated windows, or more than ``max_lost`` of them are lost.  Null, empty and
    white texts: no words, all counts 0, base_failed.  Repeated rows are judged one by one, a null
    doc_id stays null, an empty table gives no row.  A very long text is judged whole: its words and
    window hashes are arrays of one row, so a row's memory grows with its longest text.
    """
    rows = as_docs(docs, "doc_id", "text").withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    lines = F.split("t", "\n", -1)
    worded = let(F.filter(lines, has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # a text without a sure phrase and without two signs has no line of boilerplate
    good = let(is_boilerplate(F.col("t")), lambda any_phrase: F.array_join(F.filter(lines, lambda x: ~line_fails(x, any_phrase)), "\n"))
    rows = rows.select(
        "doc_id", good.alias("clean_text"), n_words(F.col("t")).alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        worded.cast("bigint").alias("n_dup_lines"),
        repeat_words(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).cast("bigint").alias("n_repeat_words"))
    rows = rows.withColumn("n_lost", F.col("n_words") - n_words(F.col("clean_text")))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") <= max_lost * F.col("n_words")))
