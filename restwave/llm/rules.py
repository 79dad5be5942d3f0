"""Quality rules made of DataFrame functions: text statistics, and lines that many documents of a host share.

Statistics stay within a row. For the lines, each document's distinct normalised lines are hashed; a line's
distinct documents on its host are counted (copies of a text are one document), and a line above the limit,
which does not rise with the host, is removed from every document but the host's first that has it. A document that loses too much is rejected.
Hot lines and hosts are counted with map-side combining on (host, line, text); the removal join sends only
hashes and has AQE split a hot line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restwave.llm.common import SPACE, row_struct, with_outputs

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: A line is removed if it is in more documents of its host than LINE_DOCS; one of up to SHORT_WORDS words, which
#: may recur by nature, also needs more than SHORT_DOCS or more than this share of the host's texts.
LINE_DOCS, LINE_SHARE, SHORT_WORDS, SHORT_DOCS = 4, 0.02, 2, 20
#: A document is rejected if removal leaves it fewer words than MIN_WORDS or less than this part of them.
MIN_LEFT = 0.5
OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "kept_text"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    spaced = F.translate(text, SPACE, " " * len(SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def split_lines(text: Column) -> Column:
    """\\n-split lines that hold a word, in order."""
    return F.filter(F.split(text, "\n"), has_word)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal_line(line: Column) -> Column:
    """Lower case, white space trimmed and runs of it one space."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that are found twice or more among the words."""

    def at(i: Column, j: int, w: Column) -> Column:
        return F.get(w, i + F.lit(j))

    def positions(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - F.lit(size))

    def hashed(w: Column) -> Column:
        return F.transform(positions(w), lambda i: F.xxhash64(*[at(i, j, w) for j in range(size)]))

    def exact(w: Column) -> Column:
        # equal neighbours among sorted (window, place) pairs; no word holds a space, so the join is exact
        pairs = F.sort_array(F.transform(positions(w), lambda i: F.struct(
            F.concat_ws(" ", *[at(i, j, w) for j in range(size)]).alias("s"), i.alias("i"))))

        def twice(p: Column) -> Column:
            def same(k: Column, step: int) -> Column:
                return F.coalesce(F.get(p, k)["s"] == F.get(p, k + F.lit(step))["s"], F.lit(False))

            places = F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - F.lit(1)), lambda k: F.when(k > 0, same(k, -1)).otherwise(False) | same(k, 1)),
                                 lambda k: F.get(p, k)["i"])
            return let(F.sort_array(places), covered)

        return let(pairs, twice)

    def covered(places: Column) -> Column:
        # a window adds what lies before the next one's first word, `size` at most
        return F.aggregate(places, F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n")),
                           lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(size))).cast("long").alias("n")),
                           lambda s: s["n"])

    def counted(w: Column) -> Column:
        distinct = let(hashed(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) <= size, F.lit(0).cast("long")).when(distinct, F.lit(0).cast("long")).otherwise(exact(w))

    return let(words, counted)


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long); null counts as empty."""

    def count(text: Column, characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")

    def of(t: Column) -> Column:
        words = split_words(t)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"), count(t, SYMBOLS).alias("n_symbols"),
            let(split_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"))

    return let(F.coalesce(text, F.lit("")), of)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] | None = None,
                  line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The columns `keep` of docs (all, if None) with the statistics, base_failed, removed_words, kept and
    kept_text (the text without removed lines).

    base_failed: fewer than 10 words, or over 20 % of them in repeated five-word windows. Null and blank texts
    have no words and fail. A null host is a host of its own; a null id comes after every id, so with no id at
    all a frequent line goes from every row. Rows equal in id and text share their fate. Empty table: empty
    result. Input columns named like an output give way to it.
    """
    text = docs[text_col].cast("string")
    own = row_struct(docs, keep)
    marked = docs.select(own.alias("row"), text.alias("text"), docs[id_col].cast("long").alias("id"),
                         docs[host_col].cast("string").alias("host"), F.xxhash64(text, F.lit(1)).alias("digest"))
    lines = marked.select("host", "id", "digest", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(has_word(F.col("line"))).select(
        "host", "id", "digest", "place", F.xxhash64(normal_line(F.col("line"))).alias("hash"), F.size(split_words(F.col("line"))).alias("words"))
    per_line = lines.groupBy("host", "hash").agg(F.count_distinct("digest").alias("n"), F.min("id").alias("first"), F.min("words").alias("words"))
    hosts = marked.groupBy("host").agg(F.count_distinct("digest").alias("all")).withColumnRenamed("host", "at_host")
    frequent = (per_line.where(F.col("n") > line_docs)
                .join(hosts, F.col("host").eqNullSafe(F.col("at_host"))).where(
                    (F.col("words") > SHORT_WORDS) | (F.col("n") > SHORT_DOCS) | (F.col("n") > F.lit(line_share) * F.col("all")))
                .select(F.col("host").alias("f_host"), F.col("hash").alias("f_hash"), "first"))
    # places and words of a text's removed lines; a set, as equal rows have equal lines
    gone = (lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("hash") == F.col("f_hash")))
            .where(~F.col("id").eqNullSafe(F.col("first")) | F.col("first").isNull())
            .groupBy(F.col("host").alias("g_host"), F.col("id").alias("g_id"), F.col("digest").alias("g_digest"))
            .agg(F.collect_set(F.struct("place", "words")).alias("gone")))
    joined = marked.withColumn("s", text_statistics(F.col("text"))).join(
        gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("digest") == F.col("g_digest")) & F.col("host").eqNullSafe(F.col("g_host")), "left")
    kept_lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone.place"), i))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    words, left = F.col("s.n_words"), F.col("s.n_words") - F.col("removed_words")
    return with_outputs(
        joined.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
        .withColumn("removed_words", F.coalesce(removed, F.lit(0).cast("long")))
        .withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > MAX_REPEAT_PERCENT * words))
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * words))
        .select("row", "s.*", "base_failed", "removed_words", "kept", "kept_text"), "row", OUTPUTS)
