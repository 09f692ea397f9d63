"""Quality rules from line frequencies across documents, in DataFrame functions alone.

Lines are normalised (lower case, runs of white space as one space, no space at the ends) and hashed. For each host
the documents that have a line are counted, each row once. A line of at least `min_docs` documents is boilerplate of
its host if it is in more than `max_share` of the host's documents, or in `max_docs` documents or more: the share is for
small hosts, and the second limit does not rise with the host. Boilerplate lines are removed, and a document is
rejected if less than `min_left` of its words are left, or if it fails the base rules.

Hot lines: a document names a line once, lines are counted with map-side sums, and the join with the lines above the
limits is over (host, line) hashes, where Spark splits skewed partitions. Texts are shuffled once, for the cleaned
documents only, against a small hashed side, and are not sorted. Places of lines travel, not lines, so a long text's
lines are looked up in no list.

Null text has no words and fails; null hosts form one host. Each row is a document and judged on its own, also where ids
or whole rows repeat. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import session_ready, text_or_empty

GAP = r"[\x20\x09-\x0D]+"
#: The characters between words, and those that count as symbols.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOL = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def joined_hashes(hashes: str, gap: int) -> Column:
    """The hashes of each place's entry with the one `gap` places on. `hashes` is a column, not an expression: it is
    used several times here, and doubling an expression would compute it again for each use."""
    left = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(gap + 1), left), lambda x, y: F.xxhash64(x, y))


def neighbour(array: str, i: Column, name: str) -> Column:
    return F.get(array, i)[name]


def base_rules(docs: DataFrame, text: Column) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed beside the columns of `docs`."""
    d = docs.withColumn("__text", text)
    without = lambda characters: F.char_length(F.translate("__text", characters, "")).cast("long")
    # Words are needed as hashes only. Windows of eight words get theirs by doubling: words, pairs, fours, eights.
    d = d.withColumn("__ones", F.transform(F.array_remove(F.split("__text", GAP), ""), lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("__ones").cast("long"))
    d = d.withColumn("__pairs", joined_hashes("__ones", 1))
    d = d.withColumn("__fours", joined_hashes("__pairs", 2))
    d = d.withColumn("__eights", joined_hashes("__fours", 4))
    d = d.withColumn("__again", F.size("__eights") > F.size(F.array_distinct("__eights")))
    # Sorted (hash, place) pairs show the places of repeated windows; a repeated window adds the words up to the next
    # one's beginning, eight at most. Texts without a repeated window, nearly all, are not sorted.
    pairs = F.sort_array(F.transform("__eights", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__sorted", F.when(F.col("__again"), pairs))
    like = lambda x, i: F.coalesce(neighbour("__sorted", i, "h") == x["h"], F.lit(False))
    twice = F.transform("__sorted", lambda x, i: F.when(like(x, i - 1) | like(x, i + 1), x["i"]))
    d = d.withColumn("__places", F.sort_array(F.filter(twice, lambda place: place.isNotNull())))
    step = lambda place, k: F.least(F.lit(8), F.coalesce(F.get("__places", k + 1) - place, F.lit(8)))
    covered = F.aggregate(F.transform("__places", step), F.lit(0).cast("long"), lambda total, x: total + x)
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *docs.columns,
        "n_words",
        without(SPACE).alias("word_chars"),
        (F.char_length("__text") - without(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def line_entries(docs: DataFrame, text: str) -> DataFrame:
    """Adds `entries`: for each line with words its hash (line), number in the text (place), words (n), and whether it is
    the first of its hash (fresh); by hash, then place."""
    norm = F.transform(F.split(text, "\n"), lambda x, i: F.struct(normal_line(x).alias("line"), i.alias("place")))
    some = F.filter(norm, lambda e: e["line"] != "")
    named = F.transform(some, lambda e: F.struct(F.xxhash64(e["line"]).alias("line"), e["place"].alias("place"), F.size(F.split(e["line"], " ")).alias("n")))
    d = docs.withColumn("__entries", F.sort_array(named))
    fresh = lambda e, i: F.coalesce(neighbour("__entries", i - 1, "line") != e["line"], F.lit(True)).alias("fresh")
    entries = F.transform("__entries", lambda e, i: F.struct(e["line"].alias("line"), e["place"].alias("place"), e["n"].alias("n"), fresh(e, i)))
    return d.withColumn("entries", entries).drop("__entries")


def _judge(docs: DataFrame, min_docs: int, max_share: float, max_docs: int, min_left: float, host_col: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each of `docs`: row (a hash of id, host and text), the counts, gone (places of boilerplate lines), kept."""
    session_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_or_empty(text_col).alias("text"))
    d = line_entries(d.withColumn("row", F.xxhash64("doc_id", "host", "text")), "text")
    judged = base_rules(d, F.col("text")).drop("text").checkpoint()
    lines = judged.select("doc_id", "host", "row", F.explode("entries").alias("e")).select("doc_id", "host", "row", "e.*")
    hosts = judged.groupBy("host").agg(F.count("*").alias("docs"))
    often = lines.where("fresh").groupBy("host", "line").agg(F.count("*").alias("df")).where(F.col("df") >= min_docs)
    above = often.join(hosts, often["host"].eqNullSafe(hosts["host"]))
    above = above.where((F.col("df") > max_share * F.col("docs")) | (F.col("df") >= max_docs)).select(often["host"].alias("h"), F.col("line").alias("l"))
    # A set, as equal rows name the same places.
    bad = lines.join(above, lines["host"].eqNullSafe(above["h"]) & (lines["line"] == above["l"]))
    bad = bad.groupBy(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).agg(F.collect_set(F.struct("place", "n")).alias("bad"))
    out = judged.drop("entries").join(bad, (F.col("row") == F.col("bad_row")) & F.col("doc_id").eqNullSafe(F.col("bad_id")), "left")
    lost = F.coalesce(F.aggregate("bad", F.lit(0).cast("long"), lambda total, e: total + e["n"]), F.lit(0))
    out = out.withColumn("n_words_left", F.col("n_words") - lost).withColumn("gone", F.transform("bad", lambda e: e["place"]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= min_left * F.col("n_words"))).drop("bad", "bad_id", "bad_row")


def quality_rules(
    docs: DataFrame,
    min_docs: int = 10,
    max_share: float = 0.1,
    max_docs: int = 100,
    min_left: float = 0.5,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the base counts, base_failed, n_words_left, kept; one row for each row of `docs`."""
    judged = _judge(docs, min_docs, max_share, max_docs, min_left, host_col, id_col, text_col)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept")


def clean_documents(
    docs: DataFrame,
    min_docs: int = 10,
    max_share: float = 0.1,
    max_docs: int = 100,
    min_left: float = 0.5,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The kept documents with all their columns, boilerplate lines removed from the text."""
    judged = _judge(docs, min_docs, max_share, max_docs, min_left, host_col, id_col, text_col)
    kept = judged.where("kept").select(F.col("doc_id").alias("__rules_id"), F.col("row").alias("__rules_row"), F.col("gone").alias("__rules_gone"))
    kept = kept.dropDuplicates(["__rules_row", "__rules_id"]).hint("shuffle_hash")
    same = (F.xxhash64(F.col(id_col), F.col(host_col), text_or_empty(text_col)) == F.col("__rules_row")) & F.col(id_col).eqNullSafe(F.col("__rules_id"))
    joined = docs.join(kept, same).withColumn("__rules_lines", F.when(F.col("__rules_gone").isNotNull(), F.split(text_col, "\n")))
    places = F.array_except(F.sequence(F.lit(0), F.size("__rules_lines") - 1), "__rules_gone")
    left = F.array_join(F.transform(places, lambda i: F.get("__rules_lines", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__rules_gone").isNotNull(), left).otherwise(F.col(text_col))).select(*[f"`{c}`" for c in docs.columns])


#: The same rules for DuckDB, over the table `documents`; r names a row.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times
            FROM (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS g
                  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w))),
again AS (SELECT r, sum(n) AS n_repeat_words
          FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM windows WHERE times > 1)
          GROUP BY r),
lines AS (SELECT r, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
above AS (SELECT l.host, l.norm FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
          GROUP BY l.host, l.norm, h.docs
          HAVING count(DISTINCT r) >= 10 AND (count(DISTINCT r) > 0.1 * h.docs OR count(DISTINCT r) >= 100)),
lost AS (SELECT l.r, sum(l.n) AS lost FROM lines l JOIN above a ON l.host IS NOT DISTINCT FROM a.host AND l.norm = a.norm GROUP BY l.r),
base AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                CAST(len(words) - coalesce(lost, 0) AS BIGINT) AS n_words_left
         FROM w LEFT JOIN dups USING (r) LEFT JOIN again USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_words_left,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= 0.5 * n_words) AS kept
FROM base
"""
