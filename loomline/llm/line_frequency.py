"""Quality rules over words and lines, and the cross-document line frequency filter.

Everything on the path is a DataFrame function. A line is normalised (lower
case, runs of ASCII white space to one space, trimmed) and hashed to 64 bits;
per host the distinct documents of a line are counted, documents of equal text
counting once, so that plain copies are left to de-duplication. Lines found in
more than `max_documents` are removed, and a document is depleted if less than
`min_kept` of its words is left.

Defined results: null text has no words or lines and fails the base rule; a
null host is a host of its own; repeated rows are one document with equal
results; an empty table gives an empty table. Only the needed columns are read,
so extra columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import SPACES, let, materialise

WINDOW = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """The 64-bit hash of each window of five words; none for shorter texts."""
    at = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    starts = lambda w: F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(starts(w), lambda i: at(w, i)))


def repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, the first one included.

    Windows are sorted by hash; those with an equal neighbour repeat. In order of
    position each covers five words, or as many as lie before the next one.
    """
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    equal = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    found = let(ranked, lambda s: F.filter(s, lambda x, k: equal(s, k - 1, x) | equal(s, k + 1, x)))
    places = F.sort_array(F.transform(found, lambda x: x["p"]))
    covered = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, host, the five word and line counts and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    staged = docs.select("doc_id", F.col("source").alias("host"), text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    staged = staged.withColumn("_hashes", window_hashes(F.col("_words"))).withColumn("_lines", lines)
    none_twice = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    counted = staged.select(
        "doc_id",
        F.xxhash64("_text").alias("text_key"),
        "host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(none_twice, F.lit(0).cast("long")).otherwise(repeated_words(F.col("_hashes"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per document, host and normalised line with a word: its hash and the words in all its occurrences, over all rows of the document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    exploded = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_key"), F.explode(F.split(text, "\n")).alias("_line"))
    exploded = exploded.withColumn("line", F.trim(F.lower(F.regexp_replace("_line", f"[{SPACES}]+", " ")))).filter("line <> ''")
    hashed = exploded.select("doc_id", "host", "text_key", F.xxhash64("line").alias("line_key"), F.regexp_count("line", F.lit(f"[^{SPACES}]+")).alias("w"))
    return hashed.groupBy("doc_id", "host", "text_key", "line_key").agg(F.sum("w").alias("line_words"))


def repeated_rows(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key and number of rows of the rows that occur more than once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    same = docs.groupBy("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_key")).agg(F.count("*").alias("rows"))
    return same.filter("rows > 1")


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """host, line_key of the lines in more than max_documents distinct documents of the host."""
    once = lines.select("host", "line_key", "text_key").distinct()
    return once.groupBy("host", "line_key").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") > max_documents)


def quality_by_lines(docs: DataFrame, max_documents: int = 20, min_kept: float = 0.3) -> DataFrame:
    """The base counts, removed_words, and kept: base rules passed and not depleted."""
    lines = materialise(document_lines(docs))
    # written, so that the join deals out both sides itself and adaptive execution can split a hot line
    frequent = materialise(frequent_lines(lines, max_documents).select(F.col("host").alias("f_host"), F.col("line_key").alias("f_key")))
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line_key") == F.col("f_key")))
    lost = hit.groupBy(F.col("doc_id").alias("l_doc"), F.col("text_key").alias("l_text"), F.col("host").alias("l_host")).agg(F.sum("line_words").alias("removed"))
    # lines of repeated rows (equal id, host and text) are summed together: each row has its share of them
    again = materialise(repeated_rows(docs))
    if not again.isEmpty():
        each = again.select(*[F.col(c).alias("a_" + c) for c in ("doc_id", "host", "text_key", "rows")])
        one = F.col("l_doc").eqNullSafe(F.col("a_doc_id")) & F.col("l_host").eqNullSafe(F.col("a_host")) & (F.col("l_text") == F.col("a_text_key"))
        lost = lost.join(each, one, "left").select("l_doc", "l_text", "l_host", (F.col("removed") / F.coalesce("a_rows", F.lit(1))).cast("long").alias("removed"))
    same = F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("text_key") == F.col("l_text")) & F.col("host").eqNullSafe(F.col("l_host"))
    joined = base_rules(docs).join(lost, same, "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    left = (F.col("n_words") - F.col("removed_words")) >= F.lit(min_kept) * F.col("n_words")
    return joined.withColumn("kept", ~F.col("base_failed") & left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


#: DuckDB SQL of quality_by_lines with its default parameters, over lines themselves instead of their hashes.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
      FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS j FROM p, (VALUES (0), (1), (2), (3), (4)) v(k)) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
f AS (SELECT source, k FROM lw JOIN d USING (r) GROUP BY source, k HAVING count(DISTINCT text) > 20),
lost AS (SELECT r, sum(n) AS n FROM lw JOIN d USING (r) JOIN f ON f.k = lw.k AND f.source IS NOT DISTINCT FROM d.source GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 0.3::DOUBLE * n_words AS kept, removed_words
FROM b
"""
