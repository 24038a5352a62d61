"""Posting lists of character trigrams: substring search that looks at few texts.

A text that contains a pattern contains every trigram of the pattern's literal parts, so
the texts in all of their posting lists are the only ones that LIKE need look at. % and
_ are wildcards, and what they cut off into parts of fewer than three characters asks
for nothing; a pattern without any trigram is looked for everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import LOWER, UPPER, ascii_lower, like_folded

SIZE = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, ASCII letters lowered; none for null and shorter texts.

    A text is folded and taken apart once, so that the work grows with its length.
    """
    places = F.sequence(F.lit(0), F.length(text) - SIZE)
    of = lambda chars: F.transform(places, lambda i: F.concat(*(chars[i + k] for k in range(SIZE))))
    found = F.transform(F.array(F.split(ascii_lower(text), "")), of)[0]  # the lambda's argument is computed once a row
    return F.when(F.length(text) >= SIZE, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """gram and key, sorted by gram within tasks, so that a reader passes over row groups by their least and greatest gram.

    The order of code points is that of UTF-8; as one number a gram is sorted without comparing strings.
    """
    place = F.lit(0).cast("long")
    for k in range(1, SIZE + 1):
        place = F.shiftleft(place, 21).bitwiseOR(F.ascii(F.substr("gram", F.lit(k), F.lit(1))).cast("long"))
    return rows.select(F.explode(grams(F.col(text))).alias("gram"), key).sortWithinPartitions(place)


def grams_of_query(query: str) -> list[str]:
    parts = re.split("[%_]", query.translate(str.maketrans(UPPER, LOWER)))
    return sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})


def candidates(index: DataFrame, key: str, query: str) -> DataFrame | None:
    """The keys in the posting lists of all of a query's trigrams; None if it has none, and any text may match.

    A list holds a key once, so keys are counted, list by list and partly before the
    shuffle, instead of being joined.
    """
    wanted = grams_of_query(query)
    if not wanted:
        return None
    listed = index.filter(F.col("gram").isin(wanted)).groupBy(key).agg(F.count("*").alias("_lists"))
    return listed.filter(F.col("_lists") == len(wanted)).select(key)


def matching(rows: DataFrame, key: str, text: str, query: str, index: DataFrame, index_key: str) -> DataFrame:
    """the rows whose text contains the query, through the index of these rows."""
    found = candidates(index, index_key, query)
    if found is not None:
        rows = rows.join(found.withColumnRenamed(index_key, key), key, "left_semi")
    return rows.filter(like_folded(F.col(text), query))
