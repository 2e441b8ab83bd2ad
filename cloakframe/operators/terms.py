"""Terms of a dictionary in texts, found by joins: a positional index, and words that are one edit away.

The cost of the index follows the words of the texts and the number of
different lengths of terms, not the number of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words as \\b bounds them, and what is between.
_SEGMENT, _WORD = "[a-z0-9_]+|[^a-z0-9_]+", "^[a-z0-9_]"
BROADCAST = 20_000  # terms that go to all tasks; a larger dictionary is joined by its shuffled terms
LONGEST = 64  # code points of a term that may have all its neighbours of one edit as keys


def segments(text: Column) -> Column:
    """Words and what is between them, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SEGMENT), F.lit(0))


def _small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """The dictionary, with a hint if it is counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """key, position (of the term's first segment, from 0) and the columns of the dictionary, for each place of each term.

    A term matches as a whole, with just the separators it has, where words begin and end; it must begin and end with a
    word. Terms are taken lower-cased; empty ones match nothing. Repeated rows of the dictionary count each.
    """
    known = terms.withColumn("__term", F.lower(F.col(term))).withColumn("__n", F.size(segments(F.col(term)))).where(F.col("__term").rlike(_WORD) & F.col("__term").rlike("[a-z0-9_]$"))
    lengths = sorted(r[0] for r in known.select("__n").distinct().collect())  # at most the words of the longest term
    if not lengths:
        return df.select(F.col(key).alias("key"), F.lit(0).alias("position")).join(terms, F.lit(False)).limit(0)
    # A generator of one row keeps Spark from putting the split into the lambdas that use it.
    rows = df.select(F.col(key).alias("key"), F.inline(F.array(F.struct(segments(F.col(text)).alias("__s")))))
    first = F.when(F.get("__s", F.lit(0)).rlike(_WORD), 1).otherwise(2)  # words and separators take turns
    begins = F.when(F.size("__s") >= first, F.sequence(first, F.size("__s"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    # Terms of each place are made in the row, so that its segments are not copied for each of them.
    def grams_of(n: int) -> Column:
        fit = F.filter(begins, lambda i: i + n - 1 <= F.size("__s"))
        return F.transform(fit, lambda i: F.struct((i - 1).alias("position"), F.concat(*(F.get("__s", i + j - 1) for j in range(n))).alias("__gram")))

    made = F.concat(*map(grams_of, lengths))
    grams = rows.select("key", F.explode(made).alias("g")).select("key", "g.*")
    return grams.join(_small(known), F.col("__gram") == F.col("__term")).drop("__gram", "__term", "__n")


def counts(df: DataFrame, key: str, text: str, terms: DataFrame, category: str, categories: list[str]) -> DataFrame:
    """key and a count of places for each category, for every row of the table (rows of one key together)."""
    found = postings(df, key, text, terms.select("term", F.col(category).alias("__category")))
    per = found.groupBy("key").agg(*(F.count_if(F.col("__category") == c).alias(c) for c in categories)).withColumnRenamed("key", "__key")
    keys = df.select(F.col(key).alias("key")).distinct()
    return keys.join(per, F.col("key").eqNullSafe(F.col("__key")), "left").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in categories))


def losses(df: DataFrame, key: str, before: str, after: str, terms: DataFrame) -> DataFrame:
    """key, term, n_before, n_after of the terms that stand less often in the text after than before."""
    sides = [postings(df, key, c, terms.select("term").distinct()).select("key", "term", *(F.lit(int(c == d)).alias(n) for d, n in ((before, "b"), (after, "a")))) for c in (before, after)]
    both = sides[0].unionByName(sides[1]).groupBy("key", "term").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return both.where("n_after < n_before")


def neighbours(word: Column) -> Column:
    """Hashes of the word and of the word without each of its code points: words within one edit share one."""
    n = F.char_length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.transform(F.array_append(F.when(n > 0, cut).otherwise(F.array().cast("array<string>")), word), lambda w: F.xxhash64(w)))


def _halves(word: Column) -> Column:
    """Keys of long words: of two that are within one edit, the first or the last halves (of the shorter length) are equal."""
    n = F.char_length(word)
    # Lengths differ by one at most, so each word is keyed by the half of its own length and of the one above.
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(sizes, lambda k: F.array(F.xxhash64(F.lit("<"), k, F.substr(word, F.lit(1), k)), F.xxhash64(F.lit(">"), k, F.substr(word, n - k + 1)))))


def within_one_edit(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (left, right) of different values of two columns that are equal or one insertion, deletion or replacement apart, with their distance."""
    words = [df.select(F.col(c).cast("string").alias(n)).where(F.col(c).isNotNull()).distinct() for df, c, n in ((left, a, "left"), (right, b, "right"))]

    def keyed(keys, near) -> list[DataFrame]:
        return [w.where(near(F.char_length(n))).select(n, F.explode(keys(F.col(n))).alias(f"__{n}")) for w, n in zip(words, ("left", "right"))]

    # A word of LONGEST code points meets one that is one longer in both ways of keying.
    pairs = None
    for keys, near in ((neighbours, lambda n: n <= LONGEST), (_halves, lambda n: n >= LONGEST)):
        x, y = keyed(keys, near)
        close = F.levenshtein("left", "right", 1)
        got = x.join(y, F.col("__left") == F.col("__right")).select("left", "right", close.alias("distance")).where(F.col("distance") >= 0)
        pairs = got if pairs is None else pairs.unionByName(got)
    return pairs.distinct()
