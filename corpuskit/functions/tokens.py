"""Tokenisation and the hashed bag-of-words vector, all native expressions.

* chunking token: a maximal run of non-whitespace (``\\S+``);
* sub-word token (``Subwords``): letters and digits in runs of bounded length, any other character by itself;
* embedding term: a maximal run of letters/digits of the lower-cased text;
* term bucket: the first 32 bits of md5(term) as an unsigned number, modulo ``dim``.

The vector is computed inside the row (no explode, no shuffle): bucket ids are sorted,
and the count of bucket ``i`` is the distance between its first and last position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKEN = r"(\S+)"
TERM = r"([\p{L}\p{N}]+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_tokens(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(CHUNK_TOKEN), 1)


@dataclass(frozen=True)
class Subwords:
    """Counts model tokens without a vocabulary: a token is at most ``letters`` ASCII letters or ``digits``
    digits in a row, or one other character that is no ASCII blank (a Chinese letter, a mark, an emoji).

    Counts add up: two texts joined by a blank have as many tokens as both. A text that begins at a token and
    ends at one has the same tokens as in its place, so the chunker and the count of a chunk agree."""

    letters: int = 6
    digits: int = 3

    @property
    def pattern(self) -> str:
        return (f"[A-Za-z]{{1,{self.letters}}}|[0-9]{{1,{self.digits}}}"
                r"|[^\x20\x09-\x0DA-Za-z0-9]")

    def count(self, text) -> Column:
        return F.coalesce(F.regexp_count(_col(text), F.lit(self.pattern)), F.lit(0))

    def cut(self, text, n) -> Column:
        """The first ``n`` tokens of the text, with the blanks before and between them."""
        pieces = F.regexp_extract_all(_col(text), F.lit(rf"([\x20\x09-\x0D]*(?:{self.pattern}))"), 1)
        return F.array_join(F.slice(pieces, 1, n), "")


def terms(text) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM), 1)


def term_bucket(term: Column, dim: int) -> Column:
    h = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(dim))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark evaluates an outer expression that a lambda references once per lambda call
    and the optimizer may inline projected columns into lambdas (filter push-down,
    project collapsing). A lambda variable cannot be inlined, so binding through a
    one-element ``transform`` keeps every array computed exactly once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket_counts(text: Column, dim: int) -> Column:
    """array<int> of length ``dim``: how many terms fall in each bucket."""
    buckets = F.array_sort(F.transform(terms(text), lambda t: term_bucket(t, dim).cast("int")))
    grid = F.sequence(F.lit(0), F.lit(dim - 1))

    def count(s, r):
        n = F.size(s)

        def one(i):
            first = F.array_position(s, i)
            last = n - F.array_position(r, i) + 1
            return F.when(first == 0, F.lit(0)).otherwise(last - first + 1).cast("int")
        return F.transform(grid, one)

    return let(buckets, lambda s: let(F.reverse(s), lambda r: count(s, r)))


def unit_vector(counts: Column) -> Column:
    """array<double>: ``counts`` scaled to unit length (an all-zero vector stays zero)."""
    def scale(c):
        sq = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + (x * x).cast("bigint"))
        return let(F.sqrt(sq.cast("double")),
                   lambda nrm: F.transform(c, lambda x: F.when(nrm == 0, F.lit(0.0)).otherwise(x / nrm)))
    return let(counts, scale)


def hash_vector(text, dim: int = 64) -> Column:
    """L2-normalised hashed bag of terms (array<double>), one pass per row."""
    return unit_vector(bucket_counts(_col(text), dim))


def with_hash_vector(df: DataFrame, text_col: str, out_col: str, dim: int = 64) -> DataFrame:
    """V1a as a DataFrame step: add ``out_col`` (array<double>)."""
    return df.withColumn(out_col, hash_vector(F.col(text_col), dim))
