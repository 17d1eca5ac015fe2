"""Words, hashes and seeded draws as columns."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of Python's str.split, and its punctuation.
WHITE_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[ -　&&[  -     　]]]+"  # most letters fail two tests
PUNCTUATION = string.punctuation
LATIN = string.digits + string.ascii_letters


def hangul_syllables() -> str:
    """The syllables of the KS X 1001 set, by its encoding; pass another string to the operators for another set."""
    return "".join(c for c in map(chr, range(0xAC00, 0xD7A4)) if len(c.encode("euc_kr", "ignore")) == 2)


def words(text: Column) -> Column:
    """The words of a text, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def strip_punctuation(word: Column, mode: str = "run") -> Column:
    """mode "run" takes out the whole string of punctuation signs where it stands in one piece; "charclass" each sign."""
    if mode == "charclass":
        return F.translate(word, PUNCTUATION, "")
    return F.replace(word, F.lit(PUNCTUATION), F.lit(""))


def in_alphabet(word: Column, alphabet: str) -> Column:
    """Not empty, and every character is in the alphabet."""
    return (word != "") & (F.length(F.translate(word, alphabet, "")) == 0)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def row_id(*columns: Column) -> Column:
    """A 32-digit id that depends on the columns alone, so that retries agree."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_int(key: Column, low: Column, high: Column) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(uniform(key) * (high - low + 1))).cast("int")


def mixed(key: np.ndarray, number: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on 64-bit keys, counts and a purpose (0 to 15) alone: the finish of splitmix64, for draws of which there are too many for md5."""
    x = (key.view(np.uint64) + (number.astype(np.uint64) * np.uint64(16) + np.uint64(purpose + 1)) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(1 << 53)


def gauss(key: Column, mu: float, sigma: float, low: float, high: float, tries: int = 8) -> Column:
    """The first of some normal draws that is within bounds; else the last, clamped."""

    def draw(i: Column) -> Column:
        k = F.concat(key, F.lit(":"), i.cast("string"))
        u, v = uniform(F.concat(k, F.lit("a"))), uniform(F.concat(k, F.lit("b")))
        return mu + sigma * F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * 3.141592653589793 * v)

    drawn = F.transform(F.sequence(F.lit(1), F.lit(tries)), draw)
    fit = F.filter(drawn, lambda x: (x >= low) & (x <= high))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.least(F.greatest(F.element_at(drawn, -1), F.lit(low)), F.lit(high)))


def tokenize(df: DataFrame, text: str, output: str = "word") -> DataFrame:
    """One row for each word of a text."""
    return df.withColumn(output, F.explode(words(F.col(text))))
