"""Column expressions shared by the native operators: case, words and row keys without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.session import materialize

# The character classes of the contract.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay (``lower`` would change them)."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def with_words(df: DataFrame, text: Column, separators: str, out: str) -> DataFrame:
    """Adds the array of words of ``text``.

    The array comes out of a one-row generator: the optimizer doesn't move expressions across it, so a predicate or
    lambda above it reads the array and never holds a copy of the split that made it.
    """
    raw = f"{out}_split"
    cut = df.withColumn(raw, F.split(text, separators))
    first = F.when(F.get(raw, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)
    words = F.slice(raw, first + 1, F.size(raw) - first - last)
    return cut.select(*df.columns, F.explode(F.array(words)).alias(out))


def no_ints() -> Column:
    return F.array().cast("array<int>")


def own_columns(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named inputs under private names, so that a caller's extra columns can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def with_row_key(df: DataFrame, out: str = "_row") -> DataFrame:
    """A key of the row, not of its id: repeated ids stay separate rows through a regrouping."""
    return df.withColumn(out, F.monotonically_increasing_id())


#: Rows to drop that are broadcast at most: at about 90 bytes each in a hash table, 45 MB.
BROADCAST_DROPS = 500_000


def text_key(text: Column) -> Column:
    """A text's SHA-256, which tells texts apart as well as they do themselves; null counts as ''."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def drop_rows(docs: DataFrame, drops: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the rows whose id (null equals null) and text_key are in ``drops`` (_id, _key)."""
    drops = materialize(drops.distinct(), "drops")
    few = drops.count() <= BROADCAST_DROPS
    same = docs[doc_id].eqNullSafe(drops["_id"]) & (text_key(docs[text]) == drops["_key"])
    return docs.join(F.broadcast(drops) if few else drops, same, "left_anti")
