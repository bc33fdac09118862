"""Texts cut into prefix, middle and suffix, and put together again with the middle last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a run of letters or one other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
_POSSESSIVE = "(?:[A-Za-z]++|[^A-Za-z])"


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` whole numbers of 32 bits that depend on the seed and the id alone; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def restore(output: Column, form: Column) -> Column:
    """The text of an output: no text with a marker in it is ever moved, so each marker stands once."""
    moved = F.when(form == "psm", F.lit(f"(?s)\\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\\z")).otherwise(F.lit(f"(?s)\\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\\z"))
    parts = F.when(form == "psm", F.lit("$1$3$2")).otherwise(F.lit("$2$3$1"))
    return F.when(form == "plain", output).otherwise(F.regexp_replace(output, moved, parts))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units of the text), form, prefix_chars, middle_chars, output.

    Two places between units are drawn from the id. One pattern a row counts units up to them with possessive quantifiers, unit{a} and unit{b-a}, which a
    regular expression takes in a loop without backtracking, so one match captures prefix, middle and suffix however long the text; the replacement writes the
    form: psm ``<P>prefix<S>suffix<M>middle`` or, for ``spm_below`` of 100 ids, spm ``<S>suffix<P>prefix<M>middle``. plain is the text as it is: for ids drawn from
    ``plain_from`` of 100 on, empty and null texts, and texts that hold a marker. prefix_chars and middle_chars are code points, null where plain. ``restore`` gives
    the text back. Rows stay in place, repeated rows and null ids too; equal ids with different texts have the same draws. Only doc_id and text are read.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", text.alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | held | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    cut = counted.withColumns({"form": form, "x": h1 % (F.col("n") + 1), "y": h2 % (F.col("n") + 1)})
    a, b = F.least("x", "y"), F.greatest("x", "y")
    pattern = F.concat(F.lit(f"(?s)\\A({_POSSESSIVE}{{"), a.cast("string"), F.lit(f"}}+)({_POSSESSIVE}{{"), (b - a).cast("string"), F.lit("}+)(.*)\\z"))
    written = F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")).otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    out = cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, written)).alias("output"))
    at = {m: F.locate(m, "output") for m in (PREFIX, SUFFIX, MIDDLE)}
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - at[PREFIX] - len(PREFIX)).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] + 1 - len(MIDDLE))
    return out.select("doc_id", "n", "form", prefix.cast("bigint").alias("prefix_chars"), middle.cast("bigint").alias("middle_chars"), "output")
