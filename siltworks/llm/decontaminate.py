"""Operator 3, benchmark decontamination: a positional inverted index of the training tokens, asked for the phrases and the rarest words of the test items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm.shared import ascii_lower, scratch, split_by, stored

#: Words are runs of 0-9, a-z and all beyond ASCII, after A-Z became a-z; the rest separates them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that are broadcast at most; more of them meet the index in a join that moves each posting once.
BROADCAST_ROWS = 200_000
#: A row of documents: its id, and a hash of its text, since texts may share an id.
ROW = ["doc_id", "text_hash"]


def same_row(a: str, b: str):
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.text_hash = {b}.text_hash")


def tokens(text):
    """An array: '.', which is no word, then the words in order. An empty string may stand before or after all words."""
    return F.concat(F.array(F.lit(".")), F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, n_words, at, term): each word of each item that has an id and words; ``at`` counts from 0. Repeated rows count once."""
    listed = items.filter("item_id IS NOT NULL").select("item_id", "text").distinct().select("item_id", F.filter(tokens(F.col("text")), lambda w: ~w.isin("", ".")).alias("w"))
    return listed.select("item_id", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "term"))


def build_index(docs: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, text_hash, pos) of all words of whole texts; a row with null term has a document's number of words as pos.

    The index is partitioned by document and in the order of the texts, as the input is: building it neither moves tokens between
    tasks, however often a term occurs, nor sorts them (sorting them by term takes an executor beyond its memory, see README). The lists that are asked for are
    inverted, sorted by term, once they are read from it.
    """
    ends = F.when(F.element_at("w", 2) == "", 1).otherwise(0) + F.when((F.size("w") > 2) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    listed = rows_of(docs).select(*ROW, tokens(F.col("text")).alias("w")).withColumn("n", F.size("w") - 1 - ends)
    each = listed.select(*ROW, "n", F.posexplode("w").alias("pos", "term")).filter("term <> ''")
    rows = each.select(F.when(F.col("pos") > 0, F.col("term")).alias("term"), *ROW, F.when(F.col("pos") > 0, F.col("pos")).otherwise(F.col("n")).alias("pos"))
    return stored(rows, "postings")


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored (term, n_postings) of the words of the items; null where no document has it."""
    found = index.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n_postings"))
    return stored(terms.select("term").distinct().join(found, "term", "left"), "counts")


def rarest(counts: DataFrame, terms: DataFrame, window: int, lists: int) -> DataFrame:
    """(item_id, at, term): of each window that can occur, the ``lists`` words with the fewest postings."""
    known = terms.join(counts, "term")
    starts = F.expr(f"explode(sequence(greatest(0, at - {window - 1}), greatest(0, least(at, n_words - {window}))))")
    each = known.select("item_id", "at", "term", "n_postings", starts.alias("start"))
    of = Window.partitionBy("item_id", "start")  # at most `window` rows
    ranked = each.withColumns({"missing": F.sum(F.col("n_postings").isNull().cast("int")).over(of), "rank": F.row_number().over(of.orderBy("n_postings", "at"))})
    return ranked.filter(f"missing = 0 AND rank <= {lists}").select("item_id", "at", "term").distinct()


def rarest_of_items(counts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(item_id, term, rank, needed): the ``most`` rarest distinct words of each item, all of them where it has fewer; rank 1 is the rarest."""
    of = Window.partitionBy("item_id")
    words = terms.select("item_id", "term").distinct().join(counts, "term")
    ranked = words.withColumns({"rank": F.row_number().over(of.orderBy(F.col("n_postings").asc_nulls_first(), "term")), "needed": F.least(F.lit(most), F.count("*").over(of))})
    return ranked.filter(f"rank <= {most} AND n_postings > 0").select("item_id", "term", "rank", "needed")


def met(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The join of the postings with the stored ``wanted`` by term, one scan of the index. Up to BROADCAST_ROWS of ``wanted`` are broadcast and the index stays where it is; more take a
    sort-merge join, whose skewed terms adaptive execution splits, as both sides are stored."""
    few = wanted.count() <= BROADCAST_ROWS
    return index.join(F.broadcast(wanted) if few else wanted.hint("merge"), "term")


def diagonals(lists_: DataFrame, anchors: DataFrame, terms: DataFrame, window: int, lists: int) -> DataFrame:
    """(doc_id, text_hash, item_id, shift): where the offset-adjusted posting lists of the anchors agree, so that item word k may stand at position k + shift."""
    hits = met(lists_, anchors).select(*ROW, "item_id", (F.col("pos") - F.col("at")).alias("shift"))
    lengths = stored(terms.select("item_id", "n_words").distinct(), "lengths")
    agreed = hits.groupBy(*ROW, "item_id", "shift").agg(F.count("*").alias("n_lists"))
    return agreed.join(lengths, "item_id").filter(F.col("n_lists") >= F.least(F.lit(lists), F.lit(window), "n_words")).select(*ROW, "item_id", "shift")


def phrase_matches(docs: DataFrame, lists_: DataFrame, anchors: DataFrame, terms: DataFrame, window: int = 10, lists: int = 3) -> DataFrame:
    """doc_id, text_hash, found: array of (item_id, shift, starts, width), the windows of items that occur in a document.

    Window ``start`` of an item occurs at position start + shift. A window is ``window`` consecutive words of an item, or
    all words of a shorter item. Candidates come from intersecting the ``lists`` rarest posting lists of each
    window; each is then compared word by word with the text.
    """
    lines = stored(diagonals(lists_, anchors, terms, window, lists), "diagonals")
    listed = stored(terms.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("words")), "items")
    shifts = lines.groupBy(*ROW, "item_id").agg(F.collect_list("shift").alias("shifts"))  # an item's words once, at however many places
    held = stored(shifts.join(listed, "item_id").groupBy(*ROW).agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("held")), "held")
    # sort-merge at any size: how many documents are candidates follows the corpus. Only candidates are split, and stored, as the comparison reads the words over and over
    may = split_by(rows_of(docs), ROW, held)[0]
    asked = may.alias("d").join(held.hint("merge").alias("h"), same_row("d", "h")).select("d.doc_id", "d.text_hash", "held", tokens(F.col("text")).alias("w"))
    asked = stored(asked.dropDuplicates(ROW), "asked")
    width = f"least({window}, size(c.words))"
    same = f"CASE WHEN x + s >= 1 THEN slice(w, x + s + 1, {width}) = slice(c.words, s + 1, {width}) ELSE false END"
    of_item = f"transform(c.shifts, x -> struct(c.item_id AS item_id, x AS shift, filter(sequence(0, size(c.words) - {width}), s -> {same}) AS starts, {width} AS width))"
    found = f"flatten(transform(held, c -> {of_item}))"
    return asked.select(*ROW, F.expr(f"filter({found}, f -> size(f.starts) > 0)").alias("found")).filter("size(found) > 0")


def proximity_matches(lists_: DataFrame, ranked: DataFrame, within: int = 20) -> DataFrame:
    """(doc_id, text_hash, item_id, pos): where an item's rarest distinct words (``ranked``), in any order, lie at most ``within`` words from its rarest one at pos.

    An item with a word that no document has is not found; one of fewer distinct words needs all of them. Positions meet by
    stretches of ``within`` words, so a text that repeats the words makes no more pairs than its length times ``within``.
    """
    hits = met(lists_, ranked).select(*ROW, "item_id", "pos", "rank", "needed")
    first = hits.filter("rank = 1").withColumn("stretch", F.expr(f"pos div {within}"))
    near = F.explode(F.expr(f"sequence(pos div {within} - 1, pos div {within} + 1)"))
    rest = hits.filter("rank > 1").select(*ROW, "item_id", F.col("pos").alias("other"), F.col("rank").alias("other_rank"), near.alias("stretch"))
    met_ = first.alias("d").join(rest.alias("h"), same_row("d", "h") & F.expr(f"d.item_id = h.item_id AND d.stretch = h.stretch AND abs(other - pos) <= {within}"))
    all_ = met_.groupBy("d.doc_id", "d.text_hash", "d.item_id", "pos", "needed").agg(F.count_distinct("other_rank").alias("n")).filter("n = needed - 1")
    return all_.select(*ROW, "item_id", "pos").unionByName(first.filter("needed = 1").select(*ROW, "item_id", "pos"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, lists: int = 3, near: int = 3, within: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside occurring windows), n_items, items (their ids as sorted strings), contaminated, n_near (items whose ``near`` rarest words lie ``within`` words of the rarest).

    Null and empty texts have no words and no hits. Items without id or words are never found. Rows repeated with the same
    doc_id and text are one document and each get its answer; of different texts with one id each is judged on its own. Only doc_id, text and item_id are read, so
    extra columns don't matter. Native expressions only.
    """
    with scratch(docs.sparkSession) as keep:
        docs = docs.select("doc_id", "text")
        terms = stored(item_terms(items.select("item_id", "text")), "terms")
        index = build_index(docs)
        counts = term_counts(index, terms)
        anchors = stored(rarest(counts, terms, window, lists), "anchors")
        ranked = stored(rarest_of_items(counts, terms, near), "ranked")
        wanted = stored(anchors.select("term").unionByName(ranked.select("term")).distinct(), "wanted")
        lists_ = stored(met(index.filter("term IS NOT NULL"), wanted).sortWithinPartitions("term", *ROW, "pos"), "lists")
        matches = phrase_matches(docs, lists_, anchors, terms, window, lists)
        covered = "array_distinct(flatten(flatten(transform(found, f -> transform(f.starts, s -> sequence(f.shift + s, f.shift + s + f.width - 1))))))"
        ids = "array_sort(array_distinct(transform(found, f -> cast(f.item_id AS string))))"
        hit = matches.select(*ROW, F.expr(f"size({covered})").alias("n_hit"), F.expr(ids).alias("items"), F.lit(0).alias("n_near"))
        close = proximity_matches(lists_, ranked, within).groupBy(*ROW).agg(F.count_distinct("item_id").alias("n_near"))
        close = close.select(*ROW, F.lit(0).alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), "n_near")
        both = hit.unionByName(close).groupBy(*ROW).agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
        every = stored(index.filter("term IS NULL").select(*ROW, F.col("pos").alias("n_words")), "lengths")
        hits = stored(both, "hits")
        keep(every, hits)
    out = every.alias("d").join(hits.hint("merge").alias("h"), same_row("d", "h"), "left")
    return out.select(
        "d.doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )
