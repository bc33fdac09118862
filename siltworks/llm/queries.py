"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, decontaminate, exact_dedup, fill_in_middle, html_text, licenses, periodic_runs, quality, simhash, stages, substrings, token_counts, toxicity, urls
from siltworks.llm.shared import rank_file, table, vocabulary_file

RULES: urls.Rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in several documents or several times in one."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of each document; null and empty texts have no features, repeated rows get the same score."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items in each document, with a digest of the items' ids; null texts have no words."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to; null texts are empty."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), rank_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document; labels are learnt from, held-out rows never."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and the least doc_id that links of at most four bits reach."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each page's url, or the verdict of the two character models."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source, then a folder for each hundred ids, then the id."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100), "doc_id").alias("path"), "text")
    return licenses.scan_licenses(files, spark).withColumnsRenamed({"id": "doc_id", "from_id": "from_doc_id"})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for each document's normalised text; null counts as empty."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page; null and empty pages have an empty one."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the checksum of their id, has its words from one place on repeated with a period; all from the id and the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    sized = chosen.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    rest = F.col("n") - F.col("a")
    unit = F.slice("w", (F.col("a") + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / p).cast("int"))), F.lit(1), rest.cast("int"))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in documents of which a tenth is made periodic; of equal exponents the run with the least start, then period, is shown."""
    found = periodic_runs.periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = found.withColumn("best", F.aggregate("runs", nothing, lambda a, b: F.when(a.isNull() | more(b, a), b).otherwise(a)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.*", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document; null ids and repeated rows stay."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), 2048)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document moved into its form and, from the form alone, back."""
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256)}
    return out.withColumns(digests).drop("output")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that all stages keep."""
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_decontamination, op4_bpe, op5_quality, op6_simhash, op7_url_filter, op8_license_scan, op9_exact_dedup, op10_html_text, op11_periodic_runs, op12_token_counts, op13_fill_in_middle, pipeline)}

ORACLE_SQL = {
    "op3_decontamination": r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v
    FROM benchmark
), windows AS (
    SELECT item_id, width, array_to_string(v[s : s + width - 1], ' ') AS phrase
    FROM (SELECT item_id, v, least(10, len(v)) AS width, unnest(range(1, len(v) - least(10, len(v)) + 2)) AS s FROM items WHERE len(v) > 0)
), widths AS (
    SELECT DISTINCT width FROM windows
), places AS (
    SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM split, widths WHERE len(w) >= width
), found AS (
    SELECT DISTINCT doc_id, p, width, item_id FROM (SELECT doc_id, p, width, array_to_string(w[p : p + width - 1], ' ') AS phrase FROM places) JOIN windows USING (width, phrase)
), hits AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM found) GROUP BY doc_id
), ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
), occurrences AS (
    SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM split
), counts AS (
    SELECT term, count(*) AS n FROM occurrences GROUP BY term
), ranked AS (
    SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n NULLS FIRST, term) AS rank, least(3, count(*) OVER (PARTITION BY item_id)) AS needed
    FROM (SELECT DISTINCT item_id, unnest(v) AS term FROM items) LEFT JOIN counts USING (term)
), lists AS (
    SELECT doc_id, item_id, pos, rank, needed FROM ranked JOIN occurrences USING (term) WHERE rank <= 3
), near AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
        SELECT a.doc_id, a.item_id, a.pos FROM lists a LEFT JOIN lists b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.rank > 1 AND abs(a.pos - b.pos) <= 20
        WHERE a.rank = 1 GROUP BY a.doc_id, a.item_id, a.pos, a.needed HAVING count(DISTINCT b.rank) = a.needed - 1
    ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM split LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN near USING (doc_id)
""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op13_fill_in_middle": r"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
    SELECT doc_id, t, unit, len(unit) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(unit) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(unit) + 1) AS y,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS whole, CAST('0x' || h[25:32] AS BIGINT) % 100 AS turned FROM u
), f AS (
    SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR whole >= 90 THEN 'plain' WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(unit[1 : least(x, y)], '') AS pre, array_to_string(unit[least(x, y) + 1 : greatest(x, y)], '') AS mid, array_to_string(unit[greatest(x, y) + 1 : n], '') AS suf FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM f
""",
}
