"""Operator 7, URL filters: rules for hosts and paths; elsewhere the ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.shared import ASCII_LOWER, ASCII_UPPER, scratch, stored

#: (verdict, host/path): fits the host and all its subdomains if the url's path starts with the rule's.
Rules = tuple[tuple[str, str], ...]


def url_parts(url) -> dict:
    """host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. path: from there up to '?', '#' or the end. Both empty without '://' or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return {"host": F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def rule_of(rules: Rules):
    """Columns rule and ruled (its verdict) from host and path: the longest rule that fits, else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        own = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits.append((own & F.col("path").startswith(slash + path), rule, verdict))
    out = []
    for i in (1, 2):
        column = F.lit(None).cast("string")
        for fit in reversed(fits):
            column = F.when(fit[0], fit[i]).otherwise(column)
        out.append(column)
    return {"rule": out[0], "ruled": out[1]}


def grams(text, order: int):
    """The last ``order`` characters at each character of ``text``, which start and end marks frame."""
    padded = F.concat(F.lit("\x02" * (order - 1)), text, F.lit("\x03"))
    return F.expr("explode(transform(sequence(1, length(p) - {0} + 1), i -> substring(p, i, {0})))".format(order)), padded


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(gram, score): log probability of a gram's last character after the others, accepted minus rejected.

    ``counts``: gram, a, r: how often each occurs in accepted and rejected urls, zero included. Witten-Bell smoothing: an order
    weighs as its context's count against the number of its continuations, the rest goes to the next lower order, and the lowest to 1/256.
    """
    lower = None
    for k in range(1, order + 1):
        gram = counts.select(F.expr(f"right(gram, {k})").alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        here = gram.withColumn("context", F.expr(f"left(gram, {k - 1})"))
        sums = here.groupBy("context").agg(*[f(c).alias(n) for c in "ar" for f, n in ((F.sum, f"n{c}"), (lambda c: F.count_if(F.col(c) > 0), f"t{c}"))])
        here = here.join(sums, "context")
        if lower is None:
            here = here.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
        else:
            here = here.withColumn("shorter", F.expr(f"right(gram, {k - 1})")).join(lower.withColumnRenamed("gram", "shorter"), "shorter")
        mixed = {f"p{c}": F.expr(f"CASE WHEN n{c} = 0 THEN p{c} ELSE (CAST({c} AS double) + t{c} * p{c}) / (n{c} + t{c}) END") for c in "ar"}
        lower = stored(here.withColumns(mixed).select("gram", "pa", "pr"), f"order{k}")
    return lower.select("gram", F.log(F.col("pa") / F.col("pr")).alias("score"))


def filter_urls(pages: DataFrame, rules: Rules, order: int = 5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score.

    The longest fitting rule decides. Elsewhere the models do: variable-order Markov chains over the characters of all urls that
    a rule allows and blocks. A url's score is its log likelihood ratio by character; it is allowed from a threshold
    on, where both classes of a fifth of the ruled urls, left out of the counts, are equally many deviations away (0 if one is missing).
    A null or empty url, or one without '://', has empty host and path and is judged by the models as it stands. Repeated rows
    count and are judged each. Only page_id and url are read. Native expressions only.
    """
    parts = pages.select("page_id", "url").withColumns(url_parts(F.col("url"))).withColumns(rule_of(rules))
    with scratch(pages.sparkSession) as keep:
        held_out = F.expr("pmod(crc32(coalesce(url, '')), 5) = 0")
        labelled = parts.withColumns({"row": F.monotonically_increasing_id(), "a": ((F.col("ruled") == "allow") & ~held_out).cast("int"), "r": ((F.col("ruled") == "block") & ~held_out).cast("int"), "held_out": held_out})
        labelled = stored(labelled.fillna(0, ["a", "r"]), "labelled")
        gram, padded = grams(F.coalesce("url", F.lit("")), order)
        each = labelled.select("row", "a", "r", padded.alias("p")).select("row", "a", "r", gram.alias("gram"))
        counts = stored(each.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "counts")
        scores = stored(gram_scores(counts, order), "scores")
        scored = each.select("row", "gram").join(scores, "gram").groupBy("row").agg(F.round(F.avg("score"), 9).alias("score"))
        scored = stored(labelled.join(stored(scored, "scored"), "row"), "judged")
        at = scored.filter("held_out").groupBy("ruled").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
        of = {r["ruled"]: r for r in at.collect()}  # three rows at most
        threshold = 0.0
        if "allow" in of and "block" in of:
            (m, d), (n, e) = ((of[k]["mean"], of[k]["deviation"] + 1e-9) for k in ("allow", "block"))
            threshold = (m * e + n * d) / (d + e)
        keep(scored)
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
