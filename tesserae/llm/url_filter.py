"""URL filters: host and path rules, and a ratio of character language models for the rest. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, discard

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
Rule = tuple[str, str, str]
#: Characters of the longest context, size of the alphabet that the shortest backs off to.
ORDER, ALPHABET = 4, 256
PAD = "\u0001"
FOLDS, BINS, SPAN = 5, 2000, 4.0
#: Scores of distinct grams up to this number are broadcast (some 10 MB), more are joined by shuffle.
BROADCAST_GRAMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grams(texts: DataFrame) -> DataFrame:
    """(id, n, verdict, held, g) for each character with the ORDER characters before it; the text itself stays behind.

    A text is split into characters once, so a long one costs time and rows in proportion to its length.
    """
    chars = F.split(F.concat(F.lit(PAD * ORDER), F.col("text")), "")
    rows = texts.where("text <> ''").select("id", "n", "verdict", held_out(F.col("text")).alias("held"), chars.alias("chars"))
    gram = lambda i: F.concat(*(F.get("chars", i + k) for k in range(ORDER + 1)))
    return rows.select("id", "n", "verdict", "held", F.explode(F.transform(F.sequence(F.lit(0), F.size("chars") - ORDER - 1), gram)).alias("g"))


def held_out(text: Column) -> Column:
    """The fifth of the urls that the models do not learn from."""
    return F.crc32(text.cast("binary")) % FOLDS == 0


def _ratios(counts: DataFrame) -> DataFrame:
    """(g, ratio): log P(last character | those before) under accepted less under rejected urls, for each distinct gram.

    Witten-Bell: a context of k characters gives way to k - 1 by its number of distinct continuations.
    """
    out = counts.select("g", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pb"))
    for k in range(ORDER + 1):
        gram, context = F.substring("g", ORDER + 1 - k, k + 1), F.substring("g", ORDER + 1 - k, k)
        seen = counts.groupBy(gram.alias("gram")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        ends = seen.groupBy(F.col("gram").substr(1, k).alias("context")).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.sum((F.col("ca") > 0).cast("long")).alias("ta"), F.sum((F.col("cb") > 0).cast("long")).alias("tb"))
        joined = out.withColumn("gram", gram).withColumn("context", context).join(seen, "gram").join(ends, "context")
        mixed = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p)).alias(p)
        out = joined.select("g", mixed("ca", "na", "ta", "pa"), mixed("cb", "nb", "tb", "pb"))
    return out.select("g", (F.log("pa") - F.log("pb")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[Rule], broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages(page_id, url).

    Null urls and those without :// have an empty host and path; rows are neither merged nor dropped, other columns are
    left out, and an empty table gives an empty one. verdict is the longest fitting rule's. Where none fits, it comes from
    score, the log-likelihood ratio a character of host and path under models of the urls that rules allow and of those
    they block: block below the threshold, allow at it. One fifth of the ruled urls (crc32 of host and path mod 5 = 0) is
    kept from the models and sets the threshold of least mean error of the two kinds, of several the middle. Without both
    kinds of examples every ratio is 0, and the verdict is allow. An empty host and path scores 0.

    Counts are over distinct host and path texts weighted by their pages; a gram's row carries a number, not its text.
    Ratios of up to broadcast_grams distinct grams go to all tasks, more are joined by shuffle with the same result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("text", F.concat("host", "path"))
    texts = rows.where("text <> ''").groupBy("text").agg(F.first("ruled").alias("verdict"), F.count("*").alias("n"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))  # written once, so a text keeps its number
    grams = _grams(texts)
    one = lambda kind: F.sum(F.when(~F.col("held") & (F.col("verdict") == kind), F.col("n")).otherwise(0))
    counts = cut(grams.groupBy("g").agg(one("allow").alias("a"), one("block").alias("b")))
    ratios = cut(_ratios(counts))
    small = ratios.count() <= broadcast_grams
    scored = grams.select("id", "g").join(F.broadcast(ratios) if small else ratios.hint("merge"), "g").groupBy("id").agg(F.avg("ratio").alias("score"))
    judged = cut(texts.join(scored, "id", "left").select("text", F.coalesce("score", F.lit(0.0)).alias("score"), "verdict", "n"))
    discard(texts, counts, ratios)
    bin_ = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) + SPAN) / (2 * SPAN) * BINS).alias("bin")
    check = judged.where(held_out(F.col("text")) & F.col("verdict").isNotNull()).groupBy(bin_).agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("b")).collect()
    threshold = _threshold([(r["bin"], r["a"], r["b"]) for r in check])
    known = rows.where("text <> ''").join(judged.select("text", "score"), "text")
    out = known.unionByName(rows.where("text = ''").withColumn("score", F.lit(0.0)))  # rows without a host share no join key
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"), "score")


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The middle of the range of bin edges with the least mean error; 0 where a kind is missing. At most BINS rows."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0.0
    at = {b[0]: b for b in bins}
    lost, caught, best = 0, 0, []
    for edge in range(BINS + 2):
        error = lost / good + (bad - caught) / bad
        if not best or error < best[0] - 1e-12:
            best = [error, edge, edge]
        elif error <= best[0] + 1e-12 and best[2] == edge - 1:
            best[2] = edge
        _, a, b = at.get(edge, (0, 0, 0))
        lost, caught = lost + a, caught + b
    return (best[1] + best[2]) / 2 / BINS * 2 * SPAN - SPAN
