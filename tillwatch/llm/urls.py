"""URL filter: rules by host and path, and a ratio of character language models where no rule fits.

Two smoothed variable-order Markov models over characters are trained, one on the accepted and one on the rejected URLs
(those a rule decides); they read the whole URL after ``://``, with query and fragment.  The alphabet is folded to ``len(ALPHABET) + 1`` symbols and contexts reach ``ORDER`` symbols, so
a model has at most (len(ALPHABET) + 1) ** (ORDER + 1) rows whatever the input; that bound is why the table of
log-likelihood differences may be broadcast.  Each order is smoothed towards the next lower one (a Dirichlet prior of
weight ``SMOOTHING``).  A URL's score is the mean difference per character; the threshold is the one with the best
balanced accuracy on a fifth of the rule-decided URLs, which the models do not see.  Scores are sums of whole
micro-nats, so they don't depend on the order of summation.

Defined results: a NULL URL, or one without ``://``, has empty host and path, no rule and verdict ``block``; repeated rows
give a row each; if the calibration fifth lacks a class the threshold is 0; other columns of the pages are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import ascii_lower, stored

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Letters, digits folded to 0, and URL punctuation; anything else is one further symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-^"
ORDER = 3
SMOOTHING = 2.0
SYMBOLS = len(ALPHABET) + 1
MICRO = 1_000_000
#: Steps per nat of the calibration histogram, and the share of decided URLs kept for it.
STEPS = 200
CALIBRATION_FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for on, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule = F.when(fits, F.lit(on + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = split_url(pages["url"])
    # Names of its own, so that columns of the input can't clash.
    out = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def tail_of(url: Column) -> Column:
    """Query and fragment: what follows host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1), F.lit(""))


def symbols_of(host: Column, path: Column, tail: Column) -> Column:
    """The folded characters as numbers below SYMBOLS, after ORDER start marks."""
    plain = F.translate(F.lower(F.concat(host, path, tail)), "123456789^", "000000000~")
    return F.transform(F.split(F.concat(F.lit("^" * ORDER), plain), ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("long"))


def grams_of(symbols: str, n: Column) -> Column:
    """One (ORDER + 1)-gram code per character."""
    column = F.col(symbols)

    def code(i: Column) -> Column:
        out = column[i]
        for k in range(1, ORDER + 1):
            out = out * SYMBOLS + column[i + k]
        return out

    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, code)


def log_ratios(grams: DataFrame) -> DataFrame:
    """code and diff (micro-nats, accepted less rejected) from code, n_allow, n_block; at most SYMBOLS ** (ORDER + 1) rows."""
    lower = None
    for k in range(ORDER + 1):
        whole = grams.groupBy((F.col("code") % SYMBOLS ** (k + 1)).alias("g")).agg(
            F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")
        )
        context = whole.groupBy(F.expr(f"g div {SYMBOLS}").alias("context")).agg(
            F.sum("n_allow").alias("c_allow"), F.sum("n_block").alias("c_block")
        )
        whole = whole.join(F.broadcast(context), F.expr(f"g div {SYMBOLS}") == F.col("context"))
        if lower is None:
            whole = whole.withColumns({"q_allow": F.lit(1.0 / SYMBOLS), "q_block": F.lit(1.0 / SYMBOLS)})
        else:
            whole = whole.join(F.broadcast(lower), F.col("g") % SYMBOLS**k == F.col("tail"))
        smooth = lambda c: (F.col(f"n_{c}") + SMOOTHING * F.col(f"q_{c}")) / (F.col(f"c_{c}") + SMOOTHING)
        whole = whole.select("g", smooth("allow").alias("p_allow"), smooth("block").alias("p_block"))
        lower = whole.select(F.col("g").alias("tail"), F.col("p_allow").alias("q_allow"), F.col("p_block").alias("q_block"))
    return whole.select(F.col("g").alias("code"), F.round((F.log("p_allow") - F.log("p_block")) * MICRO).cast("long").alias("diff"))


def best_threshold(bins: list[tuple[int, int, int]]) -> float:
    """bins: (score in steps, accepted, rejected) -> the score from which the method allows, in nats."""
    accepted, rejected = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not accepted or not rejected:
        return 0.0
    # Below the first bin everything is allowed; each step moves one bin to the rejected side.
    right_allow, right_block, best, at, below = accepted, 0, -1.0, 0.0, None
    for score, allow, block in sorted(bins):
        balanced = right_allow / accepted + right_block / rejected
        if balanced > best:
            # Half-way through the gap to the bin below.
            best, at = balanced, (score if below is None else (below + 1 + score) / 2) / STEPS
        right_allow, right_block, below = right_allow - allow, right_block + block, score
    return at


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score (mean difference per character, in nats) of every row."""
    rows = judged(pages, rules)
    rows = rows.withColumn("symbols", symbols_of(F.col("host"), F.col("path"), tail_of(F.col("url"))))
    rows = rows.withColumn("grams", grams_of("symbols", F.size("symbols") - ORDER)).drop("symbols")
    fold = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(CALIBRATION_FOLDS))
    each = rows.withColumn("code", F.explode_outer("grams")).withColumn("length", F.size("grams")).drop("grams")
    learns = fold != 0
    counts = each.groupBy("code").agg(
        F.count_if(learns & (F.col("rule_verdict") == "allow")).alias("n_allow"),
        F.count_if(learns & (F.col("rule_verdict") == "block")).alias("n_block"),
    )
    model = log_ratios(stored(counts.where("code is not null"), "url-counts"))
    # At most SYMBOLS ** (ORDER + 1) rows of two numbers: bounded by the alphabet, not by the input.
    scored = each.join(F.broadcast(model), "code", "left")
    # Repeated rows fall into one group: the sum holds each of them.
    own = ["page_id", "url", "host", "path", "rule", "rule_verdict", "length"]
    scored = scored.groupBy(*own).agg(F.coalesce(F.sum("diff"), F.lit(0)).alias("sum"), F.count(F.lit(1)).alias("n"))
    scored = scored.withColumn("copies", F.expr("n div greatest(length, 1)")).withColumn(
        "score", F.col("sum") / F.greatest(F.col("n"), F.lit(1)) / MICRO
    )
    scored = stored(scored.withColumn("fold", fold), "url-scores")
    bins = (
        scored.where((F.col("fold") == 0) & F.col("rule").isNotNull())
        .groupBy(F.floor(F.col("score") * STEPS).alias("bin"))
        .agg(
            F.sum(F.when(F.col("rule_verdict") == "allow", F.col("copies")).otherwise(0)).alias("allow"),
            F.sum(F.when(F.col("rule_verdict") == "block", F.col("copies")).otherwise(0)).alias("block"),
        )
    )
    # A difference per character lies within a few nats, so the bins are a few thousand.
    threshold = best_threshold([tuple(r) for r in bins.collect()])
    method = F.when(F.col("host") == "", "block").when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id",
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", method).alias("verdict"),
        "score",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def url_digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
