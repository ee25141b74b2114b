"""Quality rules: statistics of every text, and a decision list learned from labelled ones.

The list is learned by sequential covering.  A rule for poor text grows by the threshold that gains most information
(FOIL) over the labelled rows not yet covered, on two thirds of them; on the last third its conditions are pruned from the
end while that does not lower its precision.  A rule below ``MIN_PRECISION`` there is given up, and the next one begins with
the next best condition; ``MAX_TRIES`` rules are grown at most.  Thresholds lie on a fixed
grid, so each step is one aggregation to a few hundred counts, whatever the input.  The list becomes an ordered Spark
conditional expression.

Defined results: a NULL or blank text has no words, 0 of everything, and fails the base rule; without labels of both
classes the list is empty and keeps; labels without an id or a mark are left out, of several of an id the lowest counts;
equal gains go to the feature that stands first in the grid, then to the lower threshold; a very long text takes memory in
proportion to its words; an empty table gives no rows; repeated rows give a row each; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import split_words, stored

SPAN = 5
BLANK = r"[\x20\x09-\x0D]"
MAX_RULES, MAX_CONDITIONS, MAX_TRIES = 8, 3, 16
MIN_PRECISION = 0.95
MIN_SUPPORT = 3
#: feature -> (step of its grid, number of steps); larger values fall on the last.
GRID = {
    "symbol_share": (0.01, 60),
    "upper_share": (0.02, 50),
    "mark_share": (0.05, 40),
    "digit_share": (0.02, 50),
    "dup_line_share": (0.02, 50),
    "repeat_share": (0.02, 50),
    "word_length": (0.25, 60),
    "words_log": (0.5, 40),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    step: int

    def column(self) -> Column:
        bound = self.step * GRID[self.feature][0]
        value = F.col(self.feature)
        return value >= bound if self.at_least else value < bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.step * GRID[self.feature][0]:g}"


Rule = tuple[Condition, ...]


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of each text and the features of the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        split_words(F.col("text"), BLANK + "+").alias("words"),
        lines.alias("lines"),
        (F.length("text") - count(BLANK)).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count("[!?]").alias("n_marks"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks"]
    n = F.size("words").cast("long")
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    rows = rows.select(
        *kept, n.alias("n_words"), F.size("lines").alias("n_lines"), dup_lines.alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept += ["n_words", "n_lines", "n_dup_lines"]
    hashes, n = F.col("hashes"), F.size("hashes")
    starts = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(SPAN)]))
    rows = rows.select(*kept, windows.alias("windows"))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    marked = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("window"), i.alias("at"))))
    rows = rows.select(*kept, F.when(repeats, marked).alias("sorted"))
    alike = lambda i, w: F.coalesce(F.get("sorted", i)["window"] == w["window"], F.lit(False))
    places = F.array_compact(F.transform("sorted", lambda w, i: F.when(alike(i - 1, w) | alike(i + 1, w), w["at"])))
    rows = rows.select(*kept, F.sort_array(places).alias("places"))
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "places",
        empty,
        lambda a, p: F.struct((a["total"] + (p + SPAN - F.greatest(p, a["end"])).cast("long")).alias("total"), (p + SPAN).alias("end")),
        lambda a: a["total"],
    )
    rows = rows.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("n_upper"), F.col("word_chars")).alias("upper_share"),
        share(F.col("n_marks"), F.col("n_words")).alias("mark_share"),
        share(F.col("n_digits"), F.col("word_chars")).alias("digit_share"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        share(F.col("word_chars"), F.col("n_words")).alias("word_length"),
        F.log2(F.col("n_words") + 1).alias("words_log"),
    )


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def counts_of(rows: DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """(poor, good) of the rows under each beginning of the rule, the whole rule last."""
    figures = []
    for i in range(1, len(rule) + 1):
        under = holds(rule[:i])
        figures += [F.count_if(under & F.col("poor")), F.count_if(under & ~F.col("poor"))]
    row = rows.agg(*[f.alias(f"c{i}") for i, f in enumerate(figures)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(rule))]


def best_condition(rows: DataFrame, given_up: frozenset[Condition] = frozenset()) -> tuple[Condition, int, int] | None:
    """The condition with the highest FOIL gain over the rows that isn't given up, and the poor and good rows under it."""
    steps = [F.least(F.floor(F.col(f) / size), F.lit(n)).cast("int") for f, (size, n) in GRID.items()]
    table = (
        rows.select("poor", F.posexplode(F.array(*steps)).alias("feature", "step"))
        .groupBy("feature", "step")
        .agg(F.count_if("poor").alias("poor"), F.count_if(~F.col("poor")).alias("good"))
    )
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in table.collect():  # at most the size of the grid
        found.setdefault(r["feature"], []).append((r["step"], r["poor"], r["good"]))
    names = list(GRID)
    best: tuple[float, Condition, int, int] | None = None
    for number in sorted(found):
        bins = sorted(found[number])
        poor, good = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not poor or not good:
            return None
        before = math.log2(poor / (poor + good))
        low_poor = low_good = 0
        for step, p, g in bins:
            for at_least, has, wrong in ((False, low_poor, low_good), (True, poor - low_poor, good - low_good)):
                if MIN_SUPPORT <= has and has + wrong < poor + good:
                    gain = has * (math.log2(has / (has + wrong)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        condition = Condition(names[number], at_least, step)
                        if condition not in given_up:
                            best = (gain, condition, has, wrong)
            low_poor, low_good = low_poor + p, low_good + g
    return best and best[1:]


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Ordered rules whose rows are poor, from statistics and labels.quality (0 is poor)."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 0).alias("poor"))
    rows = stats.join(marks, stats["doc_id"] == F.col("__id")).select(*GRID, "poor", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"))
    rows = stored(rows, "quality-labelled")
    grow, prune = rows.where("part > 0"), rows.where("part = 0")
    rules: list[Rule] = []
    covered = F.lit(False)
    given_up: frozenset[Condition] = frozenset()
    for _ in range(MAX_TRIES):
        if len(rules) == MAX_RULES:
            break
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            found = best_condition(grow.where(~covered & holds(rule)), given_up if not rule else frozenset())
            if found is None:
                break
            condition, _, wrong = found
            rule += (condition,)
            if not wrong:
                break
        if not rule:
            break
        tests = counts_of(prune.where(~covered), rule)
        worth = [p / (p + g) if p else 0.0 for p, g in tests]
        size = len(rule)
        while size > 1 and worth[size - 2] >= worth[size - 1]:
            size -= 1
        if worth[size - 1] < MIN_PRECISION or tests[size - 1][0] < MIN_SUPPORT:
            given_up |= {rule[0]}
            continue
        rules.append(rule[:size])
        covered = covered | holds(rule[:size])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1 on; 0 where none does."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(holds(rule), F.lit(number)).otherwise(out)
    return out


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(text_stats(docs), "quality-stats")
    rules = learn(stats, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    by = verdict(rules)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (by == 0)).alias("kept"), by.alias("rule"),
    )
