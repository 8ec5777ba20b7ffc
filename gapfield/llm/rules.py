"""Quality rules: text statistics as Spark columns and learned decision lists over them.

All statistics are built-in column expressions; nothing runs in Python on the executors. Repeated
8-word windows are found on hashes of words: hashes of 2, 4 and 8 words come from pairing an array
with itself shifted, equal window hashes from sorting them with their positions.

The decision list is learned by sequential covering on a bounded draw of labelled rows
(``PER_CLASS`` per class by a hash of the id; only their statistics reach the driver). A rule, a
conjunction of thresholds that marks a text as bad, is grown by information gain on two thirds of
the rows, pruned on the rest, and kept if precise enough there; the rows it covers leave, and the
next rule is learned. The rules become one ordered conditional expression; what no rule covers is
kept.

Defined results: null or empty text has all statistics 0 and fails the base; without labelled bad
rows the list is empty and keeps all that passes the base; equal rows are judged one by one; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn

PER_CLASS = 2500
# The symbols that the contract counts, and the separators of words.
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
REPEAT_WORDS = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# What a learned rule must reach on the rows kept for pruning, and how many conditions it may have.
MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, MAX_RULES = 0.8, 5, 4, 12
FEATURES = ("words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "other_mark_share", "dup_line_share", "line_words", "repeat_share", "distinct_share", "neighbour_share")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, also where the optimizer inlines the expression."""
    return F.transform(F.array(value), then)[0]


def _paired(h: Column, by: int) -> Column:
    """Hashes of every element with the one ``by`` places on; the last ``by`` are of no use."""
    return F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def repeated_words(h1: str) -> Column:
    """Words inside windows of 8 that occur twice or more, from the hashes of the words."""

    def places(s: Column) -> Column:
        # positions whose window hash stands next to an equal one once sorted
        twice = lambda e, k: F.when(e["x"].eqNullSafe(F.get(s, k + 1)["x"]) | e["x"].eqNullSafe(F.get(s, k - 1)["x"]), e["i"])
        return F.array_sort(F.filter(F.transform(s, twice), lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get(at, k + 1) - p, F.lit(REPEAT_WORDS)))), F.lit(0), lambda a, b: a + b)

    def counted(h8: Column) -> Column:
        tagged = F.array_sort(F.transform(h8, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h8)) < F.size(h8), _let(tagged, lambda s: _let(places(s), covered))).otherwise(0)

    h = F.col(h1)
    windows = F.greatest(F.size(h) - (REPEAT_WORDS - 1), F.lit(0))
    eight = _let(_paired(h, 1), lambda h2: _let(_paired(h2, 2), lambda h4: F.slice(_paired(h4, 4), F.lit(1), windows)))
    return _let(eight, counted)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text: the contract's counts and the features of the rules."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    out = out.select(
        "doc_id",
        F.expr("filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SEPARATORS, "") != "").alias("lines"),
        F.length(F.translate("text", SEPARATORS, "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        without("0123456789").alias("digits"),
        without("!?").alias("marks"),
        without(".,;:()[]{}\"'/\\=_-@").alias("other_marks"),
    )
    out = out.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.col("word_chars").cast("bigint").alias("word_chars"), F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), repeated_words("h1").cast("bigint").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("h1")).alias("distinct"), F.size(F.array_distinct(_paired(F.col("h1"), 1))).alias("distinct2"), "upper", "digits", "marks", "other_marks",
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def features() -> dict[str, Column]:
    """The features that rules compare, as columns over ``statistics``; shares of nothing are 0."""
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    columns = [
        F.col("n_words").cast("double"), over("word_chars", "n_words"), over("n_symbols", "word_chars"), over("upper", "word_chars"), over("digits", "word_chars"), over("marks", "word_chars"),
        over("other_marks", "word_chars"), over("n_dup_lines", "n_lines"), over("n_words", "n_lines"), over("n_repeat_words", "n_words"), over("distinct", "n_words"), over("distinct2", "n_words"),
    ]
    return dict(zip(FEATURES, columns, strict=True))


@dataclass
class Rule:
    """A conjunction of (feature number, above, threshold): at least the threshold, or below it."""

    conditions: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            ok &= (x[:, f] >= t) if above else (x[:, f] < t)
        return ok

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            c = of[FEATURES[f]]
            out = out & ((c >= F.lit(t)) if above else (c < F.lit(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>=' if above else '<'} {t:.4g}" for f, above, t in self.conditions)


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition with the best information gain until no good row is covered."""
    rule, inside = Rule(), np.ones(len(x), bool)
    while len(rule.conditions) < MAX_CONDITIONS:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        best, now = (1e-9, None), np.log2(p / (p + n))
        for f in range(x.shape[1]):
            own = x[inside, f]
            for t in np.unique(np.quantile(own, np.linspace(0, 1, 65)[1:])):
                for above in (True, False):
                    take = own >= t if above else own < t
                    q, m = (take & bad[inside]).sum(), (take & ~bad[inside]).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - now)) > best[0]:
                        best = (gain, (f, above, float(t)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside = rule.covers(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = rule.covers(x)
    return (c & bad).sum() / (c.sum() + 2)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last conditions for as long as the rule gets no worse on other rows."""
    options = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
    return max(options, key=lambda r: _worth(r, x, bad)) if options else rule


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The decision list from features and marks of bad rows."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 0
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & bad & ~third).sum() >= MIN_COVER:
        grow, test = left & ~third, left & third
        rule = _prune(_grow(x[grow], bad[grow]), x[test], bad[test])
        c = rule.covers(x) & left
        if not rule.conditions or (c & bad & third).sum() < MIN_COVER or (c & bad & third).sum() < MIN_PRECISION * (c & third).sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Learn from labelled rows: docs has doc_id and text, labels doc_id and quality (0 is bad)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("y")).dropDuplicates(["doc_id"])
    # the draw has about 2 * per_class short rows, so it goes to the texts and not they to it
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn(known, "doc_id", "y", per_class)), "doc_id")
    stats = statistics(sample.select(F.struct("doc_id", "y").alias("doc_id"), "text"))
    rows = stats.select("base_failed", "doc_id.y", "doc_id.doc_id", *[c.alias(n) for n, c in features().items()]).collect()
    rows = sorted((tuple(r)[1:] for r in rows if not r.base_failed), key=lambda r: r[1:])
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r[0] == 0 for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """One ordered conditional: False at the first rule that covers a text, else True."""
    of = features()
    out = None
    for r in rules:
        out = F.when(r.column(of), False) if out is None else out.when(r.column(of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics of every row with base_failed and kept."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))
