"""Quality rules: a decision list learned by sequential covering.

Statistics of each text are Spark expressions. Rules are conjunctions of
thresholds on them, grown on two thirds of the labelled rows and pruned on the
rest; the list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefit.llm.common import cut, draw, table
from lodefit.llm.secret_ledger import let

BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows that are fitted, drawn by the hash of doc_id."""

    sample_rows: int = 20_000
    thresholds: int = 48
    most_conditions: int = 3
    most_rules: int = 12
    least_precision: float = 0.85


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.threshold if self.above else rows[self.feature] <= self.threshold

    def column(self, feature: Callable[[str], Column]) -> Column:
        c = feature(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


# ---- statistics --------------------------------------------------------------------------


def chars_of(text: Column, characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of that many words that the text has twice or more, the first included.

    Windows of one text are equal if their 64-bit hashes are: two different ones of
    n words share one with a chance of n squared by 2 to the 65th.
    """
    at = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(d: Column) -> Column:
            return F.aggregate(F.transform(d, lambda x, k: F.coalesce(F.least(F.get(d, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, places), total))

    return F.when(F.size(words) > window, let(hashes, covered)).otherwise(F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def statistics(text: Column, words: Column, lines: Column) -> list[Column]:
    plain = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": chars_of(text, r"#*$%&|<>"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_upper": chars_of(text, r"\p{Lu}"),
        "n_shouts": chars_of(text, "!?"),
        "n_digits": chars_of(text, "0-9"),
        "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(words)),
    }
    return [c.cast("long").alias(k) for k, c in plain.items()]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the statistics of each whole text; null and empty texts have no words."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"), lines_of(F.col("t")).alias("l"))
    return rows.select("doc_id", *statistics(F.col("t"), F.col("w"), F.col("l")))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_digits", "n_lines", "n_distinct")
#: Features as parts of these, so that they don't grow with the text.
SHARES = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "shout_share": ("n_shouts", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "line_words": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *SHARES)


def features(statistic: Callable[[str], Column] = F.col) -> list[Column]:
    return [F.when(statistic(b) > 0, statistic(a) / statistic(b)).otherwise(0.0).alias(k) for k, (a, b) in SHARES.items()]


def with_features(rows: DataFrame) -> DataFrame:
    return rows.select("*", *features())


# ---- learning ----------------------------------------------------------------------------


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)


def grow(rows: dict[str, np.ndarray], cuts: dict[str, np.ndarray], settings: Settings) -> list[Condition]:
    """Add the condition of highest information gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < settings.most_conditions:
        n, bad = len(rows["bad"]), int(rows["bad"].sum())
        if not bad or bad == n:
            break
        best, best_gain = None, 1e-9
        for f, thresholds in cuts.items():
            order = np.argsort(rows[f], kind="stable")
            at = np.searchsorted(rows[f][order], thresholds, side="right")  # rows at or below each threshold
            below = np.append(0, np.cumsum(rows["bad"][order]))[at]
            for above, p, q in ((True, bad - below, n - at - (bad - below)), (False, below, at - below)):
                gain = _gain(bad, n - bad, p, q)
                if len(gain) and gain.max() > best_gain:
                    best, best_gain = Condition(f, above, float(thresholds[gain.argmax()])), gain.max()
        if best is None:
            break
        rule.append(best)
        rows = _where(rows, best.holds(rows))
    return rule


def _where(rows: dict[str, np.ndarray], mask: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[mask] for k, v in rows.items()}


def covered_by(rule: list[Condition], rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(rows) for c in rule])


def worth(rule: list[Condition], rows: dict[str, np.ndarray]) -> tuple[float, int, int]:
    """(p - n) / (p + n) of the rows that a rule covers, with p and n."""
    found = rows["bad"][covered_by(rule, rows)]
    p = int(found.sum())
    return ((2 * p - len(found)) / len(found) if len(found) else -1.0), p, len(found) - p


def prune(rule: list[Condition], rows: dict[str, np.ndarray]) -> list[Condition]:
    """Drop conditions from the end while that isn't worse on rows that the rule wasn't grown on."""
    while len(rule) > 1 and worth(rule[:-1], rows)[0] >= worth(rule, rows)[0]:
        rule = rule[:-1]
    return rule


def learn(sample: list[dict], settings: Settings = Settings()) -> list[list[Condition]]:
    """Rules for bad rows, in order. sample: features, bad (0 or 1) and held (True for those to prune on).

    A rule stays if it is precise on rows that it wasn't grown on, by Laplace's estimate;
    covered rows leave before the next is grown.
    """
    if not sample:
        return []
    rows = {k: np.array([r[k] for r in sample], bool if k == "held" else float) for k in (*FEATURES, "bad", "held")}
    cuts = {}
    for f in FEATURES:
        values = np.unique(rows[f])
        cuts[f] = ((values[:-1] + values[1:]) / 2)[:: max(1, (len(values) - 1) // settings.thresholds)]
    rules: list[list[Condition]] = []
    while len(rules) < settings.most_rules:
        rule = grow(_where(rows, ~rows["held"]), cuts, settings)
        if not rule:
            break
        rule = prune(rule, _where(rows, rows["held"]))
        _, p, n = worth(rule, rows)
        if (p + 1) / (p + n + 2) < settings.least_precision:  # a few rows alone don't make a rule
            break
        rules.append(rule)
        rows = _where(rows, ~covered_by(rule, rows))
    return rules


def labelled_sample(labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, quality: at most sample_rows labelled documents; of two labels the lower counts."""
    return draw(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), settings.sample_rows, "doc_id")


def fit(stats: DataFrame, sample: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    """Rules from stats(doc_id, statistics) and a bounded sample(doc_id, quality); no labels give no rules."""
    drawn = with_features(stats).join(F.broadcast(sample), "doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held")
    return learn([r.asDict() for r in drawn.select(*FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), held).collect()], settings)


def fit_texts(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    """The same from docs(doc_id, text): only the sample's statistics are computed."""
    sample = labelled_sample(labels, settings)
    return fit(with_statistics(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")), sample, settings)


def verdict(rules: list[list[Condition]], feature: Callable[[str], Column] = F.col) -> Column:
    """The decision list: the number, from 1, of the first rule that rejects a row, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        every = rule[0].column(feature)
        for c in rule[1:]:
            every = every & c.column(feature)
        out = F.when(every, k) if out is None else out.when(every, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(statistic: Callable[[str], Column] = F.col) -> Column:
    return (statistic("n_words") < 20) | (100 * statistic("n_repeat_words") > 30 * statistic("n_words"))


def keeps(text: Column, rules: list[list[Condition]]) -> Column:
    """Whether a text passes the base rules and the list, as one expression that has every statistic once.

    A filter on statistics of a row below would be pushed down with a copy of them for each mention.
    """
    t = F.coalesce(text, F.lit(""))

    def decide(parts: Column) -> Column:
        stats = F.struct(*statistics(parts["t"], parts["w"], parts["l"]))
        return let(stats, lambda s: let(F.struct(s["n_words"].alias("n_words"), *features(lambda k: s[k])), lambda f: ~base_failed(lambda k: s[k]) & (verdict(rules, lambda k: f[k]) == 0)))

    return let(F.struct(t.alias("t"), words_of(t).alias("w"), lines_of(t).alias("l")), decide)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, statistics, base_failed, kept, rule; one row for each row.

    Null and empty texts have no words and fail. Rows that no rule rejects are
    kept. Labels of documents that aren't there are left out; of two labels the lower counts.
    """
    stats = cut(with_statistics(docs))
    rule = verdict(fit(stats, labelled_sample(labels, settings), settings)).alias("rule")
    return with_features(stats).select("doc_id", *STATISTICS, base_failed().alias("base_failed"), rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *STATISTICS[:5], "base_failed", "kept", "rule")
