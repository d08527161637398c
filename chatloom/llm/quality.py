"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few figures of a text and votes ``1`` (good), ``-1`` (bad) or ``0`` (abstains). No rule
decides alone. How far each can be trusted is estimated from how the rules agree with one another over the
whole corpus: expectation-maximisation on a model in which a document is good or bad and the rules err
independently, each at its own rate for good and for bad documents. A document's posterior probability of
being good then decides.

The votes of n rules have at most 3**n patterns, and the patterns' counts are all that the estimation needs: the
corpus is read once for them, the driver gets a table of at most 3**n rows, and the posterior is an expression of
the votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.scratch import written

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
ROUNDS = 100
#: The accuracies on good and bad documents start at, and are held towards, these values, with the weight of so many documents
#: and of this share of all those judged. On bad documents a rule may be wrong mostly, as each knows one kind of badness only.
#: The prior alone keeps the two classes from changing places; nothing that was estimated is clamped.
START_ACCURACY, START_WEIGHT, PRIOR_SHARE = (0.95, 0.3), 20.0, 0.003
START_GOOD = 0.8
KEEP_FROM = 0.5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct_words", "n_repeat_words", "n_upper", "n_letters")


def figures(text: Column) -> dict[str, Column]:
    """Columns of one text's figures; each is computed from those before it by name, see ``with_figures``."""
    some = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(some, SPACE), lambda w: w != "")
    lines = F.filter(F.split(some, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    return {
        "_words": words,
        "n_words": F.size("_words").cast("long"),
        "_lines": lines,
        "word_chars": F.char_length(F.regexp_replace(some, SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(some) - F.char_length(F.translate(some, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_distinct_words": F.size(F.array_distinct("_hashes")).cast("long"),
        "n_repeat_words": repeated_words("_hashes"),
        "n_upper": F.char_length(F.regexp_replace(some, "[^\\p{Lu}]+", "")).cast("long"),
        "n_letters": F.char_length(F.regexp_replace(some, "[^\\p{L}]+", "")).cast("long"),
    }


def repeated_words(hashes: str) -> Column:
    """How many words of an array of hashes lie in a run of five that occurs twice or more, the first one included.

    Runs are compared by hash. Most texts repeat none, which a count of distinct runs shows; only for the others are
    the runs sorted, those with an equal neighbour taken, and the words they cover counted in order of position.
    """
    h = F.col(hashes)
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    runs = F.transform(starts, lambda first, i: F.xxhash64(first, *(F.get(h, i + k) for k in range(1, WINDOW))))

    def covered(found: Column) -> Column:
        by_run = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("run"), i.alias("at"))))
        return F.aggregate(
            F.transform(F.array(by_run), lambda s: F.sort_array(F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["run"] == x["run"]) | F.coalesce(F.get(s, i + 1)["run"] == x["run"], F.lit(False))), lambda x: x["at"]))),
            F.lit(0),
            lambda acc, at: acc + F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1), p + WINDOW) - p, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y),
        )

    one = F.transform(F.array(runs), lambda r: F.when(F.size(r) == F.size(F.array_distinct(r)), F.lit(0)).otherwise(covered(r)))
    return F.get(one, F.lit(0)).cast("long")


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the figures as columns."""
    own = figures(F.col(text))
    steps = [["_words", "_lines", "word_chars", "n_symbols", "n_upper", "n_letters"], ["n_words", "n_dup_lines", "n_lines", "_hashes"], ["n_distinct_words", "n_repeat_words"]]
    for names in steps:
        df = df.withColumns({c: own[c] for c in names})
    return df.drop("_words", "_lines", "_hashes")


@dataclass(frozen=True)
class Rule:
    """A vote on the figures: bad where ``bad`` holds, else good where ``good`` holds, else none."""

    name: str
    good: str
    bad: str


#: One rule for each kind of badness: rules that see the same thing would count it twice.
RULES = (
    Rule("length", "n_words >= 50", "n_words < 15"),
    Rule("symbols", "n_symbols * 100 <= n_words", "n_symbols * 10 > n_words"),
    Rule(
        "repetition",
        "n_repeat_words * 50 <= n_words AND n_dup_lines * 20 <= n_lines",
        "n_repeat_words * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR n_words >= 50 AND n_distinct_words * 100 < n_words * 20",
    ),
    Rule("word_length", "word_chars BETWEEN n_words * 3 AND n_words * 10", "word_chars < n_words * 2 OR word_chars > n_words * 14"),
    Rule("capitals", "n_upper * 8 <= n_letters", "n_upper * 2 > n_letters"),
    Rule("letters", "n_letters * 100 >= word_chars * 88", "n_letters * 100 < word_chars * 75"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).cast("int").alias(f"vote_{r.name}") for r in rules]


def base_failed() -> Column:
    """The fixed rules that no vote can overrule."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Trust:
    """The estimated share of good documents and, for each rule, how often its vote is right on good and on bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weight(self, i: int) -> tuple[float, float]:
        """What a good and a bad vote of rule i add to the log odds of a good document."""
        return math.log(self.on_good[i] / (1 - self.on_bad[i])), math.log((1 - self.on_good[i]) / self.on_bad[i])

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        total = math.log(self.good / (1 - self.good))
        for i, v in enumerate(pattern):
            total += self.weight(i)[0] if v > 0 else self.weight(i)[1] if v < 0 else 0.0
        return total


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> Trust:
    """Expectation-maximisation over the counts of vote patterns, with the starting accuracies as a prior."""
    trust = Trust(START_GOOD, (START_ACCURACY[0],) * n_rules, (START_ACCURACY[1],) * n_rules)
    ordered = sorted(patterns.items())
    weight = START_WEIGHT + PRIOR_SHARE * sum(patterns.values())
    for _ in range(rounds):
        share_of = [0.0, 0.0]
        right = [[start * weight] * n_rules for start in START_ACCURACY]
        voted = [[weight] * n_rules for _ in START_ACCURACY]
        for pattern, n in ordered:
            p = 1 / (1 + math.exp(-trust.log_odds(pattern)))
            for side, share in enumerate((p, 1 - p)):
                share_of[side] += n * share
                for i, v in enumerate(pattern):
                    if v:
                        voted[side][i] += n * share
                        right[side][i] += n * share * (v == (1, -1)[side])
        on_good, on_bad = ([r / v for r, v in zip(right[s], voted[s], strict=True)] for s in (0, 1))
        good = (share_of[0] + START_GOOD * weight) / (sum(share_of) + weight)
        new = Trust(good, tuple(on_good), tuple(on_bad))
        if new == trust:
            break
        trust = new
    return trust


def learned(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> Trust:
    """The trust in each rule, from the votes of all rows of ``df`` (with figures) on which the fixed rules leave a choice."""
    names = [f"vote_{r.name}" for r in rules]
    counts = df.where(~base_failed()).select(*votes(rules)).groupBy(*names).count().collect()  # 3 ** len(rules) rows at most
    return estimate({tuple(row[c] for c in names): row["count"] for row in counts}, len(rules))


def posterior(trust: Trust, rules: tuple[Rule, ...] = RULES) -> Column:
    """The probability that a document with these votes is good."""
    odds = F.lit(math.log(trust.good / (1 - trust.good)))
    for i, r in enumerate(rules):
        good, bad = trust.weight(i)
        odds = odds + F.when(F.col(f"vote_{r.name}") > 0, good).when(F.col(f"vote_{r.name}") < 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) with figures, votes, ``base_failed``, ``quality`` (the posterior) and ``kept``.

    The figures are computed once and written to the shared folder: trust is learned from them and then applied to
    them, and no later filter can be pushed below them, which would compute them again for every use.

    Null text counts as empty: no words, so it fails the fixed rules. Columns of ``df`` with the same names are
    replaced. Repeated rows are judged alike and each counts. An empty table gives no rows and the prior's trust.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in FIGURES]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).alias("none"))
    measured = written(with_figures(df.select(own.alias("own"), F.col(f"`{text}`").alias("text"))).select(*(F.col("own")[c].alias(c) for c in kept), *FIGURES), "quality-figures")
    trust = learned(measured, rules)
    voted = measured.withColumns({f"vote_{r.name}": v for r, v in zip(rules, votes(rules), strict=True)})
    return voted.withColumns({"base_failed": base_failed(), "quality": posterior(trust, rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def kept_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with their own columns only."""
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")
    return judged(df.select(own, F.col(text).alias("text")), keep=("own",)).where("kept").select("own.*")
