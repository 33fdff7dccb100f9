"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Every document gets plain text measures. A rule rejects a document when its
measure exceeds the cutoff of the document's stratum (its language). Cutoffs are
not chosen by hand: for each stratum and rule a fixed ladder of cutoffs, from
mild to strict, is tested on labelled holdout documents of good quality. With k
of n good documents rejected, the exact binomial p-value of "the false rejection
rate is above alpha" is P[Bin(n, alpha) <= k]. As k grows along the ladder, the
p-values do too, so testing in that fixed order needs no correction within a
ladder; between the ladders (strata times rules) the level is divided by their
number (Bonferroni). The strictest certified cutoff is taken; with too few labels
nothing is certified and the rule rejects nothing in that stratum. The chance
that any stratum's rule rejects more than its share of good documents is at most
``delta``; all rules together reject at most ``alpha`` of a stratum's good
documents.

That certifies nothing for a stratum of few labels, even where no good document is
rejected. With ``joint``, such a stratum, told by its number of labels alone, gets
one ladder instead: nested sets of cutoffs of all rules together, from mild to
strict, whose joint rejections are tested against alpha at the same level.

Defined results: null text counts as empty, a null language is the stratum
``und``, labels with a null id or quality are no labels, repeated labels of a
document count by the lowest quality, repeated documents each get their row. A
document without 50 words fails the base rules. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import private, saved

_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class RiskConfig:
    alpha: float = 0.02  #: bound on a stratum's false rejections, all rules together
    delta: float = 0.05  #: chance that any bound fails
    joint: bool = False  #: strata with too few labels for single rules are tested for all rules at once
    most_strata: int = 10_000  #: above this the cutoffs are joined by shuffle, not broadcast
    ladders: dict = field(
        default_factory=lambda: {
            "symbols": (2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
            "upper": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
            "repeats": (0.5, 0.45, 0.4, 0.35, 0.3),
            "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5),
        }
    )


def _repeat_words(words: str, keys: str) -> Column:
    """Words that lie in a three-word window found at least twice.

    keys holds a 64-bit hash per window, at its position. Sorting (hash, position)
    brings equal windows together; their positions, sorted again, are merged.
    """
    return F.expr(f"""
        CASE WHEN size({keys}) = 0 OR size(array_distinct({keys})) = size({keys}) THEN 0L ELSE
        aggregate(
          array_sort(transform(filter(transform(
            array(array_sort(transform({keys}, (k, i) -> struct(k AS k, i AS i)))),
            s -> transform(filter(transform(s, (x, j) -> struct(x.i AS i,
                   (j > 0 AND s[greatest(j - 1, 0)].k = x.k) OR (j + 1 < size(s) AND s[least(j + 1, size(s) - 1)].k = x.k) AS twice)),
                 y -> y.twice), y -> y.i)), z -> true)[0], p -> p)),
          named_struct('n', 0L, 'upto', 0),
          (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.upto), 'upto', p + 3),
          a -> a.n) END""")


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each evaluated once a row.

    A generator stands between them and what follows: filters on the columns would
    otherwise be pushed below and evaluate them again, inside of each other.
    """
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def with_measures(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the measures as extra columns, and the measures' column names."""
    names = ("t", "words", "keys", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
    at = dict(zip(names, private(df, *names), strict=True))
    c = {k: f"`{v}`" for k, v in at.items()}
    count = lambda pattern: F.length(F.regexp_replace(F.col(at["t"]), pattern, "")).cast("long")
    df = _once(df, {at["t"]: F.coalesce(F.col(text).cast("string"), F.lit(""))})
    df = _once(
        df,
        {
            at["words"]: F.expr(f"filter(split({c['t']}, '[{_SPACE}]+'), w -> w <> '')".replace("\\", "\\\\")),
            at["lines"]: F.expr(f"filter(split({c['t']}, '\\n'), l -> l rlike '[^{_SPACE}]')".replace("\\x", "\\\\x")),
        },
    )
    df = _once(df, {at["keys"]: F.expr(f"CASE WHEN size({c['words']}) < 3 THEN array() ELSE transform(sequence(0, size({c['words']}) - 3), i -> xxhash64({c['words']}[i], {c['words']}[i + 1], {c['words']}[i + 2])) END")})
    df = _once(
        df,
        {
            at["n_words"]: F.size(at["words"]).cast("long"),
            at["word_chars"]: F.length(at["t"]) - count(f"[^{_SPACE}]+"),
            at["n_symbols"]: count(r"[^#*$%&|<>]+"),
            at["n_upper"]: count(r"[^\p{Lu}]+"),
            at["n_lines"]: F.size(at["lines"]).cast("long"),
            at["n_dup_lines"]: (F.size(at["lines"]) - F.size(F.array_distinct(at["lines"]))).cast("long"),
            at["n_repeat_words"]: _repeat_words(c["words"], c["keys"]),
        },
    )
    return df.drop(at["t"], at["words"], at["keys"], at["lines"]), {k: at[k] for k in names[4:]}


def base_failed(m: dict[str, str]) -> Column:
    n = F.col(m["n_words"])
    return (n < 50) | (100 * F.col(m["n_repeat_words"]) > 50 * n)


def scores(m: dict[str, str]) -> dict[str, Column]:
    """What the rules look at; larger is worse."""
    share = lambda a, b: F.col(m[a]) / F.greatest(F.col(m[b]), F.lit(1))
    return {"symbols": share("n_symbols", "n_words"), "upper": share("n_upper", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def joint_sets(config: RiskConfig) -> list[dict[str, float]]:
    """Cutoffs by rule, from mild to strict; each set rejects what the ones before it reject."""
    most = max(map(len, config.ladders.values()))
    return [{r: cs[(j + 1) * len(cs) // most - 1] for r, cs in config.ladders.items() if (j + 1) * len(cs) >= most} for j in range(most)]


def certified_cutoffs(measured: DataFrame, m: dict[str, str], stratum: str, doc_id: str, labels: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Rows (stratum, rule, cutoff, n, rejected, p_value) of the strictest certified cutoffs; rules that are tested together share the last three."""
    held = measured.where(~base_failed(m)).select(F.col(f"`{doc_id}`").alias("__doc"), F.col(stratum).alias("stratum"), *(v.alias(f"__s_{k}") for k, v in scores(m).items()))
    held = held.join(_good(labels), F.col("__doc") == F.col("__label_id"), "inner")
    sums = [F.sum(F.when(F.col(f"__s_{r}") > c, 1).otherwise(0)).alias(f"__k_{r}_{j}") for r, cs in config.ladders.items() for j, c in enumerate(cs)]
    sets = joint_sets(config) if config.joint else []
    sums += [F.sum(F.when(reduce(or_, (F.col(f"__s_{r}") > c for r, c in x.items())), 1).otherwise(0)).alias(f"__k_{j}") for j, x in enumerate(sets)]
    counts = saved(held.groupBy("stratum").agg(F.count("*").alias("n"), *sums))  # a row per stratum
    cell = lambda r, j, c, k: F.struct(F.lit(r).alias("rule"), F.lit(j).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(k).alias("rejected"))
    cells = F.array(*(cell(r, j, c, f"__k_{r}_{j}") for r, cs in config.ladders.items() for j, c in enumerate(cs)))
    a, ladders = F.lit(config.alpha / len(config.ladders)), len(config.ladders) * max(1, counts.count())
    if sets:
        few = F.col("n") * F.log1p(-a) > F.log(F.lit(config.delta / ladders))
        cells = F.when(few, F.array(*(cell(r, j, c, f"__k_{j}") for j, x in enumerate(sets) for r, c in x.items()))).otherwise(cells)
        a = F.when(few, config.alpha).otherwise(a)
    p = F.expr("""CASE WHEN rejected >= n * __a THEN 1D ELSE aggregate(sequence(0L, rejected), named_struct('lt', n * ln(1D - __a), 's', 0D),
        (acc, i) -> named_struct('lt', acc.lt + ln((n - i) / (i + 1)) + ln(__a / (1D - __a)), 's', acc.s + exp(acc.lt)), acc -> acc.s) END""")
    tested = counts.select("stratum", "n", a.alias("__a"), F.inline(cells)).withColumn("p_value", p)
    passed = tested.where(F.col("p_value") <= config.delta / ladders)
    return passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "rejected", "p_value"), "step").alias("best")).select("stratum", "rule", "best.*")


def _good(labels: DataFrame) -> DataFrame:
    """Ids of the documents that the labels call good."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy(F.col("doc_id").alias("__label_id")).agg(F.min("quality").alias("__quality")).where("__quality = 1").select("__label_id")


def _wide(cutoffs: DataFrame, names: dict[str, str], config: RiskConfig) -> DataFrame:
    cut = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(names[r]) for r in config.ladders]
    wide = saved(cutoffs.groupBy(F.col("stratum").alias(names["stratum"])).agg(*cut))
    return F.broadcast(wide) if wide.count() <= config.most_strata else wide


def judged(measured: DataFrame, m: dict[str, str], stratum: str, cutoffs: DataFrame, config: RiskConfig = RiskConfig()) -> tuple[DataFrame, Column]:
    """measured beside its stratum's cutoffs, and the verdict as a column."""
    names = dict(zip(["stratum", *config.ladders], private(measured, "cut_stratum", *(f"cut_{r}" for r in config.ladders)), strict=True))
    joined = measured.join(_wide(cutoffs, names, config), F.col(stratum) == F.col(names["stratum"]), "left")
    rejected = F.lit(False)
    for r, s in scores(m).items():
        rejected = rejected | F.coalesce(s > F.col(names[r]), F.lit(False))
    return joined, ~(base_failed(m) | rejected)


def quality_verdicts(docs: DataFrame, labels: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """One row per document: its measures, base_failed and kept."""
    slim = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"))
    measured, m = with_measures(slim)
    measured = saved(measured.drop("text"))  # small; both passes below read it
    joined, kept = judged(measured, m, "stratum", certified_cutoffs(measured, m, "stratum", "doc_id", labels, config), config)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return joined.select("doc_id", *(F.col(m[k]).alias(k) for k in shown), base_failed(m).alias("base_failed"), kept.alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were.

    The cutoffs are learned from the labelled rows alone, so the long texts are
    measured once where they stand and never move.
    """
    of_lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    held = docs.select("doc_id", "text", of_lang.alias("stratum")).join(_good(labels), F.col("doc_id") == F.col("__label_id"), "left_semi")
    known, m = with_measures(held)
    cutoffs = certified_cutoffs(known, m, "stratum", "doc_id", labels, config)
    stratum, = private(docs, "stratum")
    measured, m = with_measures(docs.withColumn(stratum, of_lang))
    joined, kept = judged(measured, m, stratum, cutoffs, config)
    return joined.where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
