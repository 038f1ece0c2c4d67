"""Quality rules: learned decision lists over natively computed statistics.

Sequential covering on labelled documents: a conjunction of thresholds is grown
literal by literal by FOIL gain on two thirds of the labelled rows, pruned to
the prefix that does best on the last third, and kept if it is precise there;
rows it covers leave and the next one is grown.  Each step is one grouped count
over binned statistics; only a few hundred counts reach the driver.  The list is
applied as one ordered Spark conditional expression, so the data path is
DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm._io import Scratch, shielded, table

WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

FEATURES = ["n_words", "mean_word", "symbol_rate", "bang_rate", "upper_rate", "digit_rate", "distinct_rate", "dup_line_rate", "repeat_rate"]


@dataclass(frozen=True)
class Settings:
    """Learning parameters; none depends on the size of the input."""

    levels: int = 24  #: thresholds tried for each feature and class
    most_rules: int = 8
    most_literals: int = 3
    least_precision: float = 0.95  #: by Laplace's estimate, so a rule needs support too
    least_covered: int = 2
    most_labelled: int = 50_000  #: labelled documents learned from, about; more are sampled by a hash of their id


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def column(self, row: Column | None = None) -> Column:
        """The test on a feature column, or on a field of the struct ``row``."""
        value = F.col(self.feature) if row is None else row[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rolled(words: Column) -> Column:
    """Hashes of all windows of eight consecutive words."""

    def doubled(h: Column, step: int) -> Column:
        return _let(h, lambda x: F.zip_with(x, F.slice(x, F.lit(step + 1), F.greatest(F.size(x), F.lit(1))), lambda a, b: F.xxhash64(a, b)))

    one = F.transform(words, lambda w: F.xxhash64(w))
    return _let(doubled(doubled(doubled(one, 1), 2), 4), lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - (WINDOW_WORDS - 1), F.lit(0))))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, first occurrence included."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        return F.filter(p, lambda x, j: F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)))

    starts = F.array_sort(F.transform(_let(placed, repeated), lambda x: x["i"]))
    steps = _let(starts, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    return F.when(F.size(words) <= WINDOW_WORDS, F.lit(0)).otherwise(
        _let(_rolled(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    )


def measures(text: Column) -> Column:
    """A text's base statistics and rule features as one struct.

    A null text has no words and zero everywhere.  Rates over nothing are zero.
    Every part is bound once, so a filter on the struct computes no part twice.
    """
    held = F.coalesce(text, F.lit(""))
    parts = F.struct(held.alias("text"), F.array_remove(F.split(held, r"[\x20\x09-\x0D]+"), "").alias("words"))

    def counted(p: Column) -> Column:
        lines = F.filter(F.split(p["text"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(p["words"]).cast("long").alias("n_words"),
            F.length(F.array_join(p["words"], "")).cast("long").alias("word_chars"),
            F.regexp_count(p["text"], F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(p["words"]).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(p["words"])).alias("distinct"),
            F.regexp_count(p["text"], F.lit("!")).alias("bangs"),
            F.regexp_count(p["text"], F.lit(r"\p{Lu}")).alias("upper"),
            F.regexp_count(p["text"], F.lit(r"[0-9]")).alias("digits"),
        )

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    def rated(c: Column) -> Column:
        n, chars = c["n_words"], c["word_chars"]
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["lines"]["dup"].cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            rate(chars, n).alias("mean_word"),
            rate(c["n_symbols"], n).alias("symbol_rate"),
            rate(c["bangs"], n).alias("bang_rate"),
            rate(c["upper"], chars).alias("upper_rate"),
            rate(c["digits"], chars).alias("digit_rate"),
            rate(c["distinct"], n).alias("distinct_rate"),
            rate(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_rate"),
            rate(c["n_repeat_words"], n).alias("repeat_rate"),
            ((n < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * n)).alias("base_failed"),
        )

    return _let(_let(parts, counted), rated)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the `measures` of each text.

    A column of ``keep`` that has the name of a measure is ``_kept_<name>``.
    """
    held = docs.select(*keep, measures(F.col("text")).alias("_measures"))
    names = held.schema["_measures"].dataType.fieldNames()
    passed, _ = shielded(docs.select(*keep), *(n.lower() for n in names), "_measures")
    renamed = [F.col(a).alias(b) for a, b in zip(keep, passed.columns, strict=True)]
    return docs.select(*renamed, measures(F.col("text")).alias("_measures")).select(*passed.columns, "_measures.*")


def _thresholds(labelled: DataFrame, levels: int) -> dict[str, list[float]]:
    """Values to cut each feature at: quantiles of both classes, and midpoints."""
    at = F.array(*[F.lit(k / (levels + 1)) for k in range(1, levels + 1)])
    rows = labelled.groupBy("bad").agg(*[F.percentile_approx(F.col(f).cast("double"), at, F.lit(10_000)).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({v for r in rows for v in r[f] or []}) for f in FEATURES}
    return {f: sorted({*c, *((a + b) / 2 for a, b in zip(c, c[1:], strict=False))}) for f, c in cuts.items()}


def known_labels(labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, bad): one row for each document that is learned from.

    Rows with a null in either column are ignored; a document labelled twice
    counts as bad if any of its labels is 0.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    every = -(-known.count() // settings.most_labelled) or 1
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(every)) == 0)


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> list[list[Literal]]:
    """An ordered list of conjunctions that reject documents of quality 0.

    Only documents that `known_labels` names count.  Without a bad label the list
    is empty.
    """
    known = known_labels(labels, settings)
    labelled = scratch.save(stats.join(known, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("hold"), *FEATURES), "labelled")
    cuts = _thresholds(labelled, settings.levels)

    def binned(f: str) -> Column:
        upto = F.filter(F.array(*[F.lit(float(t)) for t in cuts[f]]), lambda t: t <= F.col(f))
        return F.struct(F.lit(f).alias("f"), F.size(upto).alias("bin"))

    bins = F.array(*[binned(f) for f in FEATURES if cuts[f]])
    rules: list[list[Literal]] = []
    left = labelled

    def counts(df: DataFrame) -> tuple[dict, int, int]:
        held: dict = {}
        for f, k, p, n in df.select("bad", F.explode(bins).alias("b")).groupBy("b.f", "b.bin").agg(F.count_if("bad"), F.count_if(~F.col("bad"))).collect():
            held.setdefault(f, {})[k] = (p, n)
        first = next(iter(held.values()), {})
        return held, sum(x[0] for x in first.values()), sum(x[1] for x in first.values())

    if not any(cuts.values()):
        return rules
    while len(rules) < settings.most_rules:
        rule: list[Literal] = []
        here = left.where("not hold")
        while len(rule) < settings.most_literals:
            held, p, n = counts(here)
            if p < settings.least_covered or n == 0:
                break
            best, gain = None, 1e-9
            for f in FEATURES:
                below_p = below_n = 0
                for k, t in enumerate(cuts[f]):
                    a, b = held.get(f, {}).get(k, (0, 0))
                    below_p, below_n = below_p + a, below_n + b
                    for at_least, x, y in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                        if x >= settings.least_covered and x + y < p + n:
                            now = x * (log2(x / (x + y)) - log2(p / (p + n)))
                            if now > gain:
                                best, gain = Literal(f, at_least, t), now
            if best is None:
                break
            rule.append(best)
            here = here.where(best.column())
        if not rule:
            break
        # prune to the prefix with the best worth on the held rows
        sums, upto = [], F.lit(True)
        for k, literal in enumerate(rule):
            upto = upto & literal.column()
            for hold in (True, False):
                inside = upto & (F.col("hold") == hold)
                sums += [F.count_if(inside & F.col("bad")).alias(f"p{k}{hold}"), F.count_if(inside & ~F.col("bad")).alias(f"n{k}{hold}")]
        got = left.agg(*sums).first().asDict()
        worth = lambda k: (got[f"p{k}True"] - got[f"n{k}True"]) / max(1, got[f"p{k}True"] + got[f"n{k}True"])
        last = max(range(len(rule)), key=lambda k: (worth(k), -k))
        p, n = (got[f"{x}{last}True"] + got[f"{x}{last}False"] for x in "pn")
        if p < settings.least_covered or p + 1 < settings.least_precision * (p + n + 2) or worth(last) < 0:
            break
        rules.append(rule[: last + 1])
        left = left.where(~_all(rules[-1]))
    return rules


def _all(rule: list[Literal], row: Column | None = None) -> Column:
    out = rule[0].column(row)
    for literal in rule[1:]:
        out = out & literal.column(row)
    return out


def verdict(rules: list[list[Literal]], row: Column | None = None) -> Column:
    """True to keep: the ordered list as one conditional expression."""
    out = F.when(F.col("base_failed") if row is None else row["base_failed"], F.lit(False))
    for rule in rules:
        out = out.when(_all(rule, row), F.lit(False))
    return out.otherwise(F.lit(True))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base statistics, the base verdict and the learned one.

    A null or empty text has no words and fails the base rules; rows that repeat
    a doc_id are judged one by one.
    """
    scratch = Scratch(spark, "op4")
    stats = scratch.save(statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "stats")
    rules = learn(stats, table(spark, sf_dir, "labels"), scratch)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(rules).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that the base rules or the learned list reject.

    The list is learned from the documents that ``labels`` names; theirs are the
    only statistics computed for it.  A null text has no words and goes.  Rows
    that repeat a doc_id are judged one by one.  All columns pass through.
    """
    scratch = Scratch(spark, "quality")
    named = docs.select("doc_id", "text").join(known_labels(labels, settings), "doc_id", "left_semi")
    rules = learn(statistics(named, ["doc_id"]), labels, scratch, settings)
    return docs.where(_let(measures(docs.text), lambda m: verdict(rules, m)))
