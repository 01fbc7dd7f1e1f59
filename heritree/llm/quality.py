"""Quality rules as a short-circuit cascade.

Every rule is a condition on a text; a text is rejected by the first that holds. Order doesn't change the verdict, only
the work: on a sample, each rule is timed and its rejections are counted, and rules run in the order of rejections per
second, so that cheap and sharp ones spare the texts the dear ones. Figures that are there already cost a rule nothing.
DataFrame functions only.

Words are runs of anything but ASCII white space. Defined results: a null, empty or blank text has no words and fails
the rule on few words; null ids are ids like others; equal rows are judged alike; an empty table gives no rows, and the
cascade keeps the written order; other columns pass through `kept_rows` and are ignored by the report.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, n_space_words, stored

#: The order of the rules is fitted on about so many rows of at most so many files.
SAMPLE_ROWS, SAMPLE_FILES = 2000, 16
FEW = 12  # repeated windows of a text that others are compared with one by one
MIN_WORDS, MAX_WORDS, MAX_REPEATED = 50, 200_000, 0.5
MAX_SYMBOLS, MAX_DUP_LINES, MEAN_WORD, MAX_UPPER, MIN_ALPHA = 0.1, 0.4, (2, 12), 0.6, 0.7
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """rejects: of the text and of `figure`, which gives the named figures of FIGURES, computed before or on the spot."""

    name: str
    rejects: Callable[[Column, Callable[[str], Column]], Column]


def _count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex)).cast("long")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return _count(text, "[#*$%&|<>]")


def lines(text: Column) -> Column:
    """Lines with a word, and how many of them equal an earlier one."""
    full = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def repeated_of(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hashes within one text.

    Hashes are sorted as plain numbers to see which repeat. Mostly few do, and the windows are looked up among them; where
    many do, the hashes are sorted with their places.
    """
    hashes = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2))))
    again = lambda h: let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")))["n"]
    among = lambda h, found: covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(found, x), i)), F.isnotnull))
    twice = lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), F.isnotnull)
    sorted_out = lambda h: let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: covered(F.sort_array(twice(s))))
    found = let(hashes(words), lambda h: let(again(h), lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= FEW, among(h, d)).otherwise(sorted_out(h))))
    return F.when(F.size(words) > 3, found).otherwise(0).cast("long")


#: Of a text. The first is given to all rules; the others are computed by the rule that asks, where they aren't there already.
FIGURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_space_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": lambda t: lines(t)["n_lines"],
    "n_dup_lines": lambda t: lines(t)["n_dup_lines"],
    "n_repeat_words": lambda t: let(_words(t), repeated_of),
}


def _upper(text: Column, _) -> Column:
    return _count(text, "[A-Z]") > MAX_UPPER * F.char_length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def _alpha(text: Column, figure) -> Column:
    return _count(text, r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*") < MIN_ALPHA * figure("n_words")


def _dup_lines(text: Column, figure) -> Column:
    return figure("n_dup_lines") > MAX_DUP_LINES * figure("n_lines")


RULES = [
    Rule("few words", lambda _, f: f("n_words") < MIN_WORDS),
    Rule("many words", lambda _, f: f("n_words") > MAX_WORDS),
    Rule("repeated words", lambda _, f: 100 * f("n_repeat_words") > 100 * MAX_REPEATED * f("n_words")),
    Rule("symbols", lambda _, f: f("n_symbols") > MAX_SYMBOLS * f("n_words")),
    Rule("repeated lines", _dup_lines),
    Rule("word length", lambda _, f: ~f("word_chars").between(MEAN_WORD[0] * f("n_words"), MEAN_WORD[1] * f("n_words"))),
    Rule("capitals", _upper),
    Rule("words without letters", _alpha),
]


def _figures(text: Column, given: dict[str, Column]) -> Callable[[str], Column]:
    return lambda name: given[name] if name in given else FIGURES[name](text)


def _clock() -> Column:
    """Nanoseconds of the executor's clock, read anew for each row."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def _some_files(docs: DataFrame, seed: int) -> DataFrame:
    """docs of SAMPLE_FILES of its files at most, chosen by seed, where it is read from more; else all of it."""
    files = sorted(docs.inputFiles())
    if len(files) <= SAMPLE_FILES:
        return docs
    try:
        return docs.where(F.col("_metadata.file_path").isin(random.Random(seed).sample(files, SAMPLE_FILES)))
    except AnalysisException:  # not a plain scan
        return docs


def measured(docs: DataFrame, rules: list[Rule], given: tuple[str, ...] = ("n_words",), rows: int = SAMPLE_ROWS, seed: int = 42) -> dict[str, tuple[int, int]]:
    """For each rule how many of about `rows` texts of a few files it rejects, and its median nanoseconds a text, in one job.

    Each rule stands between two readings of the clock inside one lambda, as the cascade itself does: what stands there is
    computed in its place, where Spark would else compute what occurs twice ahead of all. The median is moved neither by a
    first compilation nor by a pause. The figures `given` are there before, and the rules pay for the others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = _some_files(docs, seed)
    total = some.count()
    sample = (some.sample(min(1.0, rows / total), seed) if total else some).select(text.alias("text"))
    sample = stored(sample.select("text", *[FIGURES[f](F.col("text")).alias(f"f_{f}") for f in given]), "quality-sample")

    def steps(x: Column) -> Column:
        figure = _figures(x["text"], {f: x[f"f_{f}"] for f in given})
        each = [s for k, r in enumerate(rules) for s in (F.coalesce(r.rejects(x["text"], figure), F.lit(False)).alias(f"r{k}"), _clock().alias(f"t{k}"))]
        return F.struct(_clock().alias("t"), *each)

    timed = sample.select(let(F.struct(*sample.columns), steps).alias("s"))
    took = lambda k: F.col(f"s.t{k}") - F.col(f"s.t{k - 1}" if k else "s.t")
    seen = timed.agg(*[F.count_if(f"s.r{k}").alias(f"n{k}") for k in range(len(rules))], *[F.percentile_approx(took(k), 0.5).alias(f"ns{k}") for k in range(len(rules))]).first()
    return {r.name: (seen[f"n{k}"], max(1, seen[f"ns{k}"] or 0)) for k, r in enumerate(rules)}


def ordered(docs: DataFrame, rules: list[Rule] | None = None, rows: int = SAMPLE_ROWS, seed: int = 42, given: tuple[str, ...] = ("n_words",)) -> list[Rule]:
    """The rules by rejections per cost, both measured on a sample."""
    rules = RULES if rules is None else rules
    seen = measured(docs, rules, given, rows, seed)
    return sorted(rules, key=lambda r: -seen[r.name][0] / seen[r.name][1])


def verdict(text: Column, rules: list[Rule], given: dict[str, Column] | None = None) -> Column:
    """The name of the first rule of the cascade that rejects the text, or null. Later rules aren't computed then.

    given: figures of FIGURES that are there already; others are computed by the rules that ask for them.
    """

    def cascade(t: Column, figure) -> Column:
        out = F.when(rules[0].rejects(t, figure), rules[0].name)
        for r in rules[1:]:
            out = out.when(r.rejects(t, figure), r.name)
        return out

    text = F.coalesce(text, F.lit(""))
    if given:
        return cascade(text, _figures(text, given))
    return let(F.struct(text.alias("t"), n_space_words(text).alias("n")), lambda x: cascade(x["t"], _figures(x["t"], {"n_words": x["n"]})))


def kept_rows(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects."""
    return docs.where(verdict(F.col("text").cast("string"), ordered(docs, rules)).isNull())


def quality_report(docs: DataFrame) -> DataFrame:
    """Figures of every document and the cascade's verdict. The base figures are asked for all rows, so only the rules on others are spared."""
    base = ("few words", "repeated words")
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    cascade = ordered(docs, [r for r in RULES if r.name not in base], given=(*figures, "n_lines"))
    stats = let(
        F.coalesce(F.col("text").cast("string"), F.lit("")),
        lambda t: let(
            _words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                n_symbols(t).alias("n_symbols"),
                lines(t).alias("lines"),
                repeated_of(w).alias("n_repeat_words"),
            ),
        ),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = docs.select("doc_id", "text", stats.alias("s")).select("doc_id", "text", "s.*").select("*", "lines.n_lines", "lines.n_dup_lines").withColumn("base_failed", failed)
    kept = verdict(F.col("text").cast("string"), cascade, {f: F.col(f) for f in (*figures, "n_lines")}).isNull()
    return out.select("doc_id", *figures, "base_failed", F.when(F.col("base_failed"), False).otherwise(kept).alias("kept"))
