"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs them.

Every rule is a pair of thresholds on one statistic: good on one side, bad on the other, no vote between.  All
documents are reduced to counts of vote patterns (a rule has three answers, so there are 3^rules patterns at most,
whatever the number of documents).  Expectation-maximisation over these counts estimates how often each rule is
right on good and on bad documents, and how many documents are good; a document is kept when its posterior probability of being good is at
least one half and the two fixed rules let it pass.

Only DataFrame functions.  Repeated windows of eight words are found by hashes inside the row: a text without any
repetition stops after one pass, in the others the hashes are sorted with their places.

Null texts count as empty; a text without words has no votes but the one on its length.  Repeated rows, ties and null
identifiers are kept as they are; only the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import SPACE_CHARS, let, saved, table, words_of

WINDOW = 8
ROUNDS, TOLERANCE = 25, 1e-4
FIRST_HIT, FIRST_ALARM, FIRST_GOOD = 0.95, 0.3, 0.85
BELIEF = 0.02
#: Classes of characters that are counted; a count by pattern is much cheaper than a text without them.
SYMBOLS, MARKS, CAPITALS, NO_LETTERS = "[#*$%&|<>]", "[.,;:!?]", "[A-ZÄÖÜÉÈÊÇÑÍÓ]", "[!-@\\[-`{-~]"
SPACES, NO_SPACES = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Frequent function words of four languages.
FUNCTION_WORDS = ("the of and to in is that for with as de la le et les des est que der die und das ist nicht zu den el los las en un por con del").split()


def window_hashes(words: Column, size: int) -> Column:
    """A hash of every ``size`` successive words; none for fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= size, let(hashes, lambda a: F.transform(
        F.sequence(F.lit(0), F.size(a) - size), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(size)])))).otherwise(F.array().cast("array<bigint>"))


def covered(hashes: Column, size: int) -> Column:
    """Number of words within windows whose hash occurs twice or more."""
    def by_place(z):
        at = F.transform(z, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(z, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(z, k + 1)["h"] == x["h"], F.lit(False))).alias("twice")))
        return F.sort_array(F.transform(F.filter(at, lambda x: x["twice"]), lambda x: x["i"]))

    places = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_place)
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("sum"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(size), x - acc["last"])).alias("sum"))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.aggregate(places, start, step, lambda acc: acc["sum"])).otherwise(0)


def count(pattern: str) -> Column:
    """Matches of a pattern in the text."""
    return F.regexp_count("t", F.lit(pattern)).cast("long")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules look at, one row per document."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    rows = rows.select("doc_id", "t", "w", window_hashes(F.col("w"), WINDOW).alias("h"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"))
    long = lambda c: c.cast("long")
    word_chars = F.length("t") - count(SPACES)
    return rows.select(
        "doc_id",
        long(F.size("w")).alias("n_words"),
        long(word_chars).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(covered(F.col("h"), WINDOW)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        count(CAPITALS).alias("n_capitals"),
        long(F.size(F.array_distinct("w"))).alias("n_distinct"),
        long(F.size(F.array_intersect("w", F.array(*map(F.lit, FUNCTION_WORDS))))).alias("n_function_words"),
        count(MARKS).alias("n_marks"),
        long(word_chars - count(NO_LETTERS)).alias("n_letters"),
        count(SYMBOLS + NO_SPACES + "*").alias("n_symbol_words"),  # from its first symbol a word matches to its end
    )


def share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """By name: when a rule says good, and when it says bad."""
    words, mean = F.col("n_words"), share("word_chars", "n_words")
    enough = words >= 20
    return {
        "length": (words >= 50, words < 20),
        "word_length": (enough & mean.between(3, 9), enough & ((mean < 2) | (mean > 12))),
        "symbols": (enough & (share("n_symbols", "word_chars") < 0.01), enough & (share("n_symbols", "word_chars") > 0.1)),
        "lines": (enough & (share("n_dup_lines", "n_lines") == 0), enough & (share("n_dup_lines", "n_lines") > 0.3)),
        "windows": (enough & (share("n_repeat_words", "n_words") < 0.05), enough & (share("n_repeat_words", "n_words") > 0.3)),
        "capitals": (enough & (share("n_capitals", "word_chars") < 0.2), enough & (share("n_capitals", "word_chars") > 0.5)),
        "variety": (enough & (F.col("n_distinct") >= F.least(F.sqrt(words), F.lit(20.0))), enough & (F.col("n_distinct") < 0.1 * F.least(words, F.lit(200)))),
        "function_words": ((words >= 50) & (F.col("n_function_words") >= 3), (words >= 50) & (F.col("n_function_words") == 0)),
        "letters": (enough & (share("n_letters", "word_chars") >= 0.85), enough & (share("n_letters", "word_chars") < 0.75)),
        "symbol_words": (enough & (share("n_symbol_words", "n_words") < 0.05), enough & (share("n_symbol_words", "n_words") > 0.3)),
        "marks": (enough & share("n_marks", "n_words").between(0.02, 0.4), enough & (share("n_marks", "n_words") > 1)),
    }


def votes(stats: DataFrame) -> DataFrame:
    """Adds ``vote_<rule>``: 1 good, 0 bad, null where the rule abstains."""
    return stats.withColumns({f"vote_{name}": F.when(bad, 0).when(good, 1) for name, (good, bad) in rules().items()})


def posterior(names: list[str], hit: dict[str, float], alarm: dict[str, float], good: float) -> Column:
    """Probability that a document is good, from its votes: a sum of log odds.

    ``hit``: share of good votes on good documents, ``alarm``: share of bad votes on bad ones.
    """
    odds = F.lit(math.log(good / (1 - good)))
    for n in names:
        up, down = math.log(hit[n] / (1 - alarm[n])), math.log((1 - hit[n]) / alarm[n])
        odds = odds + F.when(F.col(f"vote_{n}") == 1, up).when(F.col(f"vote_{n}") == 0, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def label_model(voted: DataFrame) -> tuple[dict[str, float], dict[str, float], float]:
    """Accuracies of every rule on good and on bad documents and the share of good ones, by expectation-maximisation.

    Each accuracy starts from a belief worth a share ``BELIEF`` of the documents, which also keeps the two classes from
    changing places and leaves a rule that never votes where it began.
    """
    names = list(rules())
    patterns = saved(voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).alias("docs")), "vote-patterns")
    hit, alarm, good = dict.fromkeys(names, FIRST_HIT), dict.fromkeys(names, FIRST_ALARM), FIRST_GOOD
    for _ in range(ROUNDS):
        scored = patterns.withColumn("g", F.col("docs") * posterior(names, hit, alarm, good)).withColumn("b", F.col("docs") - F.col("g"))
        cast = lambda n, of, vote: F.sum(F.when(F.col(f"vote_{n}").isin(vote), F.col(of)).otherwise(0.0))
        sums = scored.agg(F.sum("docs").alias("docs"), F.sum("g").alias("good"), *[
            c for n in names for c in (cast(n, "g", [1]).alias(f"hits_{n}"), cast(n, "g", [0, 1]).alias(f"good_{n}"), cast(n, "b", [0]).alias(f"alarms_{n}"), cast(n, "b", [0, 1]).alias(f"bad_{n}"))]).first()
        if not sums["docs"]:
            break
        before, belief = (hit, alarm), BELIEF * sums["docs"]
        inside = lambda x: min(0.995, max(0.005, x))
        hit = {n: inside((sums[f"hits_{n}"] + FIRST_HIT * belief) / (sums[f"good_{n}"] + belief)) for n in names}
        alarm = {n: inside((sums[f"alarms_{n}"] + FIRST_ALARM * belief) / (sums[f"bad_{n}"] + belief)) for n in names}
        good = min(0.99, max(0.01, sums["good"] / sums["docs"]))
        if max(abs(now[n] - was[n]) for now, was in zip((hit, alarm), before) for n in names) < TOLERANCE:
            break
    return hit, alarm, good


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, posterior probability and verdict of every document."""
    voted = votes(saved(statistics(df, id_col, text_col), "quality-statistics"))
    model = label_model(voted)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("good_probability", posterior(list(rules()), *model)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= 0.5))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {}
