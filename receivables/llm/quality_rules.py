"""Quality rules under weak supervision, in DataFrame functions only.

A handful of rules look at a document's counts; each votes (good or bad, by its kind) or
abstains. The documents are summed up as how often each combination of votes occurs, at
most 2 to the number of rules, whatever the number of documents. Expectation-maximisation
over these combinations estimates the share of good documents and, for each rule, how
often it votes on good and on bad ones, which is its accuracy; a document is kept if the
posterior probability that it is good is at least ``THRESHOLD``, instead of if it passes
every rule.

The rules are taken as independent given the truth. The estimates stay within ``BOUNDS``,
under which a vote for bad always speaks for bad: that settles which class is which.

Results by case: a NULL text has no words; a document without words fails the base rules;
counts are over whole texts however long; copies and repeated rows are judged alike; an
empty table gives an empty one; further columns of the input are ignored, unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 3
POSITION_BITS = 24  # 16 million words; the hash keeps 40 bits
ROUNDS = 25
WEIGHT = 20.0  # documents that the first guesses count for
THRESHOLD = 0.5

# First guesses, and what estimates stay between: how often a rule of each kind votes on
# good and on bad documents, and the share of good documents.
GUESS = {"bad": (0.01, 0.25), "good": (0.9, 0.6)}
BOUNDS = {"bad": ((0.002, 0.02), (0.1, 0.9)), "good": ((0.3, 0.98), (0.05, 0.95))}
SHARE, SHARE_BOUNDS = 0.8, (0.5, 0.95)

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_capitals",
    "n_bare_words",
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more.

    A window becomes one long: a hash above, its position in the low bits. Sorted, equal
    windows are neighbours, unless positions do not fit their bits or different windows have
    equal hashes, which is checked word by word; then whole windows are sorted instead. Of the
    positions found, each covers the words up to the next, at most a window.
    """

    def counted(words: Column) -> Column:
        windows = F.size(words) - (WINDOW - 1)
        return F.when(windows < 2, F.lit(0)).otherwise(_covered(words, windows))

    return _let(words, counted)


def _covered(words: Column, windows: Column) -> Column:
    def word(place: Column) -> Column:
        return F.get(words, place)

    def key(start: Column) -> Column:
        return F.xxhash64(*(word(start + i) for i in range(WINDOW)))

    def place(packed: Column) -> Column:
        return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    packed = F.transform(
        F.sequence(F.lit(0), windows - 1),
        lambda i: F.shiftleft(key(i), POSITION_BITS).bitwiseOR(i.cast("long")),
    )

    def same_hash(one: Column, other: Column) -> Column:
        return F.shiftright(one, POSITION_BITS) == F.shiftright(other, POSITION_BITS)

    def same_words(one: Column, other: Column) -> Column:
        equal = F.lit(True)
        for i in range(WINDOW):
            equal &= word(place(one) + i) == word(place(other) + i)
        return equal

    def clash(packed: Column) -> Column:
        """Whether different windows have equal hashes; two of them are neighbours then."""

        def differ(x: Column, i: Column) -> Column:
            behind = F.get(packed, i + 1)
            return F.coalesce(same_hash(x, behind) & ~same_words(x, behind), F.lit(False))

        return F.exists(F.transform(packed, differ), lambda found: found)

    def repeated(packed: Column) -> Column:
        def same(one: Column, other: Column) -> Column:
            return F.coalesce(same_hash(one, other), F.lit(False))

        return F.transform(
            F.filter(
                packed,
                lambda x, i: same(x, F.get(packed, i + 1)) | same(x, F.get(packed, i - 1)),
            ),
            place,
        )

    whole = F.transform(
        F.sequence(F.lit(0), windows - 1),
        lambda i: F.struct(
            F.struct(key(i).alias("hash"), *(word(i + k).alias(f"word{k}") for k in range(WINDOW))).alias("window"),
            i.alias("place"),
        ),
    )

    def repeated_whole(sorted_: Column) -> Column:
        def same(one: Column, other: Column) -> Column:
            return F.coalesce(one["window"] == other["window"], F.lit(False))

        return F.transform(
            F.filter(
                sorted_,
                lambda x, i: same(x, F.get(sorted_, i + 1)) | same(x, F.get(sorted_, i - 1)),
            ),
            lambda x: x["place"],
        )

    def starts(packed: Column) -> Column:
        return F.when(
            packed.isNull() | clash(packed), _let(F.array_sort(whole), repeated_whole)
        ).otherwise(repeated(packed))

    def cover(starts: Column) -> Column:
        gaps = F.transform(
            starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    fitting = F.when(windows <= 1 << POSITION_BITS, F.array_sort(packed))
    return _let(F.array_sort(_let(fitting, starts)), cover)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep`` and the counts that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = list(dict.fromkeys([id_col, *keep]))
    split = docs.select(
        *columns,
        text.alias("_text"),
        F.filter(F.split(text, SPACE), lambda word: word != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("_text", pattern, "")).cast("long")

    return split.select(
        *columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        left(r"\P{L}+").alias("n_letters"),
        left(r"\P{Lu}+").alias("n_capitals"),
        F.size(F.filter("_words", lambda word: ~word.rlike(r"\p{L}"))).cast("long").alias("n_bare_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, tuple[str, Column]]:
    """For each rule what it votes and when; else it abstains. All in whole numbers."""
    words, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("n_letters")
    return {
        "symbols": ("bad", 100 * F.col("n_symbols") > 10 * words),
        "duplicate_lines": ("bad", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "repeated_words": ("bad", 100 * F.col("n_repeat_words") > 40 * words),
        "capitals": ("bad", 100 * F.col("n_capitals") > 40 * letters),
        "odd_word_length": ("bad", (10 * chars < 25 * words) | (10 * chars > 150 * words)),
        "few_letters": ("bad", 100 * letters < 65 * chars),
        "bare_words": ("bad", 100 * F.col("n_bare_words") > 15 * words),
        "usual_word_length": ("good", (10 * chars >= 35 * words) & (10 * chars <= 90 * words)),
        "many_letters": ("good", 100 * letters >= 85 * chars),
        "long": ("good", words >= 100),
    }


def votes() -> Column:
    """Whether each rule votes, as an array."""
    return F.array(*(F.coalesce(when, F.lit(False)) for _, when in rules().values()))


def _posterior(votes: Column, share: Column, rates: Column) -> Column:
    """The probability that a document with these votes is good."""
    weights = F.zip_with(
        votes,
        rates,
        lambda vote, rate: F.when(vote, F.log(rate["good"] / rate["bad"])).otherwise(
            F.log((1 - rate["good"]) / (1 - rate["bad"]))
        ),
    )
    evidence = F.aggregate(weights, F.log(share / (1 - share)), lambda total, x: total + x)
    return 1 / (1 + F.exp(-evidence))


def _within(value: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


def _rate(good: Column, bad: Column) -> Column:
    return F.struct(good.alias("good"), bad.alias("bad"))


def fit(voted: DataFrame) -> DataFrame:
    """One row: ``share`` of good documents, ``rates`` of voting per rule, and ``seen``.

    ``voted`` has an array ``votes`` per document. The combinations gathered in the row are
    as many as two to the number of rules at most; the rounds run over them within it.
    """
    kinds = [kind for kind, _ in rules().values()]
    combined = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = combined.agg(F.collect_list(F.struct("votes", "n")).alias("seen"))

    def better(state: Column, _: Column) -> Column:
        weighed = F.transform(
            F.col("seen"),
            lambda c: F.struct(
                c["votes"].alias("votes"),
                (c["n"] * _posterior(c["votes"], state["share"], state["rates"])).alias("good"),
                c["n"].alias("n"),
            ),
        )

        def total(weighed: Column, value) -> Column:
            return F.aggregate(weighed, F.lit(0.0), lambda sum_, c: sum_ + value(c))

        def updated(weighed: Column) -> Column:
            good = total(weighed, lambda c: c["good"])
            bad = total(weighed, lambda c: c["n"] - c["good"])
            rates = []
            for i, kind in enumerate(kinds):
                voted_good = total(weighed, lambda c: F.when(F.get(c["votes"], F.lit(i)), c["good"]).otherwise(0.0))
                voted_bad = total(
                    weighed, lambda c: F.when(F.get(c["votes"], F.lit(i)), c["n"] - c["good"]).otherwise(0.0)
                )
                (on_good, on_bad), (if_good, if_bad) = GUESS[kind], BOUNDS[kind]
                rates.append(
                    _rate(
                        _within((voted_good + WEIGHT * on_good) / (good + WEIGHT), if_good),
                        _within((voted_bad + WEIGHT * on_bad) / (bad + WEIGHT), if_bad),
                    )
                )
            share = _within((good + WEIGHT * SHARE) / (good + bad + WEIGHT), SHARE_BOUNDS)
            return F.struct(share.alias("share"), F.array(*rates).alias("rates"))

        return _let(weighed, updated)

    first = F.struct(
        F.lit(SHARE).alias("share"),
        F.array(*(_rate(*map(F.lit, GUESS[kind])) for kind in kinds)).alias("rates"),
    )
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, better)
    return row.select(fitted.alias("m"), "seen").select("m.share", "m.rates", "seen")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, the columns in ``keep``, the counts, ``base_failed``, ``posterior`` and ``kept``."""
    columns = list(dict.fromkeys([id_col, *keep]))
    counted = stored(
        counts(docs, id_col, text_col, keep).withColumn("votes", votes()), "counts"
    )
    verdicts = fit(counted).select("share", "rates", F.explode("seen").alias("c")).select(
        F.col("c.votes").alias("votes"),
        _posterior(F.col("c.votes"), F.col("share"), F.col("rates")).alias("posterior"),
    )
    # A row for each combination of votes, two to the number of rules at most.
    return counted.join(F.broadcast(verdicts), "votes").select(
        *columns,
        *COUNTS,
        base_failed().alias("base_failed"),
        "posterior",
        (~base_failed() & (F.col("posterior") >= THRESHOLD)).alias("kept"),
    )
