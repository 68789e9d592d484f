"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets counts of words, symbols, repeated lines and repeated word
windows, and from these a few rates where higher is worse. For each stratum (a
language) and rate a grid of cutoffs is tested on the labelled good documents:
rejecting ``k`` of ``n`` of them, a cutoff is certified when the exact binomial tail
``P(X <= k | n, risk / rates)`` is at most ``error`` divided by the number of tests
(strata x rates x grid). With probability 1 - ``error`` all certified cutoffs
together reject at most the share ``risk`` of good documents in every stratum,
whichever of them are used. Of the certified cutoffs of a rate the one that gains
most is used: bad documents rejected less ``GOOD_WEIGHT`` times the good ones. A
stratum with too few labels to certify anything rejects by the base rules alone.

Only DataFrame functions are used. Counting happens inside the row; what is
shuffled are the narrow rates of labelled documents and grouped counts. Null texts
have no words and fail the base rules. Null languages form a stratum of their own;
a stratum without labels is judged by the base rules, however many there are. Labels that
are null, that contradict each other or that have no document are left out. Repeated
rows are judged alike; an empty table gives an empty result, and without labels only
the base rules reject. Result columns replace columns of the same name; other names
may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .names import hidden_name, hide, show

RISK = 0.05
ERROR = 0.05
GOOD_WEIGHT = 20
#: Strata whose cutoffs are broadcast at most (some 100 bytes each); beyond it an ordinary join is used.
BROADCAST_STRATA = 100_000
MIN_WORDS = 50
GRID = [0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RATES = ["symbol_rate", "repeat_line_rate", "repeat_word_rate", "shout_rate", "upper_rate"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Terms of a binomial tail that are summed one by one; a geometric bound covers the rest.
TAIL_TERMS = 5000

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])


def _removed(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated_positions(words: Column, packed: Column, mask: Column) -> Column:
    """Window starts, ascending, whose three words occur in another window too.

    ``packed`` holds sorted window hashes with the start in the bits of ``mask``; equal
    neighbours are compared word by word, so colliding hashes don't count.
    """

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        equal = F.get(words, i) == F.get(words, j)
        for step in (1, 2):
            equal = equal & (F.get(words, i + step) == F.get(words, j + step))
        return (x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0) & equal

    found = F.filter(
        packed,
        lambda x, n: F.coalesce((n > 0) & same(x, F.get(packed, n - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(packed, n + 1)), F.lit(False)),
    )
    return F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the rates."""
    docs, back = hide(docs)
    text = hidden_name(text, back)
    taken = {*COUNTS, *RATES, "base_failed"}
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in taken]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.regexp_replace(body, rf"^{_SPACE}|{_SPACE}$", "")
    rows = docs.select(*kept, body.alias("_body"), F.split(trimmed, _SPACE).alias("_split"))
    rows = rows.withColumn("_words", F.when(F.get("_split", F.lit(0)) != "", F.col("_split")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_n", F.size("_words")).drop("_split")
    starts = F.when(F.col("_n") > 2, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    bits = F.length(F.bin(F.col("_n").cast("long")))
    rows = rows.withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    windows = F.transform(
        starts,
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
        .bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")),
    )
    rows = rows.withColumn("_packed", F.sort_array(windows))
    rows = rows.withColumn("_starts", _repeated_positions(F.col("_words"), F.col("_packed"), F.col("_mask"))).drop("_packed")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(-3).cast("long").alias("last")),
        lambda a, s: F.struct((a.words + F.least(F.lit(3).cast("long"), s - a.last)).alias("words"), s.alias("last")),
        lambda a: a.words,
    )
    lines = F.filter(F.split("_body", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = rows.withColumn("_lines", lines)
    counts = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.translate("_body", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _removed(F.col("_body"), "#*$%&|<>"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
        "_shouts": _removed(F.col("_body"), "!"),
        "_upper": _removed(F.col("_body"), _UPPER),
        "_n_lines": F.size("_lines"),
    }
    # A generator of one row: filters on the results must not be moved below it, where
    # they would repeat the counting inside every lambda.
    rows = rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in counts.items()]))))
    some = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    rates = {
        "symbol_rate": F.col("n_symbols") / some("word_chars"),
        "repeat_line_rate": F.col("n_dup_lines") / some("_n_lines"),
        "repeat_word_rate": F.col("n_repeat_words") / some("n_words"),
        "shout_rate": F.col("_shouts") / some("word_chars"),
        "upper_rate": F.col("_upper") / some("word_chars"),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return show(rows.withColumns(rates).withColumn("base_failed", failed).drop("_shouts", "_upper", "_n_lines"), back)


def _ln_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def ln_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p); 0 from the mean on, where no test succeeds.

    Terms below the largest one are summed downwards; after ``TAIL_TERMS`` terms the
    rest is bounded from above by its geometric series.
    """
    choose = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
    first = choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    ratio = lambda i: (k - i) * (1.0 - p) / ((n - k + 1 + i) * p)
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TAIL_TERMS).cast("long")) - 1))
    total = F.aggregate(
        F.coalesce(steps, F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a.sum + a.term * ratio(i)).alias("sum"), (a.term * ratio(i)).alias("term")),
    )
    at = ratio(F.lit(TAIL_TERMS).cast("long"))
    rest = F.when(k > TAIL_TERMS, total.term * at / (1 - at)).otherwise(F.lit(0.0))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(first + F.log(total.sum + rest))


def certify(
    measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """Cutoffs: ``named``, a stratum with labels, and one column per rate, null where
    nothing was certified. Staged: one row per stratum."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key)
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).filter("quality = _other")
    holdout = measured.select(key, F.col(f"`{stratum}`").cast("string").alias("_stratum"), *RATES).join(known.select(key, "quality"), key)
    level = lambda c: sum(((F.col(c) > g).cast("int") for g in GRID[1:]), (F.col(c) > GRID[0]).cast("int"))
    holdout = holdout.select(
        "_stratum", "quality", F.explode(F.array(*[F.struct(F.lit(c).alias("rate"), level(c).alias("level")) for c in RATES])).alias("x")
    )
    counts = stage(holdout.groupBy("_stratum", "quality", "x.rate", "x.level").agg(F.count("*").alias("n")), "label-counts")
    group = ["_stratum", "rate"]
    grid = F.explode(F.array(*[F.struct(F.lit(n + 1).alias("step"), F.lit(g).alias("cutoff")) for n, g in enumerate(GRID)])).alias("g")
    above = F.when(F.col("level") >= F.col("g.step"), F.col("n")).otherwise(0)
    is_good = F.col("quality") == 1
    tests = counts.select(*group, "quality", "level", "n", grid).groupBy(*group, F.col("g.cutoff").alias("cutoff")).agg(
        F.sum(F.when(is_good, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(is_good, above).otherwise(0)).alias("lost"),
        F.sum(F.when(~is_good, above).otherwise(0)).alias("caught"),
    )
    strata = counts.select("_stratum").distinct().count()
    bound = F.log(F.lit(error)) - F.log(F.lit(float(max(strata, 1) * len(RATES) * len(GRID))))
    tests = tests.withColumn("certain", ln_binomial_tail(F.col("lost"), F.col("good"), risk / len(RATES)) <= bound)
    gain = F.col("caught") - GOOD_WEIGHT * F.col("lost")
    useful = F.when(F.col("certain") & (gain > 0), F.struct(gain.alias("gain"), "cutoff"))
    best = tests.groupBy("_stratum").pivot("rate", RATES).agg(F.max(useful)["cutoff"])
    return stage(best.select(F.col("_stratum").alias("named"), *RATES), "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``kept``; strata without cutoffs are judged by the base rules."""
    measured, back = hide(measured)
    stratum = hidden_name(stratum, back)
    own = cutoffs.select(F.col("named").alias("_named"), *[F.col(c).alias(f"_cut_{c}") for c in RATES])
    own = F.broadcast(own) if cutoffs.count() <= BROADCAST_STRATA else own
    joined = measured.join(own, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col("_named")), "left")
    over = [F.coalesce(F.col(c) > F.col(f"_cut_{c}"), F.lit(False)) for c in RATES]
    rejected = F.col("base_failed")
    for rule in over:
        rejected = rejected | rule
    kept = [f"`{c}`" for c in measured.columns if c.lower() != "kept"]
    return show(joined.withColumn("kept", ~rejected).select(*kept, "kept"), back)
