"""URL verdicts from host rules and a character language-model ratio.

Rules decide where they fit: a rule fits its host and all subdomains when the path
starts with the rule's path, and the longest fitting rule wins. The URLs that rules
allow and block are at the same time the training text of two smoothed
variable-order Markov models over 32 character classes: letters, digits as one,
dot, slash, hyphen, any other as one, and the border of the text. The probability of
a character after its three predecessors is the Witten-Bell mixture of the counts of
all shorter histories. What no rule decides is allowed when its log-likelihood
difference, divided by its length, is at least the calibrated threshold. That is the one
that separates held-out allowed and blocked URLs with the least balanced error: one in
``FOLDS``, by a hash of the URL, scored by models counted from the others only.

Only DataFrame functions are used. Counts cover every URL of the table and leave the
tasks pre-aggregated. A model never has more than 32^4 weights, whatever the input:
that bounds its broadcast, and scoring shuffles one row for each URL.

A null URL and one without ``://`` have empty host and path; their text is judged by
the model. Repeated rows are judged alike and an empty table gives an empty result.
Without both allowed and blocked held-out URLs what no rule decides is allowed.
Result columns replace columns of the same name; other names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .names import hidden_name, hide, show

#: (verdict, rule)
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

LETTERS = "abcdefghijklmnopqrstuvwxyz./-0"
CLASSES = 32
OTHER = CLASSES - 1
ORDER = 3
#: One of so many ruled URLs, by a hash of the URL, is scored by models counted without it, to calibrate the threshold.
FOLDS = 4
#: Width of a histogram bin of scores, in nats a character.
BIN = 0.001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for a null URL or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def _first(rules: list[tuple[str, str]], host: Column, path: Column, pick: int) -> Column:
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        found = F.when(_fits(rule[1], host, path), F.lit(rule[pick])).otherwise(found)
    return found


def _grams(text: Column) -> Column:
    """Each character with its three predecessors as one number below 32^4."""
    plain = F.translate(F.lower(text), "123456789", "0" * 9)
    letters = F.filter(F.split(plain, ""), lambda x: x != "")
    place = F.transform(letters, lambda x: F.coalesce(F.nullif(F.instr(F.lit(LETTERS), x), F.lit(0)), F.lit(OTHER)))
    border = F.array_repeat(F.lit(0), ORDER)
    return F.concat(border, place, F.array(F.lit(0)))


def _coded(df: DataFrame, text: str) -> DataFrame:
    coded = df.withColumn("_codes", _grams(F.col(text)))
    number = lambda i: sum(
        (F.get("_codes", i + n) * CLASSES ** (ORDER - n) for n in range(1, ORDER + 1)), F.get("_codes", i) * CLASSES**ORDER
    )
    return coded.withColumn("_grams", F.transform(F.sequence(F.lit(0), F.size("_codes") - ORDER - 1), number)).drop("_codes")


def weights(grams: DataFrame) -> DataFrame:
    """(code, weight) of every gram seen anywhere; ``grams``, staged, has counts allowed and blocked
    of every code, so at most 32^4 rows."""
    table = grams.select("code", F.col("allowed").alias("a3"), F.col("blocked").alias("b3"))
    joined = table
    for order in range(ORDER, -1, -1):
        length = CLASSES ** (order + 1)
        a, b = f"a{order}", f"b{order}"
        level = table.groupBy((F.col("code") % length).alias(f"k{order}")).agg(F.sum("a3").alias(a), F.sum("b3").alias(b))
        if order < ORDER:
            joined = joined.withColumn(f"k{order}", F.col("code") % length).join(level, f"k{order}")
        # What follows a history: how often, and how many different characters.
        follow = level.groupBy(F.floor(F.col(f"k{order}") / CLASSES).cast("long").alias(f"h{order}")).agg(
            F.sum(a).alias(f"na{order}"), F.sum(b).alias(f"nb{order}"),
            F.sum((F.col(a) > 0).cast("long")).alias(f"ta{order}"), F.sum((F.col(b) > 0).cast("long")).alias(f"tb{order}"),
        )
        history = F.floor((F.col("code") % length) / CLASSES).cast("long")
        joined = joined.withColumn(f"h{order}", history).join(follow, f"h{order}")
    chance = {}
    for side in "ab":
        p = F.lit(1.0 / CLASSES)
        for order in range(ORDER + 1):
            n, t = F.col(f"n{side}{order}"), F.col(f"t{side}{order}")
            p = F.when(n == 0, p).otherwise((F.col(f"{side}{order}") + t * p) / (n + t))
        chance[side] = p
    return joined.select("code", (F.log(chance["a"]) - F.log(chance["b"])).cast("float").alias("weight"))


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``."""
    pages, back = hide(pages)
    url = hidden_name(url, back)
    taken = {"host", "path", "rule", "score", "verdict"}
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in taken]
    source = pages.select(*kept, F.col(f"`{url}`").cast("string").alias("_url"))
    host, path = parse(F.col("_url"))
    ruled = source.withColumns({"host": host, "path": path})
    host, path = F.col("host"), F.col("path")
    fold = F.col("_url").isNotNull() & (F.crc32(F.col("_url").cast("binary")) % FOLDS == 0)
    ruled = ruled.withColumns({"rule": _first(rules, host, path, 1), "_ruled": _first(rules, host, path, 0), "_fold": fold})
    rest = F.regexp_replace(F.coalesce("_url", F.lit("")), r"(?s)^.*?://", "")
    rows = stage(ruled.withColumns({"_rest": rest, "_row": F.monotonically_increasing_id()}), "urls")
    # Outer explosions below: an inner one adds a filter on the array's size, which would be
    # moved under its computation and repeat it for every element. No array is empty.
    rows = _coded(rows, "_rest").drop("_rest")
    exploded = rows.select("_ruled", "_fold", F.explode_outer("_grams").alias("code"))
    says = lambda verdict: F.coalesce("_ruled", F.lit("")) == verdict
    grams = stage(exploded.groupBy(F.col("code").cast("long").alias("code")).agg(
        F.sum(says("allow").cast("long")).alias("allowed"), F.sum(says("block").cast("long")).alias("blocked"),
        F.sum((says("allow") & ~F.col("_fold")).cast("long")).alias("allowed_rest"),
        F.sum((says("block") & ~F.col("_fold")).cast("long")).alias("blocked_rest"),
    ), "grams")
    model = weights(grams)
    columns = [f"`{c}`" for c in ruled.columns if c != "_url"]
    read = rows.select("_row", F.explode_outer("_grams").alias("code")).join(F.broadcast(model), "code")
    # The grams of a row stay together in its task, so one row for each URL is shuffled.
    scores = read.groupBy("_row").agg(F.avg("weight").alias("score"))
    scored = stage(rows.select("_row", *columns).join(scores, "_row").drop("_row"), "scored")
    # Ruled URLs of the fold calibrate the threshold, by models that have not seen them.
    rest_model = weights(grams.select("code", F.col("allowed_rest").alias("allowed"), F.col("blocked_rest").alias("blocked")))
    held = rows.filter(F.col("_ruled").isNotNull() & F.col("_fold")).select("_row", "_ruled", F.explode_outer("_grams").alias("code"))
    held = held.join(F.broadcast(rest_model), "code").groupBy("_row", "_ruled").agg(F.avg("weight").alias("score"))
    bins = held.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum((F.col("_ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("_ruled") == "block").cast("long")).alias("b")
    )
    table = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "a", "b"))).alias("bins"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    # Walk up the bins: blocked below the cut less allowed below it, as shares of their classes.
    start = F.struct(F.lit(0.0).alias("gain"), F.lit(-1.0).alias("best"), F.lit(None).cast("double").alias("cut"))
    def step(acc: Column, x: Column) -> Column:
        cut = x.bin.cast("double") * BIN
        better = acc.gain > acc.best
        gain = acc.gain + x.b / F.col("nb") - x.a / F.col("na")
        return F.struct(gain.alias("gain"), F.when(better, acc.gain).otherwise(acc.best).alias("best"), F.when(better, cut).otherwise(acc.cut).alias("cut"))
    threshold = table.filter("na > 0 and nb > 0").select(F.aggregate("bins", start, step, lambda acc: acc.cut).alias("cut")).scalar()
    by_model = F.when(F.coalesce(F.col("score") >= threshold, F.lit(True)), "allow").otherwise("block")
    return show(scored.withColumn("verdict", F.coalesce("_ruled", by_model)).drop("_ruled", "_fold"), back)
