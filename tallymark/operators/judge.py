"""Judge-assisted names: gray zone, verdicts, calibration statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.answers import parse_verdict
from tallymark.functions.hashing import pair_id
from tallymark.functions.names import names_match
from tallymark.functions.rating import CORRECT_VALUE, MISMATCH, outcome_score
from tallymark.functions.text import not_blank
from tallymark.operators.scoring import field_value
from tallymark.schemas import JUDGED_FIELDS

# How a judged score was reached, and the agreement a judge must reach.
NOT_NEEDED, EQUIVALENT, NOT_EQUIVALENT = "not_needed", "equivalent", "not_equivalent"
VERDICT_UNPARSED, NOT_IN_INPUT = "unparsed", "not_in_model_input"
TARGET_KAPPA = 0.75


def gray_zone(golden: Column, predicted: Column) -> Column:
    """Both names present and the strict comparison fails."""
    return not_blank(golden) & not_blank(predicted) & ~F.coalesce(names_match(golden, predicted), F.lit(False))


def vendor_in_input(input_mode: Column, ocr_path: Column) -> Column:
    """False where the model read an OCR layer, which never holds the vendor name."""
    return ~((input_mode == "ocr") & ocr_path.isNotNull())


def real_mismatches(scored: DataFrame, keys=("execution", "config", "doc_id")) -> DataFrame:
    """Strict name mismatches worth judging: (keys, field, golden, predicted). ``scored`` has outcome columns."""
    rows = []
    for f in JUDGED_FIELDS:
        kept = F.col(f"outcome_{f}") == MISMATCH
        if f == "vendor_name":
            kept &= vendor_in_input(F.col("input_mode"), F.col("ocr_path"))
        rows.append(F.when(kept, F.struct(
            F.lit(f).alias("field"), field_value(F.col("expected"), f).alias("golden"),
            field_value(F.col("predicted"), f).alias("predicted"))))
    exploded = scored.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return exploded.select(*keys, "r.*")


def parsed_verdicts(verdicts: DataFrame) -> DataFrame:
    """(pair_id, equivalent, verdict_reason), one row per pair."""
    one = verdicts.groupBy("pair_id").agg(F.min("response_text").alias("response_text"))
    parsed = one.withColumn("_v", parse_verdict(F.col("response_text")))
    return parsed.select("pair_id", F.col("_v.equivalent").alias("equivalent"), F.col("_v.reason").alias("verdict_reason"))


def verdict_join(outcomes: DataFrame, verdicts: DataFrame, in_input: Column) -> DataFrame:
    """Adds ``judged_outcome``, ``judge_state`` and ``judged_score`` to name rows (field, golden, predicted, outcome).

    Only the asked rows, a small part, meet the verdicts; the others are not shuffled and no null key is.
    """
    mismatch = F.col("outcome") == MISMATCH
    keyed = outcomes.withColumn("_asked", F.coalesce(mismatch & in_input, F.lit(False))).withColumn(
        "pair_id", F.when(F.col("_asked"), pair_id(F.col("field"), F.col("golden"), F.col("predicted"))))
    asked = keyed.where("_asked").join(parsed_verdicts(verdicts), "pair_id", "left")
    rest = keyed.where("NOT _asked").withColumns({
        "equivalent": F.lit(None).cast("boolean"), "verdict_reason": F.lit(None).cast("string")})
    joined = asked.unionByName(rest)
    state = (
        F.when(~mismatch, NOT_NEEDED)
        .when(~F.col("_asked"), NOT_IN_INPUT)
        .when(F.col("equivalent"), EQUIVALENT)
        .when(~F.col("equivalent"), NOT_EQUIVALENT)
        .otherwise(VERDICT_UNPARSED)
    )
    judged = joined.withColumn("judge_state", state).withColumn(
        "judged_outcome", F.when(F.col("judge_state") == EQUIVALENT, CORRECT_VALUE).otherwise(F.col("outcome")))
    return judged.withColumn("judged_score", outcome_score(F.col("judged_outcome"))).drop("_asked", "equivalent")


def judged_wide(
    scored: DataFrame, verdicts: DataFrame, keys=("execution", "config", "doc_id"), drop=(), mismatches: DataFrame | None = None,
) -> DataFrame:
    """Adds ``judged_<field>`` outcomes and ``judge_state_<field>`` to wide rows, without the columns named in ``drop``.

    The rows with a mismatch are a small part of the table: only they are joined to verdicts, and the result comes
    back by key instead of sending every document through the pair-id shuffle. ``mismatches`` are the
    :func:`real_mismatches` of ``scored`` where the caller has them already. Rows meet their result by the last key, the
    document; the other keys are compared there. So scores that lie by document, as they do after the join with golden,
    are neither shuffled nor sorted again.
    """
    parsed = parsed_verdicts(verdicts).select(F.col("pair_id"), F.col("equivalent"))
    asked = (real_mismatches(scored, keys) if mismatches is None else mismatches).withColumn(
        "pair_id", pair_id(F.col("field"), F.col("golden"), F.col("predicted"))).join(parsed, "pair_id", "left")
    state = F.when(F.col("equivalent"), EQUIVALENT).when(~F.col("equivalent"), NOT_EQUIVALENT).otherwise(VERDICT_UNPARSED)
    states = asked.withColumn("_state", state).groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == f, F.col("_state"))).alias(f"_state_{f}") for f in JUDGED_FIELDS])
    *runs, doc = keys
    rows = scored.drop(*drop)
    states = states.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.col(doc) == F.col(f"_of_{doc}")
    for k in runs:  # two comparisons, which are no key of the join
        same &= (F.col(k) <= F.col(f"_of_{k}")) & (F.col(k) >= F.col(f"_of_{k}"))
    joined = rows.join(states, same, "left").select(*keys, *[c for c in rows.columns if c not in keys], *[f"_state_{f}" for f in JUDGED_FIELDS])
    for f in JUDGED_FIELDS:
        strict, verdict = F.col(f"outcome_{f}"), F.col(f"_state_{f}")
        joined = joined.withColumns({
            f"judge_state_{f}": F.when(strict != MISMATCH, NOT_NEEDED).otherwise(F.coalesce(verdict, F.lit(NOT_IN_INPUT))),
            f"judged_{f}": F.when(verdict == EQUIVALENT, CORRECT_VALUE).otherwise(strict),
        })
    return joined.drop(*[f"_state_{f}" for f in JUDGED_FIELDS])


def confusion_kappa(ratings: DataFrame, human: str = "human", judge: str = "judge", target: float = TARGET_KAPPA) -> DataFrame:
    """One row: 2x2 counts, observed and chance agreement, kappa (NaN when chance agreement is 1) and acceptance."""
    h, j = F.col(human), F.col(judge)
    counts = ratings.agg(
        F.count_if(h & j).alias("tt"), F.count_if(h & ~j).alias("tf"),
        F.count_if(~h & j).alias("ft"), F.count_if(~h & ~j).alias("ff"))
    pairs = F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")
    counts = counts.withColumn("tt", F.when(pairs == 0, F.raise_error(F.lit("there are no pairs to rate"))).otherwise(F.col("tt")))
    n = F.nullif((F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")).cast("double"), F.lit(0.0))
    chance = (
        (F.col("tt") + F.col("tf")) / n * ((F.col("tt") + F.col("ft")) / n)
        + (F.col("ft") + F.col("ff")) / n * ((F.col("tf") + F.col("ff")) / n))
    rated = counts.withColumns({"observed": (F.col("tt") + F.col("ff")) / n, "expected": chance})
    kappa = F.when(F.col("expected") >= 1, F.lit(float("nan"))).otherwise(
        (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))
    rated = rated.withColumn("kappa", kappa)
    return rated.withColumn("accepted", ~F.isnan("kappa") & (F.col("kappa") >= target))


def origin_group(origin: Column) -> Column:
    return F.when(origin.startswith("run:"), "real (runs)").otherwise(F.regexp_replace(origin, "^synthetic:", ""))


def agreement_by_origin(ratings: DataFrame) -> DataFrame:
    h, j = F.col("human"), F.col("judge")
    return ratings.groupBy(origin_group(F.col("origin")).alias("origin")).agg(
        F.count("*").alias("pairs"), F.count_if(h).alias("human_true"), F.count_if(j).alias("judge_true"),
        F.avg((h == j).cast("double")).alias("agreement"),
        F.count_if(j & ~h).alias("too_lenient"), F.count_if(~j & h).alias("too_strict"))


def rated_pairs(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labelled pairs with the judge's answer; a verdict that is missing or does not parse counts as "not equivalent".

    A pair without a human label stops the job.
    """
    human = F.when(F.col("human_label").isNull(), F.raise_error(F.lit("every pair needs a human_label"))).otherwise(
        F.col("human_label"))
    joined = pairs.withColumn("human", human).join(
        parsed_verdicts(verdicts).withColumnRenamed("pair_id", "id"), "id", "left")
    return joined.withColumns({
        "judge": F.coalesce("equivalent", F.lit(False)), "verdict_parsed": F.col("equivalent").isNotNull()}).drop("equivalent")


def calibration_report(pairs: DataFrame, verdicts: DataFrame, target: float = TARGET_KAPPA):
    """(kappa row, origin rows, disagreement rows)."""
    ratings = rated_pairs(pairs, verdicts)
    return (
        confusion_kappa(ratings, target=target), agreement_by_origin(ratings),
        ratings.where(F.col("human") != F.col("judge")))
