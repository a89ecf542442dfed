"""Calibration pairs for a name judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.hashing import drawn, hash_draw, hash_numbers, pair_id
from tallymark.functions.names import names_match, normalize_name
from tallymark.functions.text import excerpt, not_blank, trim_ws
from tallymark.operators.judge import gray_zone
from tallymark.operators.ranks import global_index
from tallymark.session import stored

# Perturbation kinds, and the order in which slots cycle through them.
LEGAL_SUFFIX, ABBREVIATION, OCR_NOISE = "legal_suffix", "abbreviation", "ocr_noise"
REORDERED, SUBSTRING_TRAP, DIFFERENT_PARTY = "reordered", "substring_trap", "different_party"
KINDS = (LEGAL_SUFFIX, ABBREVIATION, OCR_NOISE, REORDERED, SUBSTRING_TRAP, DIFFERENT_PARTY)
CYCLE = (LEGAL_SUFFIX, SUBSTRING_TRAP, ABBREVIATION, DIFFERENT_PARTY, OCR_NOISE, SUBSTRING_TRAP, REORDERED, DIFFERENT_PARTY)
ATTEMPTS_PER_SLOT, OCR_ATTEMPTS, MAX_OCR_EDITS = 64, 8, 3

# Suffixes the strict comparison keeps, abbreviations, additions and look-alike characters.
UNLISTED_SUFFIXES = (" Pvt. Ltd.", ", S.A. de C.V.", " Sp. z o.o.", " A/S", " KGaA", " Ltda.", " S.p.A. Unipersonale")
ABBREVIATIONS = (
    ("International", "Intl."), ("Manufacturing", "Mfg."), ("Brothers", "Bros."), ("Services", "Svcs."),
    ("Technologies", "Tech."), ("Technology", "Tech."), ("Associates", "Assoc."), ("Industries", "Inds."),
    ("Solutions", "Sol."), ("Systems", "Sys."), ("Group", "Grp."), ("Laboratories", "Labs"),
    ("Engineering", "Eng."), ("Mountain", "Mtn."), ("Saint", "St."), ("Department", "Dept."),
    ("Distribution", "Dist."), ("Management", "Mgmt."), ("National", "Natl."), ("Products", "Prods."),
)
TRAP_ADDITIONS = ("Logistics", "Holdings", "Capital Partners", "Medical Supplies", "Realty Group", "Foods")
TRAP_PREFIXES = ("North", "New", "United")
CONFUSABLES = {
    "O": "0", "o": "0", "0": "O", "l": "1", "1": "l", "I": "l", "i": "l", "S": "5", "s": "5", "B": "8", "e": "c",
    "c": "e", "m": "rn", "n": "ri", "a": "o", "g": "q", "h": "b", "u": "v", "E": "F", "G": "C", "D": "O", "t": "f",
}


# ---------- names and mismatches ----------

def distinct_names(names: DataFrame) -> DataFrame:
    """One row per (field, normalised name): the first by document, as (field, name, doc_id). Repeats combine map side."""
    kept = names.where(not_blank(F.col("name"))).withColumn("_key", normalize_name(F.col("name")))
    first = kept.groupBy("field", "_key").agg(F.min(F.struct("doc_id", "name")).alias("f"))
    return first.select("field", F.col("f.name").alias("name"), F.col("f.doc_id").alias("doc_id"))


def dedupe_mismatches(mismatches: DataFrame) -> DataFrame:
    """Distinct (field, golden, predicted) in the gray zone: the first document, and the configurations that made it."""
    kept = mismatches.where(gray_zone(F.col("golden"), F.col("predicted")))
    return kept.groupBy("field", "golden", "predicted").agg(
        F.min("doc_id").alias("doc_id"),
        F.concat(F.lit("run:"), F.array_join(F.array_sort(F.collect_set("config")), ",")).alias("origin"),
    ).withColumn("id", pair_id(F.col("field"), F.col("golden"), F.col("predicted")))


# ---------- perturbations ----------

def _pick(options: tuple[str, ...], seed: int, key: Column, counter: int) -> Column:
    at = hash_draw(seed, key, counter, len(options)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), at)


def _table(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _rtrim(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def _words(name: Column) -> Column:
    return F.array_remove(F.split(name, " "), "")


def _abbreviated(name: Column) -> Column:
    shorten = {full.lower(): short for full, short in ABBREVIATIONS}
    expand: dict[str, str] = {}
    for full, short in ABBREVIATIONS:
        expand.setdefault(short.lower(), full)
    words = _words(name)

    def other(word):
        return F.coalesce(
            F.try_element_at(_table(shorten.items()), F.lower(_rtrim(word, ",."))),
            F.try_element_at(_table(expand.items()), F.lower(_rtrim(word, ","))))

    def put(at, replacement):
        return F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(
            replacement, F.when(F.endswith(w, F.lit(",")), ",").otherwise(""))).otherwise(w)), " ")

    found = F.array_position(F.transform(words, lambda w: other(w).isNotNull()), True).cast("int")
    initial = F.concat(F.upper(F.substring(name, 1, 1)), F.lit("."))
    return (
        F.when(found > 0, put(found - 1, other(F.get(words, found - 1))))
        .when((F.size(words) >= 2) & name.rlike(r"^\p{L}"), put(F.lit(0), initial))
    )


def _ocr_noise(name: Column, seed: int, key: Column) -> Column:
    confusable = _table(CONFUSABLES.items())

    # Expressions inside a lambda are not compiled, and evaluated wherever they are written: what is used twice is an element.
    def replaced(text, at):
        return F.when(at.isNull(), text).otherwise(F.concat(
            F.substr(text, F.lit(1), at - 1), F.try_element_at(confusable, F.substr(text, at, F.lit(1))),
            F.substr(text, at + 1, F.length(text))))

    def edit(text, numbers):
        places = F.transform(numbers, lambda number: (drawn(number, F.length(text)) + 1).cast("int"))
        usable = F.filter(places, lambda p: F.try_element_at(confusable, F.substr(text, p, F.lit(1))).isNotNull())
        return F.element_at(F.transform(F.array(F.try_element_at(usable, F.lit(1))), lambda at: replaced(text, at)), 1)

    # The digests do not depend on the text, only the places do.
    edits = hash_draw(seed, key, 1, MAX_OCR_EDITS).cast("int")
    attempts = F.transform(F.sequence(F.lit(0), edits), lambda e: hash_numbers(
        seed, key, F.sequence(F.lit(100) + e * OCR_ATTEMPTS, F.lit(100 + OCR_ATTEMPTS - 1) + e * OCR_ATTEMPTS)))
    return F.aggregate(attempts, name, edit)


def _reordered(name: Column) -> Column:
    words = _words(name)
    n = F.size(words)
    last = _rtrim(F.element_at(words, -1), ",")
    swapped = F.concat(last, F.lit(", "), _rtrim(F.element_at(words, 1), ","))
    rotated = F.concat_ws(" ", last, F.array_join(F.slice(words, F.lit(1), n - 1), " "))
    return F.when(n == 2, swapped).when(n > 2, rotated)


def perturbed(kind: str, name: Column, seed: int, key: Column) -> Column:
    """The changed name, or null where the kind does not apply. ``key`` makes the draws of a row its own."""
    if kind == LEGAL_SUFFIX:
        return F.concat(_rtrim(name, ".,"), _pick(UNLISTED_SUFFIXES, seed, key, 0))
    if kind == ABBREVIATION:
        return _abbreviated(name)
    if kind == OCR_NOISE:
        return _ocr_noise(name, seed, key)
    if kind == REORDERED:
        return _reordered(name)
    if kind == SUBSTRING_TRAP:
        return F.when(hash_draw(seed, key, 0, 3) == 0, F.concat_ws(" ", _pick(TRAP_PREFIXES, seed, key, 1), name)).otherwise(
            F.concat_ws(" ", _rtrim(name, ".,"), _pick(TRAP_ADDITIONS, seed, key, 2)))
    raise ValueError(f"unknown perturbation kind: {kind}")


def perturb(names: DataFrame, kind: str, seed: int) -> DataFrame:
    """(field, doc_id, golden, predicted) over a table of names; rows the kind does not apply to are left out.

    Names are short and what is done with one takes long, so they are dealt to all tasks, however few files they lie in.
    """
    if kind == DIFFERENT_PARTY:
        return different_party(names, 1, seed)
    name = trim_ws(F.col("name"))
    key = F.concat_ws(":", F.lit(kind), F.col("field"), F.col("name"))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.select("field", "doc_id", "name").repartition(tasks)
    return dealt.select("field", "doc_id", F.col("name").alias("golden"), perturbed(kind, name, seed, key).alias("predicted")).where(
        F.col("predicted").isNotNull())


def _indexed(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    pool = stored(distinct_names(names), "names")
    return global_index(pool, F.concat_ws(":", "field", "name"), ["field", "name", "doc_id"]), pool.agg(F.count("*").alias("_pool"))


def different_party(names: DataFrame, per_name: int, seed: int) -> DataFrame:
    """``per_name`` other names of the pool for each name, drawn by index; draws that name the same party are left out.

    A draw is an equi-join on the drawn index, so no pair is formed that is not drawn.
    """
    pool, size = _indexed(names)
    key = F.concat_ws(":", F.lit(DIFFERENT_PARTY), F.col("field"), F.col("name"))
    draws = pool.join(F.broadcast(size)).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(per_name - 1))))
    draws = draws.withColumn("_other", hash_draw(seed, key, F.col("_try"), F.col("_pool")))
    other = pool.select(F.col("idx").alias("_other"), trim_ws(F.col("name")).alias("predicted"))
    return draws.join(other, "_other").where(~names_match(F.col("name"), F.col("predicted"))).select(
        "field", "doc_id", F.col("name").alias("golden"), "predicted").distinct()


def assigned(candidates: DataFrame) -> DataFrame:
    """(slot, id): what slots get that, one after another, take the first of their candidates that is not taken yet.

    ``candidates`` are (slot, attempt, id). In every round each slot asks for the first candidate it has left, each pair
    holds on to the smallest slot that asks, and all larger slots give that pair up for good; so a slot that loses a pair
    goes on to its next one. When no candidate is given up, no two slots ask for one pair, and the slots in order would
    have taken the same.
    """
    left = stored(candidates.groupBy("slot", "id").agg(F.min("attempt").alias("attempt")), "candidates")
    n = left.count()
    while True:
        asks = left.groupBy("slot").agg(F.min(F.struct("attempt", "id")).alias("a")).select("slot", "a.id")
        holders = asks.groupBy("id").agg(F.min("slot").alias("holder"))
        rest = stored(left.join(holders, "id", "left").where(F.col("holder").isNull() | (F.col("slot") <= F.col("holder"))).select(
            "slot", "id", "attempt"), "candidates")
        before, n = n, rest.count()
        if n == before:
            return asks
        left = rest


def calibration_pairs(mismatches: DataFrame, names: DataFrame, target: int = 60, seed: int = 42) -> DataFrame:
    """Every distinct real mismatch, topped up to ``target`` with perturbed names: (id, field, doc_id, golden, predicted, origin).

    Slots cycle through the kinds; a slot tries up to 64 drawn names and keeps the first whose pair is in the gray zone
    and not taken by an earlier slot (see :func:`assigned`). The number of draws depends on the target only, whatever the
    size of the pool. How many real pairs there are is counted when this is called.
    """
    spark = mismatches.sparkSession
    real = stored(dedupe_mismatches(mismatches), "real-pairs").select(
        "id", "field", "doc_id", "golden", "predicted", "origin")
    need = target - real.count()
    if need <= 0:
        return real
    pool, size = _indexed(names)
    slots = target * len(CYCLE)
    draws = spark.range(slots * ATTEMPTS_PER_SLOT).select(
        F.expr(f"cast(id div {ATTEMPTS_PER_SLOT} as int)").alias("slot"),
        (F.col("id") % ATTEMPTS_PER_SLOT).cast("int").alias("attempt"))
    key = F.concat_ws(":", F.lit("slot"), "slot", "attempt")
    draws = draws.withColumn("kind", F.get(F.array(*[F.lit(k) for k in CYCLE]), F.col("slot") % len(CYCLE)))
    draws = draws.join(F.broadcast(size)).where("_pool > 1").withColumns({
        "idx": hash_draw(seed, key, 50, F.col("_pool")), "_other": hash_draw(seed, key, 51, F.col("_pool"))})
    chosen_names = pool.join(draws, "idx")
    others = pool.select(F.col("idx").alias("_other"), F.col("name").alias("_other_name"))
    chosen_names = chosen_names.join(others, "_other")

    name, other = trim_ws(F.col("name")), trim_ws(F.col("_other_name"))
    predicted = F.when(F.col("kind") == DIFFERENT_PARTY, F.when(~names_match(name, other), other))
    for kind in KINDS[:-1]:
        predicted = predicted.when(F.col("kind") == kind, perturbed(kind, name, seed, key))
    candidates = chosen_names.withColumn("predicted", predicted).withColumnRenamed("name", "golden").where(
        gray_zone(F.col("golden"), F.col("predicted")))
    candidates = candidates.withColumn("id", pair_id(F.col("field"), F.col("golden"), F.col("predicted")))
    fresh = stored(candidates.join(real.select("id"), "id", "left_anti").select(
        "slot", "attempt", "id", "kind", "field", "doc_id", "golden", "predicted"), "fresh-pairs")
    chosen = fresh.join(assigned(fresh.select("slot", "attempt", "id")), ["slot", "id"]).groupBy("slot").agg(
        F.min(F.struct("attempt", "id", F.struct("kind", "field", "doc_id", "golden", "predicted").alias("c"))).alias("m"))
    # At most `slots` rows reach this ordering.
    ordered = chosen.withColumn("_rn", F.row_number().over(Window.orderBy("slot")))
    made = ordered.where(F.col("_rn") <= need).select(
        F.col("m.id").alias("id"), F.col("m.c.field").alias("field"), F.col("m.c.doc_id").alias("doc_id"),
        F.col("m.c.golden").alias("golden"), F.col("m.c.predicted").alias("predicted"),
        F.concat(F.lit("synthetic:"), F.col("m.c.kind")).alias("origin"))
    return real.unionAll(made)


def with_excerpts(pairs: DataFrame, text_layers: DataFrame) -> DataFrame:
    """Adds ``excerpt`` from (doc_id, text_layer) and an empty ``human_label``."""
    joined = pairs.join(text_layers.select("doc_id", "text_layer"), "doc_id", "left")
    return joined.withColumns({
        "excerpt": excerpt(F.coalesce("text_layer", F.lit("")), F.col("golden"), F.col("predicted")),
        "human_label": F.lit(None).cast("boolean")}).drop("text_layer")


def label_carry_over(pairs: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with the labels they had before, one row with the number of labelled pairs that are no longer made)."""
    labels = previous.where(F.col("human_label").isNotNull()).groupBy("id").agg(F.max("human_label").alias("_label"))
    merged = pairs.join(labels, "id", "left").withColumn(
        "human_label", F.coalesce("_label", "human_label")).drop("_label")
    dropped = labels.join(pairs.select("id"), "id", "left_anti").agg(F.count("*").alias("dropped"))
    return merged, dropped
