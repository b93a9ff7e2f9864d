"""The quality of a filing's facts, from normalised facts to what is kept, what conflicts, why, and the filing's status.

Each step works on what the step before it has left: facts of one identity, raw names that mean one canonical fact, facts without a mapping, the balance equation of a context, the status.
Every step is a window over the facts of a filing's identity, canonical fact or context. Facts are dealt by filing once and nothing is stored between the steps: hashes make most of a fact's bytes, and moved and stored at each step they took fifty times the disk. So one filing is one task's, sorted there
and spilled; the lists of fact ids that issues carry are the result asked for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json, sorted_pairs
from tidemark.operators.normalise import dealt

EQUATION = ("assets", "liabilities", "equity")
VALUE = "decimal(38,10)"


class QualityResult(NamedTuple):
    #: The retained facts with their quality_status; ordered by facts_in_order.
    facts: DataFrame
    #: conflict_id, filing_id, fact_identity_hash, competing_fact_ids, conflict_type, resolution_status, quality_status, detected_at; ordered by conflict_id.
    conflicts: DataFrame
    #: filing_id, code, fact_ids, about (identity, canonical, filing or context); ordered by code and fact_ids.
    issues: DataFrame
    #: filing_id, quality_status (CONFLICT before PARTIAL before VALID), fact_count, conflict_count.
    status: DataFrame


def rounding(decimals: Column) -> Column:
    """Half a unit of the last reported place, exactly; none where it is unknown or INF."""
    return F.when(decimals.isNull() | (decimals == "INF"), F.lit(0).cast(VALUE)).otherwise((F.lit(0.5) * F.pow(F.lit(10.0), -decimals.try_cast("int"))).cast(VALUE))


def fact_order() -> Column:
    """By fact id; of equal ids by identity, value, decimals and name."""
    return F.struct("fact_id", "fact_identity_hash", F.col("fact_value").cast("string").alias("v"), F.coalesce("decimals", F.lit("")).alias("d"), F.coalesce("canonical_name", F.lit("")).alias("c"))


def _json_items(*texts: Column) -> Column:
    """The texts as items of a JSON array, without its brackets."""
    whole = F.to_json(F.array(*texts))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def canonical_key() -> Column:
    """The twelve parts in which one canonical fact is the same under any raw name, as JSON; dimensions are its sorted pairs."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    before = _json_items(text("canonical_name"), text("entity_scheme"), text("entity_identifier"), day("period_start"), day("period_end"), day("instant"), text("unit_signature"), text("currency"))
    return F.concat(F.lit("["), before, F.lit(","), F.to_json(sorted_pairs(F.col("dimensions"), "axis", "member")), F.lit(","), _json_items(text("consolidation_scope"), day("report_period"), text("report_type")), F.lit("]"))


def ids_in_order() -> Column:
    """The fact ids of a group."""
    return F.array_sort(F.collect_list("fact_id"))


def validate_facts(filings: DataFrame, facts: DataFrame) -> QualityResult:
    """Judge all filings at once.

    filings: filing_id, collected_at (any type: when conflicts count as detected). facts: as normalise_facts gives them (value as text or number; a value that is no number is null and equals no other). Facts of filings that aren't listed are left
    out; a filing without facts is PARTIAL with FINANCIAL_NUMERIC_FACTS_MISSING; an empty table of filings gives no rows. Each of the four tables is computed from facts when it is read."""
    rows = judged_facts(filings, facts)
    c, stays, conflict = F.col, F.col("_stays"), F.col("_clash") | F.col("_odd")
    unmapped = c("_there") & (c("mapping_status") == "UNMAPPED")

    uneven = c("_code") == "FINANCIAL_BALANCE_EQUATION_CONFLICT"
    status = F.when(conflict | F.coalesce(uneven, F.lit(False)), "CONFLICT").when(unmapped, "UNVERIFIED").otherwise(c("quality_status"))
    done = rows.where(stays).withColumn("quality_status", status).select(*facts.columns, "fact_value")

    # A fact that stays is in one conflict at most: of its identity, or of its canonical fact.
    groups = rows.where(stays & conflict).groupBy("filing_id", F.when(c("_clash"), c("fact_identity_hash")).otherwise(c("_key")).alias("fact_identity_hash"), c("_clash")).agg(ids_in_order().alias("competing_fact_ids"), F.first("_collected").alias("detected_at"))
    told = {"filing_id": c("filing_id").cast("string"), "fact_identity_hash": c("fact_identity_hash"), "fact_ids": c("competing_fact_ids")}
    kind = F.when(c("_clash"), "VALUE_MISMATCH").otherwise("CANONICAL_VALUE_MISMATCH")
    found = groups.select(F.sha2(canonical_json(told), 256).alias("conflict_id"), "filing_id", "fact_identity_hash", "competing_fact_ids", kind.alias("conflict_type"), F.lit("OPEN").alias("resolution_status"), F.lit("CONFLICT").alias("quality_status"), "detected_at")

    # The groups that a fact is in with an issue; a filing without facts is one of its own.
    member = lambda when, code, about, group: F.when(when, F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(about).alias("about"), (F.lit("") if group is None else c(group)).alias("group")))
    members = F.array_compact(F.array(
        member(c("_many"), F.when(c("_clash"), "FINANCIAL_FACT_CONFLICT").otherwise("FINANCIAL_FACT_DUPLICATE"), "identity", "fact_identity_hash"),
        member(c("_alias"), F.when(c("_odd"), "FINANCIAL_FACT_CONFLICT").otherwise("FINANCIAL_FACT_ALIAS_DUPLICATE"), "canonical", "_key"),
        member(stays & unmapped, "FINANCIAL_FACT_UNMAPPED", "filing", None),
        member(c("_code").isNotNull(), c("_code"), "context", "_context"),
        member(~c("_there"), "FINANCIAL_NUMERIC_FACTS_MISSING", "filing", None),
    ))
    issues = rows.select("filing_id", "fact_id", F.explode(members).alias("_m")).groupBy("filing_id", "_m").agg(ids_in_order().alias("fact_ids")).select("filing_id", "_m.code", "fact_ids", "_m.about")

    # CONFLICT by what conflicts, PARTIAL by what is missing.
    missing = ~c("_there") | (stays & unmapped) | F.coalesce(c("_code") == "FINANCIAL_BALANCE_COMPONENT_MISSING", F.lit(False))
    conflicts = F.count_if((c("_clash") & (c("_place") == 1)) | (c("_odd") & (c("_again") == 1)))
    per = rows.groupBy("filing_id").agg(F.bool_or(conflict | F.coalesce(uneven, F.lit(False))).alias("_bad"), F.bool_or(missing).alias("_partial"), F.count_if(stays).alias("fact_count"), conflicts.alias("conflict_count"))
    whole = F.when(c("_bad"), "CONFLICT").when(c("_partial"), "PARTIAL").otherwise("VALID")
    return QualityResult(done, found, issues, per.select("filing_id", whole.alias("quality_status"), "fact_count", "conflict_count"))


def judged_facts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """All facts of listed filings, and a row for a filing without any (not _there), with the verdict of each step: _many and _clash (identity), _alias and _odd (several raw names; these conflict), _stays, _code (balance equation), and the groups these are about: fact_identity_hash, _key, _context; _place and
    _again number an identity's and a canonical fact's rows."""
    c, no = F.col, F.lit(False)
    # One row a filing: of one that is listed twice, either.
    known = dealt(filings.select("filing_id", c("collected_at").alias("_collected"))).groupBy("filing_id").agg(F.first("_collected").alias("_collected"))
    rows = known.join(dealt(facts).withColumns({"fact_value": c("value").try_cast(VALUE), "_there": F.lit(True)}), "filing_id", "left").withColumn("_there", F.coalesce("_there", no))
    order = ["fact_id", "fact_identity_hash", c("fact_value").cast("string"), F.coalesce("decimals", F.lit("")), F.coalesce("canonical_name", F.lit(""))]

    def group(*key: str):
        by = Window.partitionBy("filing_id", *key).orderBy(*order)
        return by, by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # One identity: equal values are one fact, others conflict and all stay.
    by, every = group("fact_identity_hash")
    n, known_values = F.count(F.lit(1)).over(every), F.count("fact_value").over(every)
    differs = (F.min("fact_value").over(every) != F.max("fact_value").over(every)) | ((n > 1) & (known_values < n))
    rows = rows.withColumns({"_many": n > 1, "_clash": F.coalesce(differs, no), "_place": F.row_number().over(by)})
    held = c("_there") & (c("_clash") | (c("_place") == 1))

    # One canonical fact under several raw names: the first of equal ones stays, others conflict.
    mapped = held & ~c("_clash") & (c("mapping_status") == "MAPPED") & c("canonical_name").isNotNull()
    rows = rows.withColumn("_key", F.when(mapped, F.sha2(canonical_key(), 256)))
    by, every = group("_key")
    known_values = F.count("fact_value").over(every)
    one_value = (known_values == 0) | ((F.min("fact_value").over(every) == F.max("fact_value").over(every)) & (known_values == F.count(F.lit(1)).over(every)))
    rows = rows.withColumns({"_alias": F.coalesce(c("_key").isNotNull() & (F.min("raw_qname").over(every) != F.max("raw_qname").over(every)), no), "_same": one_value, "_again": F.row_number().over(by)})
    rows = rows.withColumns({"_odd": c("_alias") & ~c("_same"), "_stays": held & ~(c("_alias") & c("_same") & (c("_again") > 1))})

    # The balance equation of each context in which a part of it stands.
    context = {x: c(x) for x in ("instant", "unit_signature", "currency", "consolidation_scope")} | {"dimensions": sorted_pairs(c("dimensions"), "axis", "member")}
    part = c("_stays") & ~c("_clash") & ~c("_odd") & (c("mapping_status") == "MAPPED") & c("canonical_name").isin(*EQUATION)
    rows = rows.withColumn("_context", F.when(part, canonical_json(context)))
    by = Window.partitionBy("filing_id", "_context")
    sizes = [F.count_if(c("canonical_name") == x).over(by) for x in EQUATION]
    # Of one fact a name, which is where they are used, the greatest is that fact's.
    first = {x: [F.max(F.when(c("canonical_name") == x, v)).over(by) for v in (c("fact_value"), c("decimals"))] for x in EQUATION}
    gap = F.abs(first["assets"][0] - first["liabilities"][0] - first["equity"][0])
    allowed = sum((rounding(first[x][1]) for x in EQUATION[1:]), rounding(first["assets"][1]))
    code = F.when(F.least(*sizes) == 0, "FINANCIAL_BALANCE_COMPONENT_MISSING").when(F.greatest(*sizes) > 1, None).when(gap > allowed, "FINANCIAL_BALANCE_EQUATION_CONFLICT")
    return rows.withColumn("_code", F.when(c("_context").isNotNull(), code))


#: What comes before the hash in the fact ids that normalise_facts makes.
PREFIX = "fact-"


def id_bytes(fact_id: Column) -> Column:
    """The 32 bytes of an id that normalise_facts makes, in the same order as the ids and less than half as long: for sorting many."""
    return F.unhex(F.substring(fact_id, len(PREFIX) + 1, 64))


def id_text(stored: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.lower(F.hex(stored)))


def in_hash_order(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """rows by key, the bytes of a hash, and more. Hashes are spread evenly, so ranges of their first two bytes are as large as each other: they needn't be sampled, for which all that leads to rows would run twice."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int")
    return rows.repartitionById(n, F.coalesce(F.floor(first * n / 65536), F.lit(0)).cast("int")).sortWithinPartitions(key, *more)


def facts_in_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy(fact_order())


def conflicts_in_order(conflicts: DataFrame) -> DataFrame:
    return conflicts.orderBy("conflict_id")


def issues_in_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("code", "fact_ids", "about")
