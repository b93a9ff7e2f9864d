"""Raw tagged facts to normalised facts: contexts, units, mapping, owners, identities, and the filing they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import day_end, sorted_pairs, stable_hash
from tidemark.functions.reasons import first_reason

#: Measures as namespace and name.
CURRENCIES, SHARES, PURE = "{http://www.xbrl.org/2003/iso4217}", "{http://www.xbrl.org/2003/instance}shares", "{http://www.xbrl.org/2003/instance}pure"


def measured_kind(over: Column, under: Column) -> Column:
    """MONETARY, PER_SHARE, SHARES, PURE, NONE (no unit) or OTHER of a unit's sorted measures."""
    one = F.get(over, F.lit(0))
    money = (F.size(over) == 1) & one.startswith(CURRENCIES) & (F.length(one) > len(CURRENCIES))
    alone = F.size(under) == 0
    kind = F.when(over.isNull(), "NONE").when(money & alone, "MONETARY").when(money & (under == F.array(F.lit(SHARES))), "PER_SHARE")
    return kind.when((over == F.array(F.lit(SHARES))) & alone, "SHARES").when((over == F.array(F.lit(PURE))) & alone, "PURE").otherwise("OTHER")


#: What unit_rows adds.
UNIT = ("currency", "unit", "unit_signature", "unit_kind")


def unit_rows(units: DataFrame) -> DataFrame:
    """units (over, under: arrays of measures) with sorted measures, currency (of a single measure alone), unit, unit_signature, unit_kind."""
    rows = units.withColumns({"over": F.array_sort("over"), "under": F.array_sort("under")})
    one = F.get("over", F.lit(0))
    rows = rows.withColumn("currency", F.when((F.size("over") == 1) & (F.size("under") == 0) & one.startswith(CURRENCIES), F.substring(one, len(CURRENCIES) + 1, 99)))
    text = F.concat(F.array_join("over", "*"), F.when(F.size("under") > 0, F.concat(F.lit("/"), F.array_join("under", "*"))).otherwise(""))
    signature = stable_hash({"numerator_measures": F.col("over"), "denominator_measures": F.col("under"), "currency": F.col("currency")})
    return rows.withColumns({"unit": text, "unit_signature": signature, "unit_kind": measured_kind(F.col("over"), F.col("under"))})


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt by filing, once: groups and windows with filing_id in their keys and joins on it move nothing afterwards. What is dealt so already isn't moved again."""
    return rows.repartition("filing_id")


def listed(rows: DataFrame, name: str) -> DataFrame:
    """A row a filing: its contexts, units or owners as one list. A join on two keys would move both sides again, with all that the facts have gathered."""
    rest = [c for c in rows.columns if c != "filing_id"]
    return dealt(rows).groupBy("filing_id").agg(F.collect_list(F.struct(*rest)).alias(name))


def attach_parts(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """facts with their context and unit, and dangling: they name one that isn't there. Facts, contexts and units of one filing meet by filing_id."""
    return with_parts(facts, listed(contexts, "_cs"), listed(unit_rows(dealt(units)), "_us"), contexts.columns, [*units.columns, *UNIT])


def with_parts(facts: DataFrame, contexts: DataFrame, units: DataFrame, context: list[str], unit: list[str]) -> DataFrame:
    """attach_parts for lists of contexts (_cs) and units (_us) with these columns."""
    rows = dealt(facts).join(contexts, "filing_id", "left").join(units, "filing_id", "left")
    of = lambda name, key: F.filter(name, lambda x: x[key] == F.col(key))
    rows = rows.select(*facts.columns, of("_cs", "context_id").alias("_cs"), of("_us", "unit_id").alias("_us"))
    # One of each, unless an id is there twice.
    rows = rows.select(*facts.columns, "_us", F.explode_outer("_cs").alias("_c")).select(*facts.columns, "_c", F.explode_outer("_us").alias("_u"))
    dangling = F.col("_c").isNull() | (F.col("unit_id").isNotNull() & F.col("_u").isNull())
    return rows.select(*facts.columns, *[F.col(f"_c.{c}") for c in context if c not in ("filing_id", "context_id")], *[F.col(f"_u.{c}") for c in unit if c not in ("filing_id", "unit_id")], dangling.alias("dangling"))


def owners_of(registry: DataFrame) -> DataFrame:
    """entity_scheme, entity_identifier, owners: the different codes that a registry gives for an identifier, sorted."""
    return registry.groupBy("entity_scheme", "entity_identifier").agg(F.array_sort(F.collect_set("code")).alias("owners"))


def normalise_facts(facts: DataFrame, contexts: DataFrame, units: DataFrame, filings: DataFrame, mapping: DataFrame, owners: DataFrame, mapping_version: str = "1") -> DataFrame:
    """A row per fact: name, mapping and quality, three hashes (of the fact's identity, of what other filings can be compared in, of the observation), effective time, and issue where the filing must be refused.

    facts: filing_id, raw_qname, value (text), decimals, context_id, unit_id. contexts: entity_scheme, entity_identifier, period_start, period_end, instant, dimensions (axis,
    member). filings: filing_id, code, report_period, report_type, filing_version, parser_version. mapping: raw_qname, canonical_name, statement_type, expected_kind; it goes to every task, as large as a taxonomy at most.

    Facts are moved once, as they come in; a filing's entities, not its facts, go to their owners and back. Contexts and units of one filing are a list in one row."""
    entity = ["entity_scheme", "entity_identifier"]
    asked = dealt(contexts.select("filing_id", *entity)).distinct()
    found = listed(asked.join(owners, entity).select("filing_id", *entity, "owners"), "_os")
    own = lambda x: F.get(F.filter("_os", lambda o: (o["entity_scheme"] == x["entity_scheme"]) & (o["entity_identifier"] == x["entity_identifier"])), F.lit(0))["owners"]
    there = listed(contexts, "_cs").join(found, "filing_id", "left").select("filing_id", F.transform("_cs", lambda x: x.withField("owners", own(x))).alias("_cs"))
    filed = dealt(facts).join(dealt(filings), "filing_id")
    rows = with_parts(filed, there, listed(unit_rows(dealt(units)), "_us"), [*contexts.columns, "owners"], [*units.columns, *UNIT]).join(F.broadcast(mapping), "raw_qname", "left")
    c, mapped = F.col, F.col("canonical_name").isNotNull()
    issue = first_reason({
        "FINANCIAL_XBRL_PARSE_ERROR": c("dangling"),
        "FINANCIAL_ENTITY_MISMATCH": mapped & ~F.coalesce(c("owners") == F.array("code"), F.lit(False)),
        "FINANCIAL_UNIT_KIND_MISMATCH": mapped & (F.coalesce("unit_kind", F.lit("NONE")) != c("expected_kind")),
    })
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    period = F.struct(day("instant").alias("instant"), day("period_end").alias("period_end"), day("period_start").alias("period_start"))
    place = {e: c(e) for e in entity} | {"period": period, "dimensions": sorted_pairs(c("dimensions"), "axis", "member")}
    same = place | {"raw_qname": c("raw_qname"), "unit_signature": c("unit_signature")}
    rows = rows.withColumns({
        "issue": issue, "mapping_status": F.when(mapped, "MAPPED").otherwise("UNMAPPED"), "quality_status": F.when(mapped, "VALID").otherwise("UNVERIFIED"), "statement_type": F.coalesce("statement_type", F.lit("OTHER")), "consolidation_scope": F.lit("UNKNOWN"),
        "context_signature": stable_hash(place), "fact_identity_hash": stable_hash(same | {"filing_id": c("filing_id").cast("string")}),
        "comparison_identity_hash": stable_hash(same | {"report_period": day("report_period"), "report_type": c("report_type"), "consolidation_scope": F.lit("UNKNOWN")}),
        "effective_at": day_end(c("report_period")), "version": F.concat_ws(":", "filing_version", "parser_version", F.lit(mapping_version)),
    })
    observed = stable_hash({"fact_identity_hash": c("fact_identity_hash"), "fact_value": c("value"), "decimals": c("decimals")})
    return rows.withColumn("fact_id", F.concat(F.lit("fact-"), observed))


def candidate_filings(new: DataFrame, old: DataFrame) -> DataFrame:
    """new filings with supersedes_id, is_restated, version, and issue where they can't be taken: a published filing of the same source, code, period and type is no earlier.

    old: stored filings; only those PUBLISHED count, and not the same filing. The last of the earlier ones, by time and insert order, is the predecessor."""
    key = ["source_id", "code", "report_period", "report_type"]
    before = old.where("artifact_status = 'PUBLISHED'").select(*key, F.col("filing_id").alias("_id"), F.struct("published_at", "ordinal", F.col("filing_id").alias("id")).alias("_when"))
    met = new.join(before, key, "left").where((F.col("_id") != F.col("filing_id")) | F.col("_id").isNull()).select("filing_id", "published_at", "_when")
    earlier = F.col("_when.published_at") < F.col("published_at")
    last = met.groupBy("filing_id").agg(F.max(F.when(earlier, F.col("_when"))).alias("_last"), F.coalesce(F.bool_or(~earlier), F.lit(False)).alias("_late"))
    rows = new.join(last, "filing_id", "left")
    return rows.select(*new.columns, F.col("_last.id").alias("supersedes_id"), F.col("_last").isNotNull().alias("is_restated"), F.when(F.col("_late"), "FINANCIAL_BACKFILL_UNSUPPORTED").alias("issue"))


def finalise(filings: DataFrame, facts: DataFrame, status: DataFrame, valid_from: Column) -> tuple[DataFrame, DataFrame]:
    """Filings with their quality (status: filing_id, quality_status, conflict_count), fact count and time of validity, and facts with the same time."""
    counts = facts.groupBy("filing_id").agg(F.count("*").alias("fact_count"))
    rest = filings.drop("quality_status", "fact_count", "conflict_count", "valid_from")
    done = rest.join(status, "filing_id").join(counts, "filing_id", "left").withColumns({"fact_count": F.coalesce("fact_count", F.lit(0)), "valid_from": valid_from})
    return done, facts.withColumn("valid_from", valid_from)


def in_order(facts: DataFrame, *more: str) -> DataFrame:
    """Facts by name, context and decimals, those without decimals first, then by more: where many facts share the first three, more deals them over tasks."""
    return facts.orderBy("raw_qname", "context_id", F.coalesce("decimals", F.lit("")), *more)


def requested(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """A row per requested id (request, ids array), in order, with its registry payload; missing tells that the request can't be met."""
    each = ids.select("request", F.posexplode("ids").alias("place", "taxonomy_id")).join(registry, "taxonomy_id", "left")
    return each.withColumn("missing", F.col("payload").isNull())
