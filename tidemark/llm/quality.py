"""Quality rules with risk-controlled thresholds.

Features of every document are counted with built-in expressions. A rule rejects a document when 1000 * feature > cutoff * base. The rules stand in a fixed order, each with its cutoffs from the laxest to the
strictest; every step along this list rejects all that the steps before it reject and what its own cutoff adds. For each stratum (language) the labelled good documents
are the holdout: a step is certified if the exact one-sided binomial bound shows that all its rules together reject less than alpha of good documents. A step's rejections only
grow, so this is a fixed-sequence test that ends at the first step that fails: it needs no share of the error for each rule and cutoff, and only the strata divide delta (Bonferroni). So with
probability 1 - delta no stratum loses more than alpha of its good documents. Of the certified steps the one is taken that rejects most labelled bad documents less the good ones it costs, the laxest of equal ones;
where none rejects more bad than good, and where the holdout is too small to certify anything (under ln(delta / strata) / ln(1 - alpha) good documents), no rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_RUN, n_of, settle, table, whole_text, words

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
#: Rule: (feature, base).
RULES = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
#: Permille of the base.
CUTOFFS = (20, 40, 60, 80, 100, 150, 200, 300, 400, 500)
ALPHA, DELTA = 0.02, 0.05
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def windows(w: Column) -> Column:
    """The WINDOW-word windows of the array w as text with their places, in order of text."""
    starts = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))


def covered_words(found: Column) -> Column:
    """Words inside those of windows() that occur at least twice. found must be a column of the table: it is read again for each window."""
    twice = F.filter(found, lambda x, j: (F.get(found, j - 1)["w"] == x["w"]) | (F.get(found, j + 1)["w"] == x["w"]))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]


def doubled(hashes: str, k: int) -> Column:
    """Hashes of 2 * k words from those of k words."""
    n = F.size(hashes) - k
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, k + 1, n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, k)))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns and FEATURES (long). Null text has no words, so all features are 0."""
    rest = [c for c in docs.columns if c != text]
    d = docs.select(*rest, whole_text(text).alias("_t"))
    d = d.select("*", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    # A window that occurs twice has a hash that occurs twice: only documents with such a hash are looked at as text.
    # Doubling gives hashes of 2, 4 and 8 words; each select is a step of its own because the next reads its column four times.
    d = d.select("*", F.when(F.size("_w") > WINDOW, F.transform("_w", lambda x: F.xxhash64(x))).alias("_h"))
    for k in (1, 2, 4):
        d = d.withColumn("_h", doubled("_h", k))
    d = d.withColumn("_found", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), windows(F.col("_w"))))
    values = {"n_words": F.size("_w"), "word_chars": F.length(F.regexp_replace("_t", SPACE_RUN, "")), "n_symbols": n_of(F.col("_t"), SYMBOLS), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.when(F.col("_found").isNotNull(), covered_words(F.col("_found"))).otherwise(0), "n_lines": F.size("_lines"), "n_capitals": n_of(F.col("_t"), "[A-Z]+")}
    return d.select(*rest, *[v.cast("long").alias(k) for k, v in values.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X of Binomial(n, p), summed in logarithms so that it neither under- nor overflows."""
    from math import log

    first = n * log(1 - p)
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + log(p / (1 - p))
        return F.struct(t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add)["s"]


def steps(cutoffs: tuple[int, ...] = CUTOFFS) -> list[dict[str, int]]:
    """Cutoff of each rule that rejects at a step."""
    lax = sorted(cutoffs, reverse=True)
    return [dict.fromkeys(list(RULES)[:k], lax[-1]) | {rule: c} for k, rule in enumerate(RULES) for c in lax]


def certificates(features: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """stratum, step, n (good documents held out), k and b (good and bad ones that the step rejects), bound (logarithm of the chance of so few rejections at a rate of alpha), certified; a row for each stratum and step.

    All labelled documents that pass the base rule count; a document with several labels is good if any of them says so; a null stratum is one more."""
    truth = labels.groupBy(F.col(key).alias("_key")).agg(F.max("quality").alias("_good"))
    held = features.join(truth, features[key] == truth["_key"]).where(~base_failed() & F.col("_good").isNotNull())
    lax = sorted(cutoffs, reverse=True)
    # The first step that rejects a document; of a rule, its first cutoff.
    firsts = [F.when(1000 * F.col(f) > c * F.col(b), k * len(lax) + i) for k, (f, b) in enumerate(RULES.values()) for i, c in enumerate(lax)]
    sums = held.groupBy(stratum, F.coalesce(*firsts, F.lit(len(firsts))).alias("first")).agg(F.sum(F.col("_good").cast("long")).alias("good"), F.count("*").alias("all"))
    # From here on there is a row for each stratum and step.
    per = sums.groupBy(stratum).agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "all")).alias("sums"))
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy()))
    upto = lambda step, value: F.aggregate("sums", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["first"] <= step, value(x)).otherwise(0))
    rows = per.select(stratum, "n", "sums", F.explode(F.sequence(F.lit(0), F.lit(len(firsts) - 1))).alias("step"), "strata")
    rows = rows.select(stratum, "step", "n", upto(F.col("step"), lambda x: x["good"]).alias("k"), upto(F.col("step"), lambda x: x["all"] - x["good"]).alias("b"), "strata")
    bound = F.when((F.col("n") > 0) & (F.col("k") <= alpha * F.col("n")), log_binomial_cdf(F.col("k"), F.col("n"), alpha))
    return rows.withColumn("bound", bound).withColumn("certified", F.coalesce(F.col("bound") <= F.log(delta / F.col("strata")), F.lit(False))).drop("strata")


def certified_cutoffs(features: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """stratum and a column for each rule with its cutoff (null: the rule rejects nothing) of the strata in which a step is taken."""
    tested = certificates(features, labels, key=key, stratum=stratum, alpha=alpha, delta=delta, cutoffs=cutoffs)
    best = tested.where("certified AND b > k").groupBy(stratum).agg(F.max_by("step", F.struct(F.col("b") - F.col("k"), -F.col("step"))).alias("step"))
    at = [F.get(F.array(*[F.lit(s.get(r)).cast("int") for s in steps(cutoffs)]), F.col("step")).alias(r) for r in RULES]
    return best.select(stratum, *at)


def verdicts(features: DataFrame, picked: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """features with base_failed and kept. picked: certified_cutoffs, a row a stratum, so rows aren't shuffled to meet them."""
    wide = settle(picked.select(F.col(stratum).alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES]), "quality-cutoffs")
    over = [F.coalesce(1000 * F.col(f) > F.col(f"_{r}") * F.col(b), F.lit(False)) for r, (f, b) in RULES.items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    judged = features.join(wide, features[stratum].eqNullSafe(wide["_stratum"]), "left").withColumn("base_failed", base_failed())
    return judged.select(*features.columns, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def rejections(judged: DataFrame, stratum: str = "lang") -> DataFrame:
    """stratum, n, base (rejected by the base rule), method (passed by it and rejected by a certified cutoff)."""
    method = F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("method")
    return judged.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("base"), method)


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """key, text_hash, stratum, FEATURES, base_failed, kept. Rows of equal key are judged each by its own text; an empty table gives no rows; without labels only the base rule rejects."""
    features = settle(with_features(docs.select(key, stratum, text, F.xxhash64(whole_text(text)).alias("text_hash")), text), "quality-features")
    picked = certified_cutoffs(features, labels, key=key, stratum=stratum)
    return verdicts(features, picked, stratum=stratum).select(key, "text_hash", stratum, *FEATURES, "base_failed", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones, all columns kept, whatever their names.

    All rows are counted once for the cutoffs, of which the labelled ones' numbers meet their labels, and once more where they are judged: so no text is shuffled or stored on the way."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = own.select("row", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["lang"].alias("lang"), F.col("row")["text"].alias("text"))
    held = settle(with_features(rows.drop("row")), "quality-features")
    # A row number, which has no order to it, keeps the verdict above the features: conditions that are pushed below would have each counted anew wherever it is read.
    features = with_features(rows).withColumn("_row", F.monotonically_increasing_id())
    return verdicts(features, certified_cutoffs(held, labels)).where("kept AND _row >= 0").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *FEATURES[:5], "base_failed", "kept")


def _oracle() -> str:
    lax = sorted(CUTOFFS, reverse=True)
    firsts = " ".join(f"WHEN 1000 * {f} > {c} * {b} THEN {k * len(lax) + i}" for k, (f, b) in enumerate(RULES.values()) for i, c in enumerate(lax))
    taken = ", ".join(f"({i}, {', '.join(str(s.get(r, 'NULL')) for r in RULES)})" for i, s in enumerate(steps()))
    over = " OR ".join(f"coalesce(1000 * f.{f} > p.c_{r} * f.{b}, false)" for r, (f, b) in RULES.items())
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM documents),
g AS MATERIALIZED (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) u(i) WHERE len(w) >= 8),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, i - last))::BIGINT AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -7) AS last FROM twice) GROUP BY rid),
f AS MATERIALIZED (
  SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
j AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
l AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
held AS (SELECT lang, good, CASE {firsts} ELSE {len(lax) * len(RULES)} END AS first FROM j JOIN l ON j.doc_id = l.doc_id WHERE NOT base_failed AND good IS NOT NULL),
c AS (SELECT lang, step, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND first <= step) AS k, count(*) FILTER (good = 0 AND first <= step) AS b, (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM held) AS strata
  FROM held, unnest(range({len(lax) * len(RULES)})) u(step) GROUP BY lang, step),
passed AS (SELECT lang, step, b - k AS gain FROM c WHERE n > 0 AND b > k AND k <= {ALPHA} * n AND (
  SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM unnest(range(0, k + 1)) u(i)) <= {DELTA}::DOUBLE / strata),
best AS (SELECT lang, max_by(step, gain * 1000 - step) AS step FROM passed GROUP BY lang),
p AS (SELECT lang, {", ".join(f"c_{r}" for r in RULES)} FROM best JOIN (VALUES {taken}) v(step, {", ".join(f"c_{r}" for r in RULES)}) USING (step))
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, NOT f.base_failed AND NOT ({over}) AS kept
FROM j f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang
"""


OP3_SQL = _oracle()
