"""Facts out of extracted report text by labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.reasons import every_reason, first_reason
from tidemark.sources.tables import strict_date

#: Fixed values of the format: labels and their names, unit multipliers, the names that must be there, and the labels of the unit and the period.
LABELS = {"资产总计": "total_assets", "负债合计": "total_liabilities", "所有者权益合计": "equity", "股东权益合计": "equity", "营业收入": "revenue", "净利润": "net_profit", "经营活动产生的现金流量净额": "operating_cash_flow"}
UNITS = {"人民币元": 1, "元": 1, "万元": 10_000, "亿元": 100_000_000}
REQUIRED = ("total_assets", "total_liabilities", "equity", "revenue", "net_profit", "operating_cash_flow")
UNIT_LABEL, PERIOD_LABEL = "货币单位", "报告期"
#: Signs between a label and its cell, wide or narrow.
BETWEEN = "[|:\uff5c\uff1a]"


def line_cells(text: Column) -> Column:
    """Array of (label, cell) of the text's lines: what stands before and after the first sign between them, without outer white space. A line without such a sign has no cell."""
    bare = lambda x: F.btrim(x, F.lit(" \t\r\u3000"))
    parts = F.transform(F.split(text, "\n"), lambda line: F.split(line, BETWEEN, 2))
    return F.transform(parts, lambda p: F.struct(bare(p[0]).alias("label"), bare(F.get(p, F.lit(1))).alias("cell")))


def cell_of(cells: Column, label: str) -> Column:
    """The cell of the first line with a label."""
    return F.get(F.filter(cells, lambda c: c["label"] == label), F.lit(0))["cell"]


def amount_of(cell: Column) -> Column:
    """The number in a cell: digits, all together or in groups of three, with a sign or in parentheses, which mean minus. Null for anything else."""
    minus = cell.startswith("(") & cell.endswith(")")
    plain = F.when(minus, F.substring(cell, F.lit(2), F.length(cell) - 2)).otherwise(F.regexp_replace(cell, "^[+-]", ""))
    whole = F.split_part(plain, F.lit("."), F.lit(1))
    grouped = F.forall(F.slice(F.split(whole, ","), 2, 99), lambda g: F.length(g) == 3) & (F.length(F.split(whole, ",")[0]) <= F.when(whole.contains(","), 3).otherwise(99))
    number = F.when(grouped & plain.rlike("^[0-9][0-9,.]*$") & ~plain.endswith(".") & ~plain.endswith(","), F.translate(plain, ",", "").try_cast("double"))
    return F.when(minus | cell.startswith("-"), -number).otherwise(number)


def extract_facts(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with report_period, currency_unit, multiplier, a column per name, and unreadable (names whose cell is there and no number). Of two labels of one name the later in LABELS wins; a unit or day that isn't one is null."""
    rows = rows.withColumn("_cells", line_cells(F.col(text)))
    of = lambda label: cell_of(F.col("_cells"), label)
    unit = F.when(of(UNIT_LABEL).isin(*UNITS), of(UNIT_LABEL))
    times = F.coalesce(*[F.when(F.col("currency_unit") == u, F.lit(float(m))) for u, m in UNITS.items()])
    cells = {name: F.coalesce(*[of(label) for label, n in reversed(LABELS.items()) if n == name]) for name in REQUIRED}
    out = rows.withColumns({"report_period": strict_date(of(PERIOD_LABEL)), "currency_unit": unit} | {f"_{n}": c for n, c in cells.items()}).withColumn("multiplier", times)
    amounts = {n: amount_of(F.col(f"_{n}")) for n in REQUIRED}
    unreadable = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull() & a.isNull(), F.lit(n)) for n, a in amounts.items()]))
    out = out.withColumns({n: a * F.coalesce("multiplier", F.lit(1.0)) for n, a in amounts.items()} | {"unreadable": unreadable})
    return out.drop("_cells", *[f"_{n}" for n in REQUIRED])


def extraction_issues(facts: DataFrame) -> DataFrame:
    """facts with issues, in order; none makes the extraction valid."""
    c = F.col
    gap = F.abs(c("total_assets") - c("total_liabilities") - c("equity"))
    missing = c(REQUIRED[0]).isNull()
    for name in REQUIRED[1:]:
        missing = missing | c(name).isNull()
    rules = {
        "PDF_REPORT_PERIOD_MISSING": c("report_period").isNull(),
        "PDF_CURRENCY_MISSING": c("currency_unit").isNull(),
        "PDF_UNIT_MULTIPLIER_MISSING": c("multiplier").isNull(),
        "PDF_REQUIRED_FACTS_MISSING": missing,
        "PDF_BALANCE_EQUATION_FAILED": gap > F.greatest(F.abs("total_assets") * 0.001, F.lit(1.0)),
    }
    return facts.withColumn("issues", every_reason(rules))


def prefer_source(rows: DataFrame) -> DataFrame:
    """key, chosen, reason. rows: key, tagged_status, text_status, clash: valid tagged facts win (a clash is told), then valid text facts."""
    c = F.col
    chosen = F.when(c("tagged_status") == "VALID", "XBRL").when(c("text_status") == "VALID", "PDF")
    reason = F.when(c("tagged_status") == "VALID", F.when(c("clash"), "XBRL_PDF_FACT_CONFLICT")).otherwise(first_reason({"FINANCIAL_SOURCE_MISSING": c("text_status").isNull(), "CNINFO_PDF_UNVERIFIED": c("text_status") != "VALID"}))
    return rows.select("key", chosen.alias("chosen"), reason.alias("reason"))


def source_conflicts(tagged: DataFrame, text: DataFrame) -> DataFrame:
    """key, name, tagged_value, text_value of the names that both documents of a key give with different values. Both: key, name, value."""
    both = tagged.select("key", "name", F.col("value").alias("tagged_value")).join(text.select("key", "name", F.col("value").alias("text_value")), ["key", "name"])
    return both.where("tagged_value <> text_value")
