"""Tagged report instances in XML: contexts, units, numeric facts and diagnostics, a file at a time inside tasks."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Namespaces, and tokens that make a file unsafe.
XBRLI, NIL = "{http://www.xbrl.org/2003/instance}", "{http://www.w3.org/2001/XMLSchema-instance}nil"
DIMENSION = "{http://xbrl.org/2006/xbrldi}explicitMember"
TYPED = "{http://xbrl.org/2006/xbrldi}typedMember"
UNSAFE = r"(?i)<!(doctype|entity)"
#: Extensions and the content types they may have.
INSTANCE_TYPES = {".xml": ("application/xml", "text/xml", "application/xbrl+xml"), ".xbrl": ("application/xml", "text/xml", "application/xbrl+xml"), ".zip": ("application/zip",)}
ROWS = ("contexts array<struct<context_id:string,entity_scheme:string,entity_identifier:string,period_start:string,period_end:string,instant:string,dimensions:array<struct<axis:string,member:string>>>>, "
        "units array<struct<unit_id:string,over:array<string>,under:array<string>>>, facts array<struct<raw_qname:string,fact_name:string,value:string,decimals:string,context_id:string,unit_id:string>>, nil_facts int, text_facts int")  # fmt: skip


def attachment_reason(files: DataFrame) -> DataFrame:
    """files (path, content, content_type) with reason: FINANCIAL_ATTACHMENT_TYPE_INVALID where extension, content type and first bytes don't agree, FINANCIAL_XML_UNSAFE for a document type or entity, in UTF-8 or UTF-16."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    kind = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
    fits = F.lit(False)
    for s, kinds in INSTANCE_TYPES.items():
        fits = fits | ((suffix == s) & kind.isin(*kinds))
    head = F.hex(F.substring("content", 1, 4))
    text = F.when(head.startswith("FFFE"), F.decode(F.col("content"), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(F.col("content"), "UTF-16BE")).otherwise(F.decode(F.col("content"), "ISO-8859-1"))
    # Of the byte order marks only signs that decode to no letter come before the first "<".
    xml = text.rlike(r"^(\x{EF}\x{BB}\x{BF}|\x{FEFF})?[ \t\r\n]*<")
    good = fits & F.when(suffix == ".zip", head.startswith("504B")).otherwise(xml)
    reason = F.when(~F.coalesce(good, F.lit(False)), "FINANCIAL_ATTACHMENT_TYPE_INVALID").when((suffix != ".zip") & text.rlike(UNSAFE), "FINANCIAL_XML_UNSAFE")
    return files.withColumn("reason", reason)


def _clark(text: str | None, names: dict[str, str]) -> str:
    prefix, colon, local = (text or "").strip().rpartition(":")
    space = names.get(prefix)
    if colon and not space:
        raise ValueError(f"prefix {prefix}")
    return f"{{{space}}}{local}" if space else local


class UnsafeXml(ValueError):
    """A document type, and with it entities."""


def refuse_types(content: bytes) -> dict[str, str]:
    """UnsafeXml for a document type declaration, in whatever encoding; nothing behind it is read, so no entity is expanded. Gives the attributes of the root element as they are written."""
    found: dict[str, str] = {}

    class Begun(Exception):
        pass

    def unsafe(*_):
        raise UnsafeXml

    def begun(_, attributes):
        found.update(attributes)
        raise Begun

    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler, parser.StartElementHandler = unsafe, begun
    with contextlib.suppress(Begun, expat.ExpatError):
        parser.Parse(content, True)
    return found


#: Elements whose text or attributes hold names with prefixes.
NAMED = {XBRLI + "measure", DIMENSION}
XML_PREFIX = ("xml", "http://www.w3.org/XML/1998/namespace")


def scoped_tree(content: bytes) -> tuple[ElementTree.Element, Callable[[ElementTree.Element], dict]]:
    """The root, and a function from an element in NAMED to what the prefixes mean there: a prefix may be bound again further in."""
    root_names = {k[6:]: v for k, v in refuse_types(content).items() if k == "xmlns" or k.startswith("xmlns:")}
    if content.count(b"xmlns") == len(root_names) and b"\0" not in content:
        # Nothing binds a prefix behind the root's own tag, as in most files, and the tree is built without telling every scope. Encodings with zero bytes could hide it.
        everywhere = dict([XML_PREFIX]) | root_names
        return ElementTree.fromstring(content), lambda _: everywhere
    bound, scopes, root = [XML_PREFIX], {}, None
    for event, x in ElementTree.iterparse(io.BytesIO(content), events=("start-ns", "end-ns", "start")):
        if event == "start-ns":
            bound.append(x)
        elif event == "end-ns":
            bound.pop()
        else:
            root = x if root is None else root
            if x.tag in NAMED:
                scopes[x] = dict(bound)
    return root, scopes.__getitem__


def _text(e: ElementTree.Element | None, path: str) -> str | None:
    return (found.text or "").strip() if e is not None and (found := e.find(path)) is not None else None


def _context(c: ElementTree.Element, scope: Callable[[ElementTree.Element], dict]) -> dict:
    entity, period = c.find(f"{XBRLI}entity/{XBRLI}identifier"), c.find(XBRLI + "period")
    start, end, instant = (_text(period, XBRLI + n) for n in ("startDate", "endDate", "instant"))
    if entity is None or not (instant or start and end) or next(c.iter(TYPED), None) is not None:
        raise ValueError("context")
    members = sorted((_clark(m.get("dimension"), scope(m)), _clark(m.text, scope(m))) for m in c.iter(DIMENSION))
    return {"context_id": c.get("id"), "entity_scheme": entity.get("scheme"), "entity_identifier": (entity.text or "").strip(), "period_start": start, "period_end": end, "instant": instant, "dimensions": [{"axis": a, "member": m} for a, m in members]}


def _unit(u: ElementTree.Element, scope: Callable[[ElementTree.Element], dict]) -> dict:
    parts = [u.iterfind(XBRLI + "measure"), []] if u.find(XBRLI + "divide") is None else [u.iterfind(f".//{XBRLI}{n}/{XBRLI}measure") for n in ("unitNumerator", "unitDenominator")]
    over, under = (sorted(_clark(m.text, scope(m)) for m in p) for p in parts)
    return {"unit_id": u.get("id"), "over": over, "under": under}


def parse_instance(content: bytes) -> dict:
    """contexts, units, numeric facts (in tuples too), and counts of nil and text facts. Raises ValueError or ParseError on what can't be read, UnsafeXml on a document type."""
    root, scope = scoped_tree(content)
    contexts, units, facts, nil, prose = [], [], [], 0, 0
    context, unit = XBRLI + "context", XBRLI + "unit"
    for x in root.iter():
        if x.tag == context:
            contexts.append(_context(x, scope))
        elif x.tag == unit:
            units.append(_unit(x, scope))
        if (of := x.get("contextRef")) is None:
            continue
        if x.get(NIL) in ("true", "1"):
            nil += 1
        elif x.get("unitRef") is None:
            prose += 1
        else:
            facts.append({"raw_qname": x.tag, "fact_name": x.tag.rpartition("}")[2], "value": (x.text or "").strip(), "decimals": x.get("decimals"), "context_id": of, "unit_id": x.get("unitRef")})
    return {"contexts": contexts, "units": units, "facts": facts, "nil_facts": nil, "text_facts": prose}


def read_instances(files: DataFrame) -> DataFrame:
    """path, contexts, units, facts, nil_facts, text_facts, issue of instance files (path, content). What can't be parsed, or is unsafe, has an issue and nothing else; a file fits in a task's memory, as its limit of 64 MB says."""
    kinds = files.sparkSession.createDataFrame([], "path string, " + ROWS + ", issue string").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                row = dict.fromkeys(schema.names) | {"path": path}
                try:
                    row |= parse_instance(content or b"")
                except UnsafeXml:
                    row["issue"] = "FINANCIAL_XML_UNSAFE"
                except (ValueError, ElementTree.ParseError):
                    row["issue"] = "FINANCIAL_XBRL_PARSE_ERROR"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(parse, kinds)


def contexts_of(instances: DataFrame, key: str = "path") -> DataFrame:
    """A row per context. Written ends and instants are days that they include."""
    rows = instances.select(key, F.explode("contexts").alias("c")).select(key, "c.*")
    return rows.withColumns({d: F.to_date(d) for d in ("period_start", "period_end", "instant")})


def units_of(instances: DataFrame, key: str = "path") -> DataFrame:
    return instances.select(key, F.explode("units").alias("u")).select(key, "u.*")


def facts_of(instances: DataFrame, key: str = "path") -> DataFrame:
    """A row per numeric fact; value is text and issue tells where it is no number."""
    rows = instances.select(key, F.explode("facts").alias("f")).select(key, "f.*")
    return rows.withColumn("issue", F.when(F.col("value").try_cast("decimal(38,10)").isNull(), "FINANCIAL_XBRL_PARSE_ERROR"))


def instance_codes(instances: DataFrame, key: str = "path") -> DataFrame:
    """key, codes: the different issues of a file and of its facts, sorted; empty where all is well. Files are parsed once: a file's codes are taken from its own row, and rows of one key meet afterwards."""
    wrong = F.exists("facts", lambda f: f["value"].try_cast("decimal(38,10)").isNull())
    own = F.array_compact(F.array("issue", F.when(wrong, "FINANCIAL_XBRL_PARSE_ERROR")))
    return instances.select(key, F.explode_outer(own).alias("_code")).groupBy(key).agg(F.array_sort(F.collect_set("_code")).alias("codes"))


def diagnostics(instances: DataFrame, facts: DataFrame, key: str = "path") -> DataFrame:
    """key, codes: the different issues of a file and of its facts, sorted; empty where all is well."""
    found = facts.where("issue IS NOT NULL").select(key, F.col("issue").alias("_code")).distinct()
    both = instances.select(key, F.col("issue").alias("_code")).union(found)
    return both.groupBy(key).agg(F.array_sort(F.collect_set("_code")).alias("codes"))
