"""Structured extraction: candidates with confidence, schema-driven choice, coercion, validation, provenance."""
from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlake.functions.arrow import map_rows

# fixed values: names under which a property may be found
_FAMILIES = [
    (("name", "title", "headline"), "product_name item_name og:title twitter:title title name"),
    (("description", "summary", "about"), "og:description twitter:description summary details overview"),
    (("image", "image_url", "thumbnail"), "og:image twitter:image photo picture logo"),
    (("company", "brand", "organization", "publisher"), "brand.name brand publisher.name organization vendor site_name"),
    (("author", "creator"), "author.name creator by writer"),
    (("url", "link", "website"), "og:url canonical_url page_url link"),
    (("sku", "mpn", "product_id"), "identifier product_id code item_id"),
    (("price", "cost", "amount"), "product_price price_amount offers.price offers.lowprice lowprice price"),
    (("currency", "price_currency"), "pricecurrency price_currency offers.pricecurrency currency_code"),
    (("availability", "stock", "in_stock"), "offers.availability stock_status in_stock"),
]
ALIAS_FACTOR = 0.9
MAX_DEPTH, MAX_PROPERTIES = 20, 500


def aliases(name: str) -> list[str]:
    """A property's own name in lower case, then its aliases in order."""
    low = name.lower()
    return list(dict.fromkeys([low, *next((a.split() for names, a in _FAMILIES if low in names), [])]))


def scalar(text: str):
    """A raw value as integer, number, boolean, null or text."""
    t = text.strip()
    if re.fullmatch(r"[+-]?\d{1,18}", t):
        return int(t)
    if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", t):
        return float(t)
    return {"true": True, "false": False, "null": None}.get(t.lower(), t)


def json_candidates(value, short: float = 0.95, dotted: float = 0.9, prefix: str = "", depth: int = 0) -> list[tuple[str, object, float]]:
    """``key, value, confidence`` of all members: short keys, and dotted paths with less confidence."""
    out: list[tuple[str, object, float]] = []
    if depth > MAX_DEPTH:
        return out
    if isinstance(value, dict):
        for k, v in value.items():
            if k.startswith("@"):
                continue
            full = f"{prefix}.{k}" if prefix else k
            out.append((k, v, short))
            if prefix:
                out.append((full, v, dotted))
            out += json_candidates(v, short, dotted, full, depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, (dict, list)):
                out += json_candidates(v, short, dotted, f"{prefix}[{i}]", depth + 1)
    return out


CANDIDATES = "key string, value string, confidence double, source string"


def candidates(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``id, ord, key, value, confidence, source``: JSON-LD, then social and plain metas, then cells of two-column tables, then definition lists; values are JSON."""
    from skeinlake.html import extract, parse_html

    kind = dict(pages.select(key).dtypes)[key]

    def one(k, u, h):
        root = parse_html(h)
        found: list[tuple[str, object, float, str]] = []
        for v in extract.json_ld(root)[0]:
            found += [(a, b, c, "json_ld") for a, b, c in json_candidates(v)]
        m = extract.metadata(root, u)
        for name, v in m["open_graph"].items():
            found += [(name.replace(":", "_"), v, 0.85, "meta_tag"), (f"og:{name}", v, 0.8, "meta_tag")]
        for name, v in m["twitter"].items():
            found.append((f"twitter:{name}", v, 0.8, "meta_tag"))
        for name in ("title", "description", "author", "canonical_url", "language", "published_time"):
            if m[name]:
                found.append((name, m[name], 0.85 if name in ("title", "description") else 0.8, "meta_tag"))
        found += [(a, scalar(b), 0.8, "table") for a, b in extract.table_pairs(root)]
        found += [(a, scalar(b), 0.75, "definition_list") for a, b in extract.definitions(root)]
        return [{"id": k, "ord": i, "key": a, "value": json.dumps(b, ensure_ascii=False), "confidence": c, "source": s} for i, (a, b, c, s) in enumerate(found)]

    return map_rows(pages.select(key, url, html), one, f"id {kind}, ord int, {CANDIDATES}")


def json_member_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates of JSON columns, such as metadata of chunks."""
    kind = dict(docs.select(key).dtypes)[key]

    def one(k, t):
        try:
            v = json.loads(t or "{}")
        except ValueError:
            return None
        return [{"id": k, "ord": i, "key": a, "value": json.dumps(b, ensure_ascii=False), "confidence": c, "source": "embedded_json"} for i, (a, b, c) in enumerate(json_candidates(v))]

    return map_rows(docs.select(key, text), one, f"id {kind}, ord int, {CANDIDATES}")


def coerce(value: Column, kind: str) -> Column:
    """A JSON value as text coerced to a JSON-Schema type, as JSON; null where it cannot be."""
    raw = F.regexp_replace(value, r'^"|"$', "")
    digits = F.regexp_replace(raw, r"[^\d.\-]", "")
    if kind == "string":
        return F.when(value.rlike(r"^[\[{]|^null$"), F.lit(None)).otherwise(F.to_json(F.array(raw)).substr(F.lit(2), F.length(F.to_json(F.array(raw))) - 2))
    if kind == "integer":
        return F.when(digits.rlike(r"^-?\d{1,18}(?:\.0*)?$"), F.regexp_replace(digits, r"\.0*$", "").try_cast("long").cast("string"))
    if kind == "number":
        return F.when(digits.rlike(r"^-?\d+(?:\.\d+)?$"), F.regexp_replace(digits.try_cast("double").cast("string"), r"\.0$", ""))
    if kind == "boolean":
        low = F.lower(raw)
        return F.when(low.isin("true", "yes", "1"), F.lit("true")).when(low.isin("false", "no", "0"), F.lit("false"))
    return F.when(value.rlike(r"^\s*\[" if kind == "array" else r"^\s*\{"), value)


def by_schema(cands: DataFrame, schema: dict) -> DataFrame:
    """``id, property, value, confidence, source``: for each property the first candidate of its name that can be coerced, else of its aliases in order at less confidence.

    An alias also matches the end of a dotted path, ``offers.price`` that of ``product.offers.price``. The
    alias table is as large as the schema (at most ``MAX_PROPERTIES`` names), so it is broadcast; every
    candidate meets it by an equi-join on each end of its path.
    """
    spark = cands.sparkSession
    rows = []
    for p, spec in (schema.get("properties") or {}).items():
        kind = spec.get("type", "string")
        kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
        rows += [(p, kind, a, i) for i, a in enumerate(aliases(p))]
    table = spark.createDataFrame(rows, "property string, kind string, alias string, step int")
    steps = F.split(F.lower("key"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.array_join(F.slice(steps, i, F.size(steps)), ".").alias("alias"), (i > 1).alias("end")))
    x = cands.withColumn("_end", F.explode(ends)).select("*", "_end.alias", "_end.end").drop("_end").join(F.broadcast(table), "alias")
    x = x.filter(~F.col("end") | (F.col("step") > 0))  # a property's own name must be the whole key
    value = F.lit(None).cast("string")
    for k in ("string", "integer", "number", "boolean", "array", "object"):
        value = F.when(F.col("kind") == k, coerce(F.col("value"), k)).otherwise(value)
    w = Window.partitionBy("id", "property").orderBy("step", "ord")
    picked = x.withColumn("coerced", value).filter(F.col("coerced").isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return picked.select("id", "property", F.col("coerced").alias("value"), F.round(F.col("confidence") * F.when(F.col("step") > 0, ALIAS_FACTOR).otherwise(1.0), 6).alias("confidence"), "source")


def array_values(cands: DataFrame) -> DataFrame:
    """``id, value, confidence, source``: for an array schema the first candidate of each record that is an array."""
    first = cands.filter(F.col("value").rlike(r"^\s*\[")).groupBy("id").agg(F.min_by(F.struct("value", "confidence", "source"), "ord").alias("x"))
    return first.select("id", "x.*")


def with_missing(values: DataFrame, ids: DataFrame, schema: dict, behaviour: str = "null") -> DataFrame:
    """Values completed for every record (one column of ids): missing properties are left out (``omit``), null, or, if required, an ``error``.

    Adds ``error``, null where there is none. The table of properties is as large as the schema.
    """
    if behaviour == "omit":
        return values.withColumn("error", F.lit(None).cast("string"))
    required = set(schema.get("required", []))
    props = values.sparkSession.createDataFrame([(p, p in required) for p in schema.get("properties") or {}], "property string, required boolean")
    every = ids.select(F.col(ids.columns[0]).alias("id")).distinct().crossJoin(F.broadcast(props))
    x = every.join(values, ["id", "property"], "left")
    error = F.when(F.col("value").isNull() & F.col("required") & F.lit(behaviour == "error"), F.concat(F.lit("missing "), "property"))
    return x.select("id", "property", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source", error.alias("error"))


def repair(value, schema: dict):
    """A value coerced to its schema wherever that loses nothing, members and items included; what cannot be stays as it is."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if isinstance(value, dict):
        props = schema.get("properties") or {}
        return {k: repair(v, props[k]) if k in props else v for k, v in value.items() if k in props or schema.get("additionalProperties") is not False}
    if isinstance(value, list):
        return [repair(v, schema["items"]) for v in value] if isinstance(schema.get("items"), dict) else value
    for kind in kinds:
        if kind == "string" and isinstance(value, (int, float, bool)):
            return json.dumps(value)
        if kind in ("integer", "number") and isinstance(value, str):
            digits = re.sub(r"[^\d.\-]", "", value)
            if re.fullmatch(r"-?\d{1,18}(?:\.0*)?", digits):
                return int(digits.split(".")[0])
            if kind == "number" and re.fullmatch(r"-?\d+\.\d+", digits):
                return float(digits)
        if kind == "integer" and isinstance(value, float) and value.is_integer():
            return int(value)
        if kind == "boolean" and isinstance(value, str) and value.lower() in ("true", "yes", "1", "false", "no", "0"):
            return value.lower() in ("true", "yes", "1")
        if kind == "array" and not isinstance(value, list) and value is not None:
            return [repair(value, schema.get("items") or {})]
    return value


def repaired(records: DataFrame, key: str, value: str, schema: dict) -> DataFrame:
    """``key, value, errors``: JSON values repaired against a schema, and what is still wrong with each; texts that are no JSON have one error."""

    def one(k, v):
        try:
            x = repair(json.loads(v), schema)
        except (TypeError, ValueError):
            return {key: k, "value": None, "errors": ["$: no JSON"]}
        return {key: k, "value": json.dumps(x, ensure_ascii=False), "errors": validate(x, schema)}

    return map_rows(records.select(key, value), one, f"{key} {dict(records.dtypes)[key]}, value string, errors array<string>")


def without_schema(cands: DataFrame) -> DataFrame:
    """``id, key, value, confidence``: the surest candidate of each plain key."""
    w = Window.partitionBy("id", "key").orderBy(F.desc("confidence"), "ord")
    return cands.filter(~F.col("key").rlike(r"[.\[]")).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("id", "key", "value", "confidence")


def provenance(values: DataFrame, chunks: DataFrame, doc: str = "id") -> DataFrame:
    """``id, property, chunk_id, position``: for each value the first chunk of the same document that holds it."""
    raw = F.regexp_replace("value", r'^"|"$', "")
    hit = values.join(chunks.select(F.col(doc).alias("id"), "chunk_id", "position", "text"), "id").filter(F.contains(F.lower("text"), F.lower(raw)) & (raw != ""))
    return hit.groupBy("id", "property").agg(F.min(F.struct("position", "chunk_id")).alias("x")).select("id", "property", F.col("x.chunk_id").alias("chunk_id"), F.col("x.position").alias("position"))


def validate(value, schema: dict, path: str = "$") -> list[str]:
    """Errors of a value against the supported JSON-Schema subset, each with its path."""
    kinds = schema.get("type")
    names = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    have = names[type(value)]
    wanted = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if wanted and have not in wanted and not (have == "integer" and "number" in wanted):
        return [f"{path}: expected {'|'.join(wanted)}, found {have}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the allowed values")
    if have in ("integer", "number"):
        out += [f"{path}: below minimum {schema['minimum']}"] if "minimum" in schema and value < schema["minimum"] else []
        out += [f"{path}: above maximum {schema['maximum']}"] if "maximum" in schema and value > schema["maximum"] else []
    if have == "string":
        n = len(value.encode())
        out += [f"{path}: shorter than {schema['minLength']}"] if "minLength" in schema and n < schema["minLength"] else []
        out += [f"{path}: longer than {schema['maxLength']}"] if "maxLength" in schema and n > schema["maxLength"] else []
    if have == "object":
        props = schema.get("properties") or {}
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in props:
                out += validate(v, props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
    if have == "array" and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += validate(v, schema["items"], f"{path}[{i}]")
    return out


def check_schema(schema, path: str = "$", depth: int = 0) -> list[str]:
    """Errors of a schema itself: types, shapes, depth and number of properties."""
    if not isinstance(schema, dict):
        return [f"{path}: schema must be an object"]
    if depth > MAX_DEPTH:
        return [f"{path}: too deep"]
    known = {"string", "number", "integer", "boolean", "array", "object", "null"}
    kinds = schema.get("type", [])
    out = [f"{path}: unknown type {k}" for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in known]
    props = schema.get("properties", {})
    if not isinstance(props, dict):
        return [*out, f"{path}: properties must be an object"]
    if len(props) > MAX_PROPERTIES:
        out.append(f"{path}: too many properties")
    for k, v in props.items():
        out += check_schema(v, f"{path}.{k}", depth + 1)
    if "items" in schema:
        out += check_schema(schema["items"], f"{path}[]", depth + 1)
    return out


def schema_hash(schema) -> str:
    """Hash of a schema that does not depend on the order of its keys."""
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def relaxed_json(text: str):
    """JSON from a model's answer: the whole, a fenced block, the outermost object, the outermost array; None where there is none."""
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    for a, b in ("{}", "[]"):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            tries.append(text[i : j + 1])
    for t in tries:
        try:
            return json.loads(t.strip())
        except ValueError:
            continue
    return None


def dedupe_entities(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each composite key, compared in lower case without outer space; null parts count as empty."""
    parts = [F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter("_rn = 1").drop("_rn")


# fixed values: weight of a chunk by its kind
CHUNK_WEIGHT = {"json": 1.5, "table": 1.2, "metadata": 1.0, "feed_entry": 0.9, "section": 0.8, "pdf_page": 0.8, "docx_section": 0.8, "paragraph": 0.5}


def chunk_relevance(kind: Column, heading_path: Column, content: Column, keywords: list[str], title: Column | None = None) -> Column:
    """Weight of the kind, 1.0 a keyword in the headings or else 0.3 in the content, 0.2 in the title, and 0.1 for each that matched."""
    score = F.lit(0.5)
    for k, v in CHUNK_WEIGHT.items():
        score = F.when(kind == k, F.lit(v)).otherwise(score)
    heads, body = F.lower(F.array_join(F.coalesce(heading_path, F.array().cast("array<string>")), " ")), F.lower(F.coalesce(content, F.lit("")))
    for w in keywords:
        in_head, in_body = F.contains(heads, F.lit(w)), F.contains(body, F.lit(w))
        score = score + F.when(in_head, 1.1).when(in_body, 0.4).otherwise(0.0)
        if title is not None:
            score = score + F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w)), 0.2).otherwise(0.0)
    return F.round(score, 6)
