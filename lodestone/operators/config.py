"""Dependencies that config files declare, and layers of settings merged."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.batches import by_bytes

# --- fixed values: the sections that are read, and what stands for what is missing ---
JSON_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
YAML_SECTIONS = ("dependencies", "requires", "packages")
NO_NAME, NO_VERSION = "unknown", "unspecified"
# --- end of fixed values ---

_ITEM = "array<struct<name: string, version: string, scope: string>>"
_ARROW_ITEM = pa.struct([("name", pa.string()), ("version", pa.string()), ("scope", pa.string())])


def json_dependencies(text: Column) -> Column:
    """The entries of the three sections as ``name, version, scope``.

    A version that is no text is given as JSON.  Sections that are no objects,
    texts that are no JSON (or have a key twice in an object) and null give
    none.
    """
    parsed = F.try_parse_json(text)

    def section(scope: str) -> Column:
        entries = F.map_entries(F.try_variant_get(parsed, f"$.{scope}", "map<string, variant>"))
        version = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        return F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("name"), version(e["value"]).alias("version"), F.lit(scope).alias("scope"))), F.array().cast(_ITEM))

    return F.concat(*[section(s) for s in JSON_SECTIONS])


def _written(value) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def yaml_items(text: str) -> list[dict]:
    """The items of the three lists of a YAML text; none if it does not parse
    or is no mapping.  Items that are neither text nor mapping are left out."""
    import yaml  # optional: only callers with YAML files need it

    try:
        data = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError, RecursionError):
        return []
    found = []
    for scope in YAML_SECTIONS:
        for item in data[scope] if isinstance(data, dict) and isinstance(data.get(scope), list) else []:
            if isinstance(item, str):
                found.append({"name": item, "version": NO_VERSION, "scope": scope})
            elif isinstance(item, dict):
                found.append({"name": _written(item.get("name", NO_NAME)), "version": _written(item.get("version", NO_VERSION)), "scope": scope})
    return found


def dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, version, scope``: a row per dependency of every file.

    A text whose first character is a brace or a bracket is JSON and stays in
    the JVM; any other is read as YAML.  Null and empty texts have none; files
    that share a key are read each on its own.
    """
    is_json = F.coalesce(F.trim(F.col(text), F.lit(" \t\r\n")).rlike(r"^[{\[]"), F.lit(False))
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in by_bytes(batches, text):
            found = [yaml_items(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_ARROW_ITEM))], [key, "d"])

    by_json = files.where(is_json).select(key, json_dependencies(F.col(text)).alias("d"))
    by_yaml = files.where(~is_json).select(key, text).mapInArrow(run, f"`{key}` {kind}, d {_ITEM}")
    return by_json.unionByName(by_yaml).select(key, F.inline("d"))


def _merged(base, override):
    """Objects are merged key by key; anything else is replaced."""
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    return base | {k: _merged(base[k], v) if k in base else v for k, v in override.items()}


@F.udf(StringType(), useArrow=True)
def deep_merge(layers: list[str | None]) -> str | None:
    """An array of JSON objects, the later over the earlier, as one JSON text
    with sorted keys.

    Null layers and an empty array count as no layer; without any the result is
    ``{}``.  Null, if the array is null or a layer is no JSON object or nested
    too deeply to be read.  An explicit JSON null replaces what it covers.
    """
    if layers is None:
        return None
    whole: dict = {}
    try:
        for layer in layers:
            if layer is not None:
                top = json.loads(layer)
                if not isinstance(top, dict):
                    return None
                whole = _merged(whole, top)
        return json.dumps(whole, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None
