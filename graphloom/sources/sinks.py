"""Sinks: annotations as CSV map, JSON, XML per package, stubs per package, and messages as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The suffix of an annotation by what it is on.
SUFFIX = {"type": "-t", "method": "-m", "field": "-f", "parameter": "-p", "method_type": "-mt", "field_type": "-ft"}


def _suffix(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SUFFIX.items() for x in kv))[kind]


def annotation_csv(annotations: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """K2: (fqn, annotations): sorted lower-case names with suffixes; an element with errors has ``error`` and its suffix last.

    ``annotations``: fqn, kind, annotation; ``errors``: fqn, kind. Names are combined before the shuffle.
    """
    named = annotations.select("fqn", F.concat(F.lower("annotation"), _suffix(F.col("kind"))).alias("a"))
    out = named.groupBy("fqn").agg(F.array_sort(F.collect_set("a")).alias("list"))
    if errors is not None:
        last = errors.groupBy("fqn").agg(F.array(F.min(F.concat(F.lit("error"), _suffix(F.col("kind"))))).alias("last"))
        empty = F.array().cast("array<string>")
        out = out.join(last, "fqn", "full").select("fqn", F.concat(F.coalesce("list", empty), F.coalesce("last", empty)).alias("list"))
    return out.select("fqn", F.array_join("list", ",").alias("annotations"))


def annotation_json(csv: DataFrame) -> DataFrame:
    """K3: the body of an upload, one JSON object a row: (value)."""
    return csv.select(F.to_json(F.create_map("fqn", "annotations")).alias("value"))


def put_json(csv: DataFrame, url: str, batch: int = 1000) -> None:
    """K3: PUT the map to a service, a request for each ``batch`` rows; nothing calls it by itself."""

    def send(rows):
        import json
        from itertools import batched
        from urllib.request import Request, urlopen

        for part in batched(rows, batch):
            body = json.dumps({r["fqn"]: r["annotations"] for r in part}).encode()
            with urlopen(Request(url, data=body, method="PUT", headers={"Content-Type": "application/json"}), timeout=60):
                pass

    csv.foreachPartition(send)


def write_annotation_xml(items: DataFrame, path: str, prefixes: list[str] | None = None) -> None:
    """K1: one folder per package of XML items, sorted by name. ``items``: package, name, annotations (array of structs).

    Elements whose package is at or below one of ``prefixes`` are written, or all.
    """
    from graphloom.sources.filters import preload

    kept = preload(items, prefixes) if prefixes else items
    rows = kept.select("package", F.col("name").alias("_name"), F.col("annotations").alias("annotation"))
    rows.repartition("package").sortWithinPartitions("package", "_name").write.partitionBy("package").format("xml").option("rowTag", "item").option("rootTag", "root").mode("overwrite").save(path)


def compose_stubs(members: DataFrame) -> DataFrame:
    """K4: (package, stub): the text of a stub file for each package's public members.

    ``members``: package, type, signature, annotations (array). A package's members are few against a corpus's; they
    come together in one row, sorted by type and signature.
    """
    line = F.concat(F.lit("    "), F.array_join(F.transform("annotations", lambda a: F.concat(F.lit("@"), a, F.lit(" "))), ""), F.col("signature"), F.lit(";"))
    types = members.groupBy("package", "type").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    text = F.concat(F.lit("class "), F.col("type"), F.lit("$ {\n"), F.array_join("lines", "\n"), F.lit("\n}\n"))
    packages = types.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("type", text.alias("text")))).alias("all"))
    return packages.select("package", F.concat(F.lit("package "), F.col("package"), F.lit(";\n\n"), F.array_join(F.col("all.text"), "\n")).alias("stub"))


def print_types(types: DataFrame, members: DataFrame, width: int = 80) -> DataFrame:
    """K6: (type_fqn, source): a type's declaration with annotations, its members sorted; a member's line over ``width`` is split, each parameter on its own.

    ``types``: type_fqn, simple_name, nature, annotations, parent, interfaces; ``members``: type_fqn, annotations, result (null for
    constructors), name, parameters (array of texts, null for fields). A type's members are bounded by its source.
    """
    marks = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda a: F.concat(F.lit("@"), a, F.lit(" "))), "")
    head = F.concat(F.lit("    "), marks(F.col("annotations")), F.coalesce(F.concat("result", F.lit(" ")), F.lit("")), F.col("name"))
    flat = F.concat(head, F.coalesce(F.concat(F.lit("("), F.array_join("parameters", ", "), F.lit(")")), F.lit("")), F.lit(";"))
    deep = F.concat(head, F.lit("(\n            "), F.array_join("parameters", ",\n            "), F.lit(");"))
    line = F.when((F.length(flat) > width) & (F.size("parameters") > 0), deep).otherwise(flat)
    body = members.groupBy("type_fqn").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_body"))
    word = F.create_map(*(F.lit(x) for kv in {"CLASS": "class", "INTERFACE": "interface", "ENUM": "enum", "RECORD": "record", "ANNOTATION": "@interface"}.items() for x in kv))[F.col("nature")]
    joined = F.array_join("interfaces", ", ")
    up = F.concat(F.coalesce(F.concat(F.lit(" extends "), "parent"), F.lit("")), F.when(F.size("interfaces") > 0, F.concat(F.when(F.col("nature") == "INTERFACE", F.lit(" extends ")).otherwise(F.lit(" implements ")), joined)).otherwise(F.lit("")))
    text = F.concat(marks(F.col("annotations")), word, F.lit(" "), F.col("simple_name"), up, F.lit(" {\n"), F.coalesce(F.concat("_body", F.lit("\n")), F.lit("")), F.lit("}\n"))
    return types.join(body, "type_fqn", "left").select("type_fqn", text.alias("source"))


def message_lines(messages: DataFrame) -> DataFrame:
    """K5: messages as sorted lines: (value)."""
    return messages.orderBy("loc_id", "label", "extra").select(F.concat_ws(" ", "severity", F.concat(F.lit("in "), "loc_id", F.lit(":")), "label", "extra").alias("value"))


def delay_histogram(causes: DataFrame, top: int = 20) -> DataFrame:
    """The elements with the most causes of delay: (element, n, causes), ties by element. ``causes``: element, cause."""
    each = causes.groupBy("element", "cause").agg(F.count(F.lit(1)).alias("c"))
    per = each.groupBy("element").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("cause", "c"))).alias("causes"))
    return per.orderBy(F.desc("n"), "element").limit(top)
