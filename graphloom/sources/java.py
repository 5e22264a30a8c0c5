"""Declarations from Java sources: packages, imports, types and their members, with annotations; bodies are skipped over.

A source is one row; a reader walks its tokens once and gives a row per declaration, from which the fact tables are
projections. What a method's body does isn't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|("""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\d[\w.]*|\.\.\.|->|::|[^\s\w])', re.S)
MODIFIERS = frozenset("public protected private static final abstract default native synchronized transient volatile strictfp sealed".split())
NATURES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "@interface": "ANNOTATION"}
DECLARATION = "kind string, package string, type_fqn string, name string, nature string, modifiers array<string>, annotations array<string>, result string, parameters array<struct<name:string,ptype:string>>, extends array<string>, implements array<string>, enclosing string, initialiser string, has_body boolean, is_star boolean"


class Reader:
    """The declarations of one source, as rows of :data:`DECLARATION` in the order of their text."""

    def __init__(self, text: str):
        self.tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
        self.at, self.package, self.rows = 0, "", []

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if not got or wanted not in (None, got):
            raise ValueError(f"expected {wanted or 'more'}, not {got or 'the end'}")
        self.at += 1
        return got

    def taken(self, wanted: str) -> bool:
        if self.peek() == wanted:
            self.at += 1
            return True
        return False

    def row(self, kind: str, name: str, type_fqn: str | None = None, **more) -> None:
        none = {k: None for k in ("nature", "result", "enclosing", "initialiser")} | {"modifiers": [], "annotations": [], "parameters": [], "extends": [], "implements": [], "has_body": False, "is_star": False}
        self.rows.append({"kind": kind, "package": self.package, "type_fqn": type_fqn, "name": name} | none | more)

    def skip(self, opening: str, closing: str) -> str:
        """What stands between a pair, which is passed."""
        self.take(opening)
        start, depth = self.at, 1
        while depth:
            t = self.take()
            depth += (t == opening) - (t == closing)
        return " ".join(self.tokens[start : self.at - 1])

    def qualified(self) -> str:
        out = self.take()
        while self.peek() == "." and self.peek(1) not in ("*", "") and (self.peek(1)[0].isalpha() or self.peek(1)[0] in "_$"):
            self.take()
            out += "." + self.take()
        return out

    def annotation(self) -> str:
        self.take("@")
        name = self.qualified()
        return f"{name}({self.skip('(', ')')})" if self.peek() == "(" else name

    def modifiers(self) -> tuple[list[str], list[str]]:
        words, said = [], []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                said.append(self.annotation())
            elif self.peek() == "non" and self.peek(1) == "-":
                self.at += 3
                words.append("non-sealed")
            elif self.peek() in MODIFIERS and not (self.peek() == "sealed" and self.peek(1) in ("=", ";", ",", "(")) and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                words.append(self.take())
            else:
                return words, said

    def type_arguments(self) -> str:
        self.take("<")
        out, depth = "<", 1
        while depth:
            t = self.take()
            depth += (t == "<") - (t == ">")
            out += f" {t} " if t in ("extends", "super", "&") else t
        return out

    def type_(self) -> str:
        while self.peek() == "@":
            self.annotation()
        out = self.qualified()
        while self.peek() in ("<", "."):
            out += self.type_arguments() if self.peek() == "<" else self.take() + self.qualified()
        while self.peek() in ("[", "@"):
            if self.peek() == "@":
                self.annotation()
                continue
            self.take()
            self.take("]")
            out += "[]"
        return out + ("[]" if self.taken("...") else "")

    def types(self, word: str) -> list[str]:
        if not self.taken(word):
            return []
        out = [self.type_()]
        while self.taken(","):
            out.append(self.type_())
        return out

    def parameters(self) -> list[dict]:
        self.take("(")
        out = []
        while not self.taken(")"):
            self.modifiers()
            kind = self.type_()
            if self.peek() == "this":
                self.take()
            else:
                name = self.take()
                while self.taken("["):
                    self.take("]")
                    kind += "[]"
                out.append({"name": name, "ptype": kind})
            self.taken(",")
        return out

    def initialiser(self) -> str:
        start, depth = self.at, 0
        while depth or self.peek() not in (",", ";"):
            t = self.take()
            if t == "<" and not self._generic():
                continue
            depth += (t in "({[") - (t in ")}]") if len(t) == 1 else 0
        return " ".join(self.tokens[start : self.at])

    def _generic(self) -> bool:
        """Passes type arguments, so that their commas don't end an initialiser; a comparison isn't any."""
        at, depth = self.at, 1
        while depth and at < len(self.tokens) and (self.tokens[at] in ("<", ">", ",", ".", "?", "extends", "super", "[", "]") or self.tokens[at][0].isalpha()):
            depth += (self.tokens[at] == "<") - (self.tokens[at] == ">")
            at += 1
        if not depth:
            self.at = at
        return False

    def unit(self) -> list[dict]:
        start = self.at
        self.modifiers()
        if self.taken("package"):
            self.package = self.qualified()
            self.take(";")
        else:
            self.at = start
        while self.at < len(self.tokens):
            if self.taken(";"):
                continue
            if self.taken("import"):
                static, name = self.taken("static"), self.qualified()
                star = self.taken(".")
                if star:
                    self.take("*")
                self.take(";")
                self.row("import", name, modifiers=["static"] if static else [], is_star=star)
                continue
            self.declaration(None, *self.modifiers())
        return self.rows

    def declaration(self, outer: str | None, words: list[str], said: list[str]) -> None:
        word = self.take()
        word += self.take() if word == "@" else ""
        if word not in NATURES:
            raise ValueError(f"no declaration: {word}")
        name = self.take()
        fqn = f"{outer}.{name}" if outer else f"{self.package}.{name}" if self.package else name
        if self.peek() == "<":
            self.type_arguments()
        parts = self.parameters() if word == "record" else []
        up = self.types("extends")
        own = self.types("implements")
        self.types("permits")
        if word == "interface":
            up, own = [], up
        self.row("type", name, fqn, nature=NATURES[word], modifiers=words, annotations=said, extends=up, implements=own, enclosing=outer, parameters=parts, has_body=True)
        for p in parts:
            self.row("field", p["name"], fqn, result=p["ptype"], modifiers=["private", "final"])
        self.take("{")
        if word == "enum":
            self.constants(fqn)
        while not self.taken("}"):
            self.member(fqn, name, word)

    def constants(self, fqn: str) -> None:
        while self.peek() not in (";", "}"):
            _, said = self.modifiers()
            name = self.take()
            if self.peek() == "(":
                self.skip("(", ")")
            if self.peek() == "{":
                self.skip("{", "}")
            self.row("field", name, fqn, result=fqn, modifiers=["public", "static", "final"], annotations=said)
            self.taken(",")
        self.taken(";")

    def member(self, fqn: str, owner: str, word: str) -> None:
        if self.taken(";"):
            return
        words, said = self.modifiers()
        if self.peek() == "{":
            self.skip("{", "}")
            self.row("block", "<static>" if "static" in words else "<init>", fqn, modifiers=words, has_body=True)
            return
        if self.peek() in ("class", "interface", "enum") or (self.peek() == "@" and self.peek(1) == "interface") or (self.peek() == "record" and self.peek(2) in ("(", "<")):
            self.declaration(fqn, words, said)
            return
        if self.peek() == "<":
            self.type_arguments()
        if word in ("interface", "@interface") and not {"private", "protected"} & set(words):
            words = words if "public" in words else ["public", *words]
        if self.peek() == owner and self.peek(1) in ("(", "{"):
            self.take()
            self.method("constructor", owner, None, fqn, words, said, self.parameters() if self.peek() == "(" else None)
            return
        kind, name = self.type_(), self.take()
        if self.peek() == "(":
            self.method("method", name, kind, fqn, words, said, self.parameters())
            return
        while True:
            extra = kind
            while self.taken("["):
                self.take("]")
                extra += "[]"
            value = self.initialiser() if self.taken("=") else None
            self.row("field", name, fqn, result=extra, modifiers=words if word not in ("interface", "@interface") else sorted({*words, "static", "final"}), annotations=said, initialiser=value)
            if self.taken(";"):
                return
            self.take(",")
            name = self.take()

    def method(self, kind: str, name: str, result: str | None, fqn: str, words: list[str], said: list[str], parameters: list[dict] | None) -> None:
        while self.taken("["):
            self.take("]")
            result = f"{result}[]"
        self.types("throws")
        body = self.peek() == "{"
        if body:
            self.skip("{", "}")
        else:
            if self.taken("default"):
                while self.peek() != ";":
                    self.take()
            self.take(";")
        if parameters is None:  # a record's short constructor has its parts as parameters
            parameters = next(r["parameters"] for r in self.rows if r["kind"] == "type" and r["type_fqn"] == fqn)
        self.row(kind, name, fqn, result=result, modifiers=words, annotations=said, parameters=parameters, has_body=body)


def declarations_in(text: str) -> list[dict]:
    """The rows of a source; one that can't be read gives one row of kind ``error``, its name saying why."""
    reader = Reader(text or "")
    try:
        return reader.unit()
    except (ValueError, RecursionError, StopIteration, IndexError) as e:
        reader.rows = []
        reader.row("error", str(e)[:200])
        return reader.rows


def declarations(sources: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """A row per declaration of each source, with the source's id. Null texts declare nothing; sources are read in Arrow batches."""
    schema = sources.sparkSession.createDataFrame([], DECLARATION).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = declarations_in(body)
                if rows:
                    out = pa.Table.from_pylist(rows, arrow).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * out.num_rows, pa.string()), *out.columns], names=["source", *out.schema.names])

    return sources.select(F.col(source).cast("string"), text).mapInArrow(run, f"source string, {DECLARATION}")


def read_sources(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """S3: (source, text) of the Java files below a path, in a charset of one's own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(path)
    return files.select(F.col("path").alias("source"), F.decode("content", charset).alias("text"))


def access_of(modifiers: Column) -> Column:
    return F.when(F.array_contains(modifiers, "public"), F.lit("PUBLIC")).when(F.array_contains(modifiers, "protected"), F.lit("PROTECTED")).when(F.array_contains(modifiers, "private"), F.lit("PRIVATE")).otherwise(F.lit("PACKAGE"))


def fact_tables(found: DataFrame) -> dict[str, DataFrame]:
    """The fact tables types, methods, parameters, fields, imports and annotations as projections of declarations."""
    has = lambda m: F.array_contains("modifiers", m)
    kind = lambda k: found.where(F.col("kind").isin(k) if isinstance(k, list) else F.col("kind") == k)
    args = F.array_join(F.transform("parameters", lambda p: p["ptype"]), ",")
    method_fqn = F.concat("type_fqn", F.lit("."), "name", F.lit("("), args, F.lit(")")).alias("method_fqn")
    ctor = F.col("kind") == "constructor"
    types = kind("type").select(
        "type_fqn", "package", F.col("name").alias("simple_name"), "nature", access_of(F.col("modifiers")).alias("access"), "modifiers", F.get("extends", 0).alias("parent"), F.col("implements").alias("interfaces"), "enclosing",
        F.coalesce(F.concat("package", F.lit("."), F.split_part(F.substring(F.col("type_fqn"), F.length("package") + 2, F.length("type_fqn")), F.lit("."), F.lit(1))), "type_fqn").alias("primary_type"),
    )
    methods = kind(["method", "constructor"])
    return {
        "types": types,
        "methods": methods.select(method_fqn, "type_fqn", "name", ctor.alias("is_ctor"), has("static").alias("is_static"), access_of(F.col("modifiers")).alias("access"), (~F.col("has_body") & ~ctor).alias("is_abstract"), has("default").alias("is_default"), F.col("result").alias("return_type"), F.size("parameters").alias("n_params")),
        "parameters": methods.select(method_fqn, F.posexplode("parameters").alias("index", "p")).select("method_fqn", "index", "p.name", "p.ptype"),
        "fields": kind("field").select(F.concat("type_fqn", F.lit("."), "name").alias("field_fqn"), "type_fqn", "name", F.col("result").alias("ptype"), access_of(F.col("modifiers")).alias("access"), has("static").alias("is_static"), has("final").alias("is_final"), "initialiser"),
        "imports": kind("import").select("source", "name", "is_star", has("static").alias("is_static")),
        "annotations": found.where("size(annotations) > 0").select("kind", F.when(F.col("kind") == "type", F.col("type_fqn")).when(F.col("kind") == "field", F.concat("type_fqn", F.lit("."), "name")).otherwise(method_fqn).alias("target_fqn"), F.explode("annotations").alias("annotation")),
    }


def contracts(annotations: DataFrame, suffix: str = "$") -> DataFrame:
    """Annotations of annotated-API sources on the types that they stand for: (kind, target_fqn, annotation, contracted).

    A stub of type X is named X with the suffix; annotations of other types are no contracts.
    """
    mark = r"\Q" + suffix + r"\E(?=[.(]|$)"
    return annotations.where(F.col("target_fqn").rlike(mark)).select("kind", F.regexp_replace("target_fqn", mark, "").alias("target_fqn"), "annotation", F.lit(True).alias("contracted"))
