"""Facts from class files: constant pool, flags, super types, fields and methods; code isn't decoded."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Access flags, and the sizes of constants after their tag.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, INTERFACE, ABSTRACT, SYNTHETIC, ANNOTATION, ENUM, VARARGS = 0x1, 0x2, 0x4, 0x8, 0x10, 0x200, 0x400, 0x1000, 0x2000, 0x4000, 0x80
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
CLASS = "archive string, entry string, name string, parent string, interfaces array<string>, flags int, enclosing string, members array<struct<kind:string,name:string,descriptor:string,flags:int,exceptions:array<string>>>, error string"


class ClassFile:
    """One class file; ValueError if it isn't any."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        if self.u4() != 0xCAFEBABE:
            raise ValueError("not a class file")
        self.u4()
        self.pool: list = [None]
        n = self.u2()
        while len(self.pool) < n:
            tag = self.u1()
            if tag == 1:
                size = self.u2()
                self.pool.append(self.bytes_(size).decode("utf-8", "replace"))
                continue
            if tag not in SIZES:
                raise ValueError(f"no such constant: {tag}")
            self.pool.append((tag, self.bytes_(SIZES[tag])))
            if tag in (5, 6):  # these take two places
                self.pool.append(None)
        self.flags, self.name, self.parent = self.u2(), self.class_(self.u2()), self.class_(self.u2())
        self.interfaces = [self.class_(self.u2()) for _ in range(self.u2())]
        self.members = [self.member("field") for _ in range(self.u2())] + [self.member("method") for _ in range(self.u2())]
        self.enclosing = None
        for name, body in self.attributes():
            if name == "InnerClasses":
                for k in range(struct.unpack(">H", body[:2])[0]):
                    inner, outer = struct.unpack(">HH", body[2 + 8 * k : 6 + 8 * k])
                    if self.class_(inner) == self.name:
                        self.enclosing = self.class_(outer)

    def bytes_(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file is cut off")
        self.at += n
        return out

    def u1(self) -> int:
        return self.bytes_(1)[0]

    def u2(self) -> int:
        return int.from_bytes(self.bytes_(2), "big")

    def u4(self) -> int:
        return int.from_bytes(self.bytes_(4), "big")

    def class_(self, index: int) -> str | None:
        return self.pool[int.from_bytes(self.pool[index][1], "big")].replace("/", ".") if index else None

    def attributes(self) -> list[tuple[str, bytes]]:
        return [(self.pool[self.u2()], self.bytes_(self.u4())) for _ in range(self.u2())]

    def member(self, kind: str) -> dict:
        flags, name, descriptor = self.u2(), self.pool[self.u2()], self.pool[self.u2()]
        thrown = next((b for a, b in self.attributes() if a == "Exceptions"), b"\0\0")
        return {"kind": kind, "name": name, "descriptor": descriptor, "flags": flags, "exceptions": [self.class_(x) for x in struct.unpack(f">{len(thrown) // 2}H", thrown)[1:]]}


def class_files(spark: SparkSession, path: str) -> DataFrame:
    """A row of :data:`CLASS` per class file in the archives below a path; one that can't be read has its ``error``.

    An archive is read by one task, its entries one after the other; Spark hands over archives of up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jar,jmod,zip}").load(path)

    schema = spark.createDataFrame([], CLASS).schema

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def table(rows):
            return pa.Table.from_pylist(rows, arrow).combine_chunks().to_batches()[0]

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content[max(0, content.find(b"PK\x03\x04")) :])) as z:
                    for info in z.infolist():
                        if not info.filename.endswith(".class"):
                            continue
                        row = {"archive": name, "entry": info.filename, "interfaces": [], "members": []}
                        try:
                            c = ClassFile(z.read(info))
                            row |= {"name": c.name, "parent": c.parent, "interfaces": c.interfaces, "flags": c.flags, "enclosing": c.enclosing, "members": c.members}
                        except (ValueError, IndexError, TypeError, AttributeError, struct.error) as e:
                            row["error"] = str(e)[:200]
                        rows.append(row)
                        if len(rows) == 500:
                            yield table(rows)
                            rows = []
                if rows:
                    yield table(rows)

    return files.select("path", "content").mapInArrow(run, CLASS)


def fact_tables(classes: DataFrame) -> dict[str, DataFrame]:
    """The fact tables types, methods and fields of class files; synthetic members are left out. Descriptors are decoded by built-in functions."""
    from graphloom.plans.calls import descriptor_types

    flag = lambda c, f: F.col(c).bitwiseAND(F.lit(f)) != 0
    access = lambda c: F.when(flag(c, PUBLIC), F.lit("PUBLIC")).when(flag(c, PROTECTED), F.lit("PROTECTED")).when(flag(c, PRIVATE), F.lit("PRIVATE")).otherwise(F.lit("PACKAGE"))
    good = classes.where("error is null and name <> 'module-info'")
    plain = lambda c: F.translate(c, "$", ".")
    nature = F.when(flag("flags", ANNOTATION), F.lit("ANNOTATION")).when(flag("flags", INTERFACE), F.lit("INTERFACE")).when(flag("flags", ENUM), F.lit("ENUM")).when(F.col("parent") == "java.lang.Record", F.lit("RECORD")).otherwise(F.lit("CLASS"))
    package = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    types = good.select(plain(F.col("name")).alias("type_fqn"), package.alias("package"), F.regexp_extract("name", r"([^.$]*)$", 1).alias("simple_name"), nature.alias("nature"), access("flags").alias("access"), plain(F.col("parent")).alias("parent"), F.transform("interfaces", plain).alias("interfaces"), plain(F.col("enclosing")).alias("enclosing"))
    members = good.select(plain(F.col("name")).alias("type_fqn"), F.explode("members").alias("m")).select("type_fqn", "m.*").where(~flag("flags", SYNTHETIC))
    called = descriptor_types(members.where("kind = 'method' and name <> '<clinit>'"))
    ctor = F.col("name") == "<init>"
    simple = F.when(ctor, F.regexp_extract("type_fqn", r"([^.]*)$", 1)).otherwise(F.col("name"))
    methods = called.select(F.concat("type_fqn", F.lit("."), simple, F.lit("("), F.array_join(F.transform("arguments", plain), ","), F.lit(")")).alias("method_fqn"), "type_fqn", simple.alias("name"), ctor.alias("is_ctor"), flag("flags", STATIC).alias("is_static"), access("flags").alias("access"), flag("flags", ABSTRACT).alias("is_abstract"), flag("flags", VARARGS).alias("is_varargs"), plain(F.col("returns")).alias("return_type"), "exceptions", F.size("arguments").alias("n_params"))
    typed = descriptor_types(members.where("kind = 'field'").withColumn("descriptor", F.concat(F.lit("()"), "descriptor")))
    fields = typed.select(F.concat("type_fqn", F.lit("."), "name").alias("field_fqn"), "type_fqn", "name", plain(F.col("returns")).alias("ptype"), access("flags").alias("access"), flag("flags", STATIC).alias("is_static"), flag("flags", FINAL).alias("is_final"))
    return {"types": types, "methods": methods, "fields": fields}
