"""Filters, readers and sinks."""

import zipfile

from pyspark.sql import functions as F

from graphloom.sources import facts, filters, sinks


def test_accepts(spark):
    df = spark.createDataFrame([("java.lang",), ("java.lang.ref",), ("java.langx",), ("java.util",), ("java.util.x",)], "p string")
    keep = lambda c: [r[0] for r in df.where(c).collect()]
    assert keep(filters.accepts(F.col("p"), ["java.lang.", "java.util"])) == ["java.lang", "java.lang.ref", "java.util"]
    assert keep(filters.accepts(F.col("p"), ["java.lang."], dotted=False)) == ["java.lang", "java.lang.ref", "java.langx"]
    assert keep(filters.accepts(F.col("p"), [])) == [] and len(keep(filters.package_pattern(F.col("p"), []))) == 5


def test_prefix_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a.b", "a.b.T"), ("a.c", "a.c.U")], "package string, type_fqn string").write.parquet(str(tmp_path / "t"))
    types = spark.read.parquet(str(tmp_path / "t"))
    kept = filters.restricted(types, ["a.b."])
    assert [r[1] for r in kept.collect()] == ["a.b.T"] and filters.restricted(types, []).count() == 2
    assert "StringStartsWith(package" in kept._jdf.queryExecution().toString()


def test_annotation_csv(spark):
    rows = [("B", "type", "E1Immutable"), ("B.get()", "method", "NotNull"), ("B.get()", "method", "Constant"), ("B.get()", "method", "NotModified"), ("B:s", "field", "Linked"), ("B:s", "field", "NotNull"), ("B:s", "field", "Modified"), ("B.B(S)#0", "parameter", "NotNull"), ("B.B(S)#0", "parameter", "Modified")]
    a = spark.createDataFrame(rows, "fqn string, kind string, annotation string")
    e = spark.createDataFrame([("B:s", "field"), ("C", "type")], "fqn string, kind string")
    got = {r["fqn"]: r["annotations"] for r in sinks.annotation_csv(a, e).collect()}
    assert got == {"B": "e1immutable-t", "B.get()": "constant-m,notmodified-m,notnull-m", "B:s": "linked-f,modified-f,notnull-f,error-f", "B.B(S)#0": "modified-p,notnull-p", "C": "error-t"}
    assert [r[0] for r in sinks.annotation_json(sinks.annotation_csv(a.where("fqn = 'B'"))).collect()] == ['{"B":"e1immutable-t"}']
    assert sinks.annotation_csv(a.limit(0)).count() == 0


def test_xml_round_trip(spark, tmp_path):
    schema = "package string, name string, annotations array<struct<_name:string,val:array<struct<_name:string,_val:string>>>>"
    items = [("java.util", "java.util.List", [("org.E1Container", [])]), ("java.util", "java.util.List boolean add(E) 0", [("org.NotNull", [("content", "true")])]), ("java.util", "java.util.List boolean add(E)", [("org.Modified", [])]), ("java.lang", "java.lang.String CASE", [("org.NotNull", [])])]
    sinks.write_annotation_xml(spark.createDataFrame(items, schema), str(tmp_path / "x"), ["java.util"])
    got = sorted(map(tuple, facts.read_annotation_xml(spark, str(tmp_path / "x" / "package=java.util")).select("target_kind", "target_fqn", "index", "annotation").collect()), key=str)
    assert got == [("method", "java.util.List boolean add(E)", None, "org.Modified"), ("parameter", "java.util.List boolean add(E)", 0, "org.NotNull"), ("type", "java.util.List", None, "org.E1Container")]
    assert not (tmp_path / "x" / "package=java.lang").exists()


def test_bundle_archives_and_imports(spark, tmp_path):
    facts.write_bundle({"calls": spark.createDataFrame([("a", "b", "0", 0)], facts.SCHEMAS["calls"])}, str(tmp_path / "b"))
    got = facts.read_bundle(spark, str(tmp_path / "b"))
    assert got["calls"].count() == 1 and got["types"].count() == 0 and set(got) == set(facts.SCHEMAS)
    (tmp_path / "jars").mkdir()
    with zipfile.ZipFile(tmp_path / "jars" / "x.jar", "w") as z:
        z.writestr("a/b/C.class", b"12345")
        z.writestr("META-INF/x", b"")
    assert [(r["segments"], r["n_bytes"]) for r in facts.archive_entries(spark, str(tmp_path / "jars")).collect()] == [(["a", "b", "C"], 5)]
    types = spark.createDataFrame([("a.T", "a", None), ("a.T.N", "a", "a.T"), ("b.U", "b", None)], "type_fqn string, package string, enclosing string")
    imports = spark.createDataFrame([("X", "b.U", False, False), ("X", "a", True, False), ("Y", "a.T", True, True), ("Y", "a.T.f", False, True)], "src_type string, name string, is_star boolean, is_static boolean")
    assert sorted(map(tuple, facts.resolve_imports(imports, types).collect())) == [("X", "a.T"), ("X", "b.U"), ("Y", "a.T"), ("Y", "a.T.N")]


def test_imports_are_made_once(spark):
    types = spark.createDataFrame([("a.T", "a", None), ("a.T", "b", None), ("a.U", "a", None), ("a.U", "a", None), ("a.T.N", "a", "a.T")], "type_fqn string, package string, enclosing string")
    imports = spark.createDataFrame([("X", "a", True, False), ("X", "a", True, False), ("X", "b", True, False), ("X", "a.U", False, False), ("Y", "a.U", False, False), ("Y", "a", True, True), ("X", "a.T", True, None), ("Z", "b", True, None)], "src_type string, name string, is_star boolean, is_static boolean")
    out = facts.resolve_imports(imports, types)
    assert sorted(map(tuple, out.collect())) == [("X", "a.T"), ("X", "a.T.N"), ("X", "a.U"), ("Y", "a.U")]
    # what stars make isn't shuffled, but for types in several places
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_nullness_stubs_messages(spark):
    a = spark.createDataFrame([("m", "org.jetbrains.annotations.NotNull"), ("m", "Own")], "target_fqn string, annotation string")
    assert sorted(r["annotation"] for r in facts.translate_nullness(a).collect()) == ["NotNull", "Own"]
    m = spark.createDataFrame([("p", "T", "void f()", ["Modified"]), ("p", "S", "int g()", [])], "package string, type string, signature string, annotations array<string>")
    assert sinks.compose_stubs(m).first()["stub"] == "package p;\n\nclass S$ {\n    int g();\n}\n\nclass T$ {\n    @Modified void f();\n}\n"
    t = spark.createDataFrame([("E", "ENUM", "E"), ("R", "RECORD", "R")], "type_fqn string, nature string, simple_name string")
    f = spark.createDataFrame([("R", "x", "int", False)], "type_fqn string, name string, ptype string, is_static boolean")
    assert sorted(r["method_fqn"] for r in facts.synthetic_members(t, f).collect()) == ["E.name()", "E.valueOf(java.lang.String)", "E.values()", "R.R(int)", "R.x()"]
