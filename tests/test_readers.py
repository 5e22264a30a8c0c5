"""Java sources and class files read into facts."""

import glob
import os
import shutil
import zipfile

import pyspark
import pytest

from graphloom.sources import bytecode, java

SOURCE = """
/* class Not { } */ package a.b; import java.util.*; import static x.Y.z;
@A(b = {1, 2}) public final class C<T extends Comparable<T>> extends B<T> implements I, J<Map<String, T>> {
  int x = a < b ? 1 : 2, y[] = {1, 2}; Map<String, List<T>> m = new HashMap<String, List<T>>(3, f(a, b));
  static { run("}"); } C(final int a, String... b) throws E { char c = '{'; }
  @N public <U> U f(@P List<? super U> l, int[]... q) { return null; }
  record R(int p, String q) { R { } } interface N { int K = 3; void e(); @interface AA { String value() default "x"; } }
  enum E { A(1) { void f() { } }, @X B; int v; }
}
"""


def test_source_reader():
    rows = java.declarations_in(SOURCE)
    of = lambda kind: [(r["type_fqn"], r["name"]) for r in rows if r["kind"] == kind]
    assert of("type") == [("a.b.C", "C"), ("a.b.C.R", "R"), ("a.b.C.N", "N"), ("a.b.C.N.AA", "AA"), ("a.b.C.E", "E")]
    assert of("field") == [("a.b.C", "x"), ("a.b.C", "y"), ("a.b.C", "m"), ("a.b.C.R", "p"), ("a.b.C.R", "q"), ("a.b.C.N", "K"), ("a.b.C.E", "A"), ("a.b.C.E", "B"), ("a.b.C.E", "v")]
    assert of("method") == [("a.b.C", "f"), ("a.b.C.N", "e"), ("a.b.C.N.AA", "value")] and of("constructor") == [("a.b.C", "C"), ("a.b.C.R", "R")] and of("block") == [("a.b.C", "<static>")]
    f = next(r for r in rows if r["kind"] == "method")
    assert f["parameters"] == [{"name": "l", "ptype": "List<? super U>"}, {"name": "q", "ptype": "int[][]"}] and f["annotations"] == ["N"] and f["has_body"]
    assert next(r for r in rows if r["name"] == "y")["result"] == "int[]" and rows[2]["annotations"] == ["A(b = { 1 , 2 })"]


@pytest.mark.parametrize("text", ["class {", "class A { int", "import ;", "package a; nonsense", "class A { void f( }"])
def test_unreadable_sources_say_so(text):
    assert [r["kind"] for r in java.declarations_in(text)] == ["error"]


def test_declarations_of_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/C.java").write_text("class É { }", encoding="latin-1")
    (tmp_path / "x/D.txt").write_text("class D { }")
    rows = java.declarations(java.read_sources(spark, str(tmp_path), "ISO-8859-1")).collect()
    assert [r["name"] for r in rows] == ["É"]
    none = spark.createDataFrame([("a", None), ("b", "")], "source string, text string")
    assert java.declarations(none).collect() == []


def test_class_files(spark, tmp_path):
    (jar,) = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "aopalliance-repackaged-*.jar"))
    shutil.copy(jar, tmp_path)
    with zipfile.ZipFile(tmp_path / "broken.jar", "w") as z:
        z.writestr("a/B.class", b"\xca\xfe\xba\xbe\0\0\0\0\0\x09\x01")
        z.writestr("a/readme.txt", b"x")
    classes = bytecode.class_files(spark, str(tmp_path)).cache()
    assert [(r["entry"], r["error"] is not None) for r in classes.where("entry = 'a/B.class'").collect()] == [("a/B.class", True)]
    tables = {k: v.collect() for k, v in bytecode.fact_tables(classes).items()}
    types = {r["type_fqn"]: r for r in tables["types"]}
    own = types["org.aopalliance.intercept.MethodInterceptor"]
    assert own["nature"] == "INTERFACE" and own["access"] == "PUBLIC" and own["parent"] == "java.lang.Object" and own["interfaces"] == ["org.aopalliance.intercept.Interceptor"] and own["package"] == "org.aopalliance.intercept"
    methods = {r["method_fqn"]: r for r in tables["methods"]}
    invoke = methods["org.aopalliance.intercept.MethodInterceptor.invoke(org.aopalliance.intercept.MethodInvocation)"]
    assert invoke["return_type"] == "java.lang.Object" and invoke["exceptions"] == ["java.lang.Throwable"] and invoke["is_abstract"] and not invoke["is_static"] and invoke["n_params"] == 1
    assert any(r["is_ctor"] and r["type_fqn"] == "org.aopalliance.aop.AspectException" and r["name"] == "AspectException" for r in tables["methods"])
