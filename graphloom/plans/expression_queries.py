"""The symbolic module over expressions built from the rows of ``part``, and SQL for the texts that must come out.

Each query has columns of expressions with ``p_size`` in them; SQL says what their canonical form is for every size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import symbolic as S
from graphloom.plans.catalogue import query, t


def canonical_query(name: str, subtypes: dict[str, list[str]] | None = None, limit: int = S.HARD_LIMIT, **columns: tuple[str, str]) -> None:
    """A query of canonical texts by column: (the expression as Spark SQL, what comes out as SQL)."""
    wanted = ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items())

    @query(name, f"SELECT p_partkey, {wanted} FROM part")
    def run(spark, d):
        rows = t(spark, d, "part").select("p_partkey", *(F.expr(e).cast("string").alias(c) for c, (e, _) in columns.items()))
        return rows.select("p_partkey", *(S.canonical(c, subtypes, limit).alias(c) for c in columns))


_TEXT = "CAST({} AS VARCHAR)"

# numbers and strings ------------------------------------------------------------------------------------------

canonical_query("e01_sum", like=("concat('a+', p_size, '+3+a')", "(p_size + 3) || '+2*a'"), gone=("concat('a+', p_size, '-a')", _TEXT.format("p_size")))
canonical_query("e02_product", spread=("concat('(a+', p_size + 1, ')*(b-2)')", "(-2 * (p_size + 1)) || '+-2*a+' || (p_size + 1) || '*b+a*b'"), none=("concat(p_size, '*a*0')", "'0'"))
canonical_query("e03_divide", known=("concat(p_size * 7, '/4')", _TEXT.format("p_size * 7 // 4")), below=("concat('(0-', p_size * 7, ')/4')", _TEXT.format("-(p_size * 7 // 4)")), by_one=("'a/1'", "'a'"), open=("concat('a/', p_size + 1)", "'a/' || (p_size + 1)"))
canonical_query("e04_remainder", known=("concat(p_size * 7, '%4')", _TEXT.format("p_size * 7 % 4")), below=("concat('(0-', p_size * 7, ')%4')", _TEXT.format("-(p_size * 7 % 4)")), by_one=("concat('a%', 1)", "'a'"), open=("concat('a%', p_size + 1)", "'a%' || (p_size + 1)"))
canonical_query("e05_minus", sum=("concat('-(a-', p_size, ')')", "p_size || '+-1*a'"), twice=("concat('-(-', p_size, ')')", _TEXT.format("p_size")))
canonical_query("e06_bit_and", known=("concat(p_size, '&12')", _TEXT.format("p_size & 12")), none=("'a&0'", "'0'"))
canonical_query("e07_bit_or", known=("concat(p_size, '|3')", _TEXT.format("p_size | 3")), same=("'a|0'", "'a'"))
canonical_query("e08_bit_xor", known=("concat(p_size, '^21')", _TEXT.format("xor(p_size, 21)")), same=("'a^0'", "'a'"))
canonical_query("e09_shift_left", known=("concat(p_size, '<<30')", _TEXT.format("(p_size::BIGINT * 1073741824 + 2147483648) % 4294967296 - 2147483648")), round=("concat(p_size, '<<33')", _TEXT.format("p_size * 2")))
canonical_query("e10_shift_right", known=("concat(p_size * 9, '>>2')", _TEXT.format("p_size * 9 // 4")), below=("concat('(0-', p_size, ')>>2')", _TEXT.format("CAST(floor(-p_size / 4.0) AS BIGINT)")))
canonical_query("e11_unsigned_shift", known=("concat(p_size, '>>>1')", _TEXT.format("p_size // 2")), below=("concat('(0-', p_size, ')>>>1')", _TEXT.format("(4294967296 - p_size) // 2")))
canonical_query("e12_unary", flipped=("concat('~', p_size)", _TEXT.format("-p_size - 1")), plus=("concat('+', p_size)", _TEXT.format("p_size")), before=("concat('++a+', p_size)", "(p_size + 1) || '+a'"), after=("concat('a--+', p_size)", "p_size || '+a'"), down=("concat(p_size, '+ --a')", "CASE WHEN p_size = 1 THEN 'a' ELSE (p_size - 1) || '+a' END"))
canonical_query("e13_concat", known=("""concat('"', p_brand, '"+"/"+', p_size)""", """'"' || p_brand || '/' || p_size || '"'"""), empty=("""concat('""+s+"', p_size, '"')""", """'s+"' || p_size || '"'"""))
canonical_query("e14_length", n=("""concat('length("', p_name, '")')""", _TEXT.format("length(p_name)")))
canonical_query("e15_to_string", v=("concat('toString(', p_size, ')')", """'"' || p_size || '"'"""), open=("'toString(a)'", "'toString(a)'"))
canonical_query("e16_equals", known=("""concat('equals("', p_brand, '","Brand#11")')""", "CASE WHEN p_brand = 'Brand#11' THEN 'true' ELSE 'false' END"), same=("concat('equals(a+', p_size, ',', p_size, '+a)')", "'true'"), open=("'equals(a,b)'", "'equals(a,b)'"))
canonical_query("e17_enum_name", v=("concat('name(Size.S', p_size, ')')", """'"S' || p_size || '"'"""), both=("concat('equals(name(Size.S', p_size, '),\"S7\")')", "CASE WHEN p_size = 7 THEN 'true' ELSE 'false' END"))
canonical_query("e18_array", n=("concat('{1,', p_size, ',a}.length')", "'3'"), element=("concat('{10,20,30}[', p_size % 3, ']')", _TEXT.format("(p_size % 3 + 1) * 10")), open=("concat('xs[i+', p_size, ']')", "'xs[' || p_size || '+i]'"))

# conditions ---------------------------------------------------------------------------------------------------

canonical_query("b01_and", v=("concat('x && y>=', p_size, ' && x')", "'x&&y>=' || p_size"), none=("concat('x && y>=', p_size, ' && !x')", "'false'"))
canonical_query("b02_absorb", absorbed=("concat('x && (x || y>=', p_size, ')')", "'x'"), resolved=("concat('x && (!x || y>=', p_size, ')')", "'x&&y>=' || p_size"), both=("concat('(x || y>=', p_size, ') && (x || !(y>=', p_size, '))')", "'x'"))
canonical_query("b03_clash", two=("concat('a==3 && a==', p_size)", "CASE WHEN p_size = 3 THEN '3==a' ELSE 'false' END"), other=("concat('a==3 && a!=', p_size)", "CASE WHEN p_size = 3 THEN 'false' ELSE '3==a' END"))
canonical_query("b04_equality_in_interval", v=("concat('a==3 && a>=', p_size)", "CASE WHEN p_size <= 3 THEN '3==a' ELSE 'false' END"))
canonical_query("b05_tighten", low=("concat('a!=', p_size, ' && a>=', p_size)", "'a>=' || (p_size + 1)"), high=("concat('a!=', p_size, ' && a<=', p_size)", "'a<=' || (p_size - 1)"))
canonical_query("b06_intervals", apart=("concat('a>=', p_size, ' && a<=25')", "CASE WHEN p_size < 25 THEN 'a<=25&&a>=' || p_size WHEN p_size = 25 THEN '25==a' ELSE 'false' END"), nested=("concat('a>=', p_size, ' && a>=25')", "'a>=' || greatest(p_size, 25)"))
canonical_query("b07_subtypes", {"T0": ["T1"]}, v=("concat('x instanceof T', p_size % 3, ' && x instanceof T0')", "CASE p_size % 3 WHEN 0 THEN 'x instanceof T0' WHEN 1 THEN 'x instanceof T1' ELSE 'x instanceof T0&&x instanceof T2' END"))
canonical_query("b08_or", v=("concat('y>=', p_size, ' || x || x')", "'x||y>=' || p_size"), all=("concat('a>=', p_size, ' || a<=30')", "CASE WHEN p_size <= 31 THEN 'true' ELSE 'a<=30||a>=' || p_size END"), spread=("concat('y || (x && a>=', p_size, ')')", "'(a>=' || p_size || '||y)&&(x||y)'"))
canonical_query("b09_negate", morgan=("concat('!(x && y>=', p_size, ')')", "'!x||y<=' || (p_size - 1)"), twice=("concat('!!(y>=', p_size, ')')", "'y>=' || p_size"), unequal=("concat('!(a==', p_size, ')')", "p_size || '!=a'"))
canonical_query("b10_equals", known=("concat('3==', p_size)", "CASE WHEN p_size = 3 THEN 'true' ELSE 'false' END"), solved=("concat('2*a==a+', p_size)", "p_size || '==a'"), same=("concat('a+', p_size, '==', p_size, '+a')", "'true'"), apart=("concat('a==a+', p_size)", "'false'"))
canonical_query("b11_equals_conditional", v=("concat('3==(x?3:', p_size, ')')", "CASE WHEN p_size = 3 THEN 'true' ELSE 'x' END"), other=("concat('3==(x?', p_size, ':3)')", "CASE WHEN p_size = 3 THEN 'true' ELSE '!x' END"))
canonical_query("b12_greater", more=("concat('2*a>', p_size)", "'2*a>=' || (p_size + 1)"), less=("concat(p_size, '<a')", "'a>=' || (p_size + 1)"), most=("concat('a<', p_size)", "'a<=' || (p_size - 1)"), known=("concat(p_size, '>=25')", "CASE WHEN p_size >= 25 THEN 'true' ELSE 'false' END"))
canonical_query("b15_xor", v=("concat('(', p_size, '>25) ^ x')", "CASE WHEN p_size > 25 THEN '!x' ELSE 'x' END"), same=("concat('(y>=', p_size, ') ^ (y>=', p_size, ')')", "'false'"))
canonical_query("b16_conditional", either=("concat('x?true:y>=', p_size)", "'x||y>=' || p_size"), same=("concat('x?', p_size, ':', p_size)", _TEXT.format("p_size")), nested=("concat('x?(y?0:', p_size, '):', p_size)", "'x&&y?0:' || p_size"), turned=("concat('!x?0:', p_size)", "'x?' || p_size || ':0'"))
canonical_query("b17_instance_of", {"T0": ["T1"]}, v=("""CASE p_size % 4 WHEN 0 THEN 'null instanceof T0' WHEN 1 THEN concat('"', p_size, '" instanceof String') WHEN 2 THEN concat(p_size, ' instanceof String') ELSE '(T1)x instanceof T0' END""", "CASE p_size % 4 WHEN 1 THEN 'true' WHEN 3 THEN 'null!=x' ELSE 'false' END"))
canonical_query("b18_cast", narrow=("concat('(byte)(', p_size * 10, ')')", _TEXT.format("(p_size * 10 + 128) % 256 - 128")), kept=("concat('(long)a+', p_size)", "p_size || '+(long)a'"), dropped=("""concat('(String)"', p_size, '"')""", """'"' || p_size || '"'"""))
canonical_query("b19_switch", known=("concat('switch(', p_size % 5, '){1,2->10;3->20;default->30}')", "CASE p_size % 5 WHEN 1 THEN '10' WHEN 2 THEN '10' WHEN 3 THEN '20' ELSE '30' END"), open=("concat('switch(a){1->', p_size, ';default->0}')", "'1==a?' || p_size || ':0'"))
canonical_query("b23_too_large", limit=3, v=("CASE WHEN p_size > 25 THEN 'c' ELSE concat('a+b>=', p_size, ' && c') END", "CASE WHEN p_size > 25 THEN 'c' ELSE 'opaque(a,b,c)' END"))


@query("b13_bounds", "SELECT p_partkey, k, 'a' AS x, CASE k WHEN 'up' THEN CAST(ceil(p_size / 2.0) AS BIGINT) ELSE 3 - p_size END AS b, k = 'down' AS most FROM part, (VALUES ('up'), ('down')) v(k)")
def b13(spark, d):
    texts = F.array(F.struct(F.lit("up").alias("k"), F.expr("concat('2*a>=', p_size)").alias("e")), F.struct(F.lit("down").alias("k"), F.expr("concat('3-a>=', p_size)").alias("e")), F.struct(F.lit("none").alias("k"), F.expr("concat('a+b>=', p_size)").alias("e")))
    rows = t(spark, d, "part").select("p_partkey", F.explode(texts).alias("r")).select("p_partkey", "r.k", "r.e")
    return rows.withColumn("found", S.bounds_of("e")).where("found is not null").select("p_partkey", "k", "found.x", F.col("found.b").cast("long").alias("b"), "found.most")


@query("b14_short_circuit", "SELECT p_partkey, 'a>=10' AS operand, true AS value FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, 'a<=9', false FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, 'b<=' || p_size, true FROM part WHERE p_size >= 19")
def b14(spark, d):
    texts = F.array(F.expr("concat('a>=', p_size, ' && a>=10 && c')"), F.expr("concat('a>=', p_size, ' && a<=9 && 3==4')"), F.expr("concat('b>=20 || b<=', p_size, ' || 1==1')"))
    # once an operand settles the whole, what follows isn't read: 3==4 is reported only where a<=9 isn't false
    rows = t(spark, d, "part").select("p_partkey", F.explode(texts).alias("e")).withColumn("r", F.explode(S.short_circuited("e")))
    return rows.where("r.operand not in ('3==4', '1==1')").select("p_partkey", "r.operand", "r.value")


@query("b20_inequalities", "SELECT p_partkey, CASE WHEN p_size >= 18 THEN 'true' END AS sum_, 'false' AS below, CASE WHEN p_size > 30 THEN 'false' END AS known FROM part")
def b20(spark, d):
    e = F.expr
    rows = t(spark, d, "part").select("p_partkey", e("concat('a>=', p_size, ' && b>=2')").alias("state"), F.lit("a+b>=20").alias("c1"), e("concat('a+b<=', p_size)").alias("c2"), F.lit("a<=30").alias("c3"))
    return rows.select("p_partkey", *(S.decided("state", c).cast("string").alias(name) for c, name in (("c1", "sum_"), ("c2", "below"), ("c3", "known"))))


@query("b21_order", "SELECT p_partkey, p_size || ';a;!a;b>=' || p_size AS v FROM part")
def b21(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.array(F.expr("concat('b>=', p_size)"), F.lit("!a"), F.expr("concat(p_size, '')"), F.lit("a")).alias("e"))
    return rows.select("p_partkey", F.array_join(S.ordered("e"), ";").alias("v"))


@query("b22_equalities", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS l, 'a' AS r FROM part UNION ALL SELECT p_partkey, 'b', 'c' FROM part")
def b22(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr("concat('a==', p_size, ' && b==c && d>1')").alias("e"))
    return rows.select("p_partkey", F.explode(S.equalities_of("e")).alias("x")).select("p_partkey", F.col("x.left").alias("l"), F.col("x.right").alias("r"))


@query("b24_delays", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN '<delayed:a>' ELSE CAST(p_size AS VARCHAR) END AS v, p_size || '+b' AS open FROM part")
def b24(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr("concat('a-a+', p_size)").alias("e"), F.expr("concat('b+', p_size)").alias("o"), F.array(F.when(F.col("p_size") % 2 == 1, F.lit("a")).otherwise(F.lit("z"))).alias("w"))
    return rows.select("p_partkey", S.delay_protected("e", "w").alias("v"), S.delay_protected("o", "w").alias("open"))
