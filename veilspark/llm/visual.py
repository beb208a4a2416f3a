"""Visually identical text in one form.

Text is exploded to positioned code points, joined with broadcast tables of decompositions and look-alike letters and of combining
classes, its combining marks are ordered by class within each run after a starter, runs are recomposed and strings rebuilt. Stretches
of characters that stay as they are, such as ASCII and unified ideographs, are kept whole as one position; texts of nothing else, after
their full-width ASCII forms are folded, are not exploded at all. The tables are built by rule from the Unicode database and are bounded
by its size.

Defined results: null stays null; characters that show nothing vanish; any run of white space is one space, none at the ends, so a blank
text becomes empty; case and different ASCII characters stay different. Hangul comes out as its letters. Texts are treated whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.chars import ALL_INVISIBLE_CLASS, code_points, decomposition_rows
from veilspark.session import cut

#: Characters without decomposition, look-alike or combining class; a regular expression's class, checked against the tables in the tests.
STABLE = r" -~一-鿿、。〈-】‘’“”"
_WIDE = "".join(chr(n) for n in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F))


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Starter and mark -> composed character, where Unicode composes them."""
    out = {}
    for n in code_points():
        if 0xAC00 <= n <= 0xD7A3:
            continue
        d = unicodedata.decomposition(chr(n))
        if d and "<" not in d and " " in d and unicodedata.normalize("NFC", chr(n)) == chr(n):
            out["".join(chr(int(x, 16)) for x in d.split())] = chr(n)
    return out


def decomposition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(decomposition_rows(), "c string, d string")


def mark_table(spark: SparkSession) -> DataFrame:
    rows = [(c, k) for n in [*range(0x300, 0x30000), *range(0x1D000, 0x1D200)] if (k := unicodedata.combining(c := chr(n)))]
    return spark.createDataFrame(sorted(set(rows)), "m string, ccc int")


def composed(base: Column, marks: Column) -> Column:
    """A starter with its ordered marks (ccc, s), composed where Unicode does; a mark behind one of its own class that stayed is blocked."""
    pairs = F.from_json(F.lit(json.dumps(compositions())), "map<string,string>")  # a constant
    start = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, m: Column) -> Column:
        one = F.when(a["last"] < m["ccc"], F.try_element_at(pairs, F.concat(a["base"], m["s"])))
        return F.when(one.isNotNull(), F.struct(one.alias("base"), a["rest"].alias("rest"), a["last"].alias("last"))).otherwise(F.struct(a["base"].alias("base"), F.concat(a["rest"], m["s"]).alias("rest"), m["ccc"].alias("last")))

    return F.when(F.size(marks) == 0, base).otherwise(F.aggregate(marks, start, step, lambda a: F.concat(a["base"], a["rest"])))


def one_form(df: DataFrame, key: list[str], text: str, out: str = "form") -> DataFrame:
    """(key, out): each row's text in one form. ``key`` must identify the rows; rows with equal keys must be equal."""
    spark, names = df.sparkSession, key
    key = [f"_k{i}" for i in range(len(names))]  # names that clash with none used below
    base = df.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(names, key)], F.col(text).alias("_t"))
    # Full-width forms become stable ASCII; they are folded in either branch after the test, which reads the text as it is.
    stable = F.col("_t").rlike(rf"^[{STABLE}！-～]*$")
    folded = F.translate("_t", _WIDE, _ASCII)
    spaces = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kept = base.filter(F.col("_t").isNull() | stable).select(*key, spaces(folded).alias(out))
    shown = F.regexp_replace(folded, ALL_INVISIBLE_CLASS, "")  # before the cut: a mark may belong to a letter beyond them
    pieces = F.regexp_extract_all(shown, F.lit(rf"(?s)[{STABLE}]+(?!\p{{M}})|."), 0)
    changed = base.filter(~stable).dropDuplicates(key).select(*key, pieces.alias("_p"))
    x = changed.select(*key, F.posexplode_outer("_p").alias("pos", "c"))
    x = x.join(F.broadcast(decomposition_table(spark)), "c", "left")
    x = x.select(*key, "pos", F.when(F.length("c") > 1, F.array("c")).when(F.col("d").isNull(), F.array("c")).otherwise(F.filter(F.split("d", ""), lambda y: y != "")).alias("_s"))
    x = x.select(*key, "pos", F.posexplode_outer("_s").alias("sub", "s"))
    x = x.join(F.broadcast(mark_table(spark)), F.col("s") == F.col("m"), "left").select(*key, "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("s", F.lit("")).alias("s"), F.coalesce("ccc", F.lit(0)).alias("ccc"))
    w = Window.partitionBy(*key).orderBy("pos", "sub")
    at = F.struct("pos", "sub")
    x = x.withColumn("starter", F.max(F.when((F.col("ccc") == 0) & (F.col("s") != ""), at)).over(w))
    runs = x.groupBy(*key, "starter").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "s"))).alias("r"))
    base = F.array_join(F.transform(F.filter("r", lambda y: y["ccc"] == 0), lambda y: y["s"]), "")
    runs = runs.select(*key, F.struct(F.col("starter"), composed(base, F.filter("r", lambda y: y["ccc"] > 0)).alias("s")).alias("run"))
    built = runs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda y: y["s"]), "").alias("_f"))
    return kept.unionByName(built.select(*key, spaces(F.col("_f")).alias(out))).withColumnsRenamed(dict(zip(key, names)))


def same_looks(df: DataFrame, key: str, scope: list[str], text: str, keep: str | None = None) -> DataFrame:
    """Pairs (key_a < key_b) of one scope whose texts differ and look the same; ``keep`` names a column of the scope to give with them.

    Copies are classed by their exact text first, so that only classes are compared; members are joined to pairs of classes."""
    names, scope = scope, [f"_s{i}" for i in range(len(scope))]
    base = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), *[F.col(f"`{n}`").alias(s) for n, s in zip(names, scope)], F.col(text).alias("t"))
    digest = lambda c: F.unhex(F.md5(c))
    form = one_form(base.withColumn("raw", digest(F.col("t"))), ["k", *scope, "raw"], "t")
    m = form.filter(F.length("form") >= 1).select("k", *scope, "raw", digest(F.col("form")).alias("form")).distinct()
    m = cut(m)  # digests only; what follows reads them several times
    group = [*scope, "form"]
    several = m.groupBy(*group).agg(F.min("raw").alias("r0"), F.max("raw").alias("r1")).filter("r0 <> r1").select(*group)
    eq = [F.col(f"m.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group]
    m = m.alias("m").join(several.alias("g"), eq, "left_semi")
    classes = m.select(*group, "raw").distinct()
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col("a.raw") < F.col("b.raw")]).select(*[F.col(f"a.{c}").alias(c) for c in group], F.col("a.raw").alias("ra"), F.col("b.raw").alias("rb"))
    for side, r in (("x", "ra"), ("y", "rb")):
        n = m.withColumnsRenamed({c: f"{side}_{c}" for c in [*group, "raw", "k"]})
        pairs = pairs.join(n, [F.col(c).eqNullSafe(F.col(f"{side}_{c}")) for c in group] + [F.col(r) == F.col(f"{side}_raw")])
    return pairs.select(*([F.col(scope[names.index(keep)]).alias(keep)] if keep else []), F.least("x_k", "y_k").alias("key_a"), F.greatest("x_k", "y_k").alias("key_b")).distinct()
