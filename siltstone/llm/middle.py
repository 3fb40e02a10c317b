"""Fill-in-middle transformation by relational units.

A text is cut into units, a run of letters or one other code point each. Units are laid out as rows (posexplode), window
running sums of their lengths give the offset at which each unit ends, the cut requests of a text are joined to them by the
unit's ordinal, the offsets found are gathered for each text, and `substring` makes the three parts. A text and its units meet
by 128 bits of hash of (doc_id, text), so texts travel once and nothing but numbers follows; rows that agree in both are laid
out once and answered alike. Only units before the second cut are laid out, as no later offset is asked for.

Defined results: null text counts as empty and is plain; an empty text has no units; null doc_id draws with an empty name;
rows that share doc_id and text get the same form; further columns are left aside, whatever their names; an empty table gives
no rows. One text's units are sorted by one task, so a task's need follows its longest text, as Spark's rows do anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have their suffix first.
RATE, SPM_RATE = 90, 20
FORMS = ["plain", "psm", "spm"]
KEYS = ["id_1", "id_2"]


def draw(k: int) -> Column:
    """The k-th (from 1) of a document's numbers: 8 hexadecimal digits of the hash of its id."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(name, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output; one row a row of docs."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    own = docs.select("doc_id", text).select(F.xxhash64("doc_id", "text").alias("id_1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("id_2"), "doc_id", "text")
    moved = own.repartition(*KEYS)
    once = moved.dropDuplicates(KEYS)

    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (draw(3) % 100 >= rate)
    form = F.when(plain, 0).when(draw(4) % 100 < spm_rate, 2).otherwise(1)
    cut = once.withColumn("unit", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumns({"n": F.size("unit").cast("long"), "form": form})
    cut = cut.withColumns({"a": draw(1) % (F.col("n") + 1), "b": draw(2) % (F.col("n") + 1)})
    ordinals = F.when(F.col("form") > 0, F.array(F.least("a", "b"), F.greatest("a", "b"))).otherwise(F.array(F.lit(0).cast("long")))
    asked = cut.select(*KEYS, "n", "form", F.posexplode(ordinals).alias("which", "ordinal"))

    # unit 0 is empty, so that unit k ends where k units end
    before = F.when(F.col("form") > 0, F.greatest("a", "b")).otherwise(0).cast("int")
    units = cut.select(*KEYS, F.posexplode(F.concat(F.array(F.lit("")), F.slice("unit", F.lit(1), before))).alias("at", "unit")).select(*KEYS, "at", F.length("unit").alias("size"))
    ends = units.withColumn("end", F.sum("size").over(Window.partitionBy(*KEYS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).drop("size")
    # the ordinal is not one of the join's keys, so that both sides stay where their texts are
    met = ends.join(asked, KEYS).where(F.col("at") - F.col("ordinal") == 0)
    found = met.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max("form").alias("form"), F.min("end").alias("first"), F.max("end").alias("second"))

    both = moved.join(found, KEYS).withColumns({"cut": F.col("form") > 0, "first": F.col("first").cast("int"), "second": F.col("second").cast("int")})
    parts = {
        "prefix": F.substring("text", F.lit(1), F.col("first")),
        "middle": F.substring("text", F.col("first") + 1, F.col("second") - F.col("first")),
        "suffix": F.substring("text", F.col("second") + 1, F.length("text")),
    }
    prefix, middle, suffix = (parts[k] for k in ("prefix", "middle", "suffix"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(~F.col("cut"), F.col("text")).when(F.col("form") == 1, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return both.select(
        "doc_id", "text", "n", F.element_at(F.array(*map(F.lit, FORMS)), F.col("form") + 1).alias("form"),
        F.when(F.col("cut"), F.col("first").cast("long")).alias("prefix_chars"), F.when(F.col("cut"), (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def restored() -> Column:
    """The text, from `output` and `form` alone; a transformed text holds no mark, so the first of each kind is the one set."""
    output, size = F.col("output"), F.lit(len(PREFIX))
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring(output, a + size, b - a - size)
    last = F.substring(output, m + size, F.length(output))
    return F.when(F.col("form") == "plain", output).when(F.col("form") == "psm", F.concat(between(p, s), last, between(s, m))).otherwise(F.concat(between(p, m), last, between(s, p)))
