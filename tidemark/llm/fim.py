"""Fill-in-the-middle by relational units.

A text is a sequence of units; a cut is asked for by its unit's ordinal and answered with an offset in code points.
Units are exploded in two steps, so that a corpus does not become one row per word: first the blocks of BLOCK units
each, whose lengths are summed up along the text by a window; requests join the block that their ordinal lies in, and
only these blocks are exploded into units, whose lengths are summed up by a second window. Offsets are aggregated per
document and joined to the texts, which move once and are cut by substrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: units in a block
BLOCK = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100 documents that have no mark in them so many stay plain; of 100 others so many have the suffix first
PLAIN_OF_100, SPM_OF_100 = 10, 20


def draws(id_col: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 that follow from an id and nothing else; a NULL id is like an empty one."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, id_col: Column) -> Column:
    """plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    _, _, h3, h4 = draws(id_col)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= 100 - PLAIN_OF_100)
    return F.when(plain, "plain").when(h4 % 100 < SPM_OF_100, "spm").otherwise("psm")


def key_of(text: Column, id_col: Column) -> Column:
    """Rows that agree in id and text are cut alike, and share this key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(id_col.cast("string"), F.lit(":")), F.lit("-")), text).cast("binary")))


def blocks(rows: DataFrame) -> DataFrame:
    """(row, key, n, low, high, block, chars, piece), written: every block of every text, and its outline where a cut lies in it.

    rows: (id, text). low and high are the numbers of units before the two cuts, NULL for plain texts; n counts all units.
    An outline has `a` for every letter and a blank for every other code point: the same units, in a third of the room.
    """
    matches = F.regexp_extract_all("text", F.lit(f"(?:{UNIT}){{1,{BLOCK}}}"), F.lit(0))
    read = rows.select("id", "text", key_of(F.col("text"), F.col("id")).alias("key"), form_of(F.col("text"), F.col("id")).alias("form"), F.monotonically_increasing_id().alias("row"))
    cut = read.withColumn("matches", matches).withColumn("last", F.coalesce(F.try_element_at("matches", F.lit(-1)), F.lit("")))
    cut = cut.withColumn("n", (F.greatest(F.size("matches") - 1, F.lit(0)) * BLOCK + F.regexp_count("last", F.lit(UNIT))).cast("long"))
    h1, h2, _, _ = draws(F.col("id"))
    at = [F.when(F.col("form") != "plain", F.pmod(h, F.col("n") + 1)) for h in (h1, h2)]
    cut = cut.withColumn("low", F.least(*at)).withColumn("high", F.greatest(*at))
    each = cut.select("row", "key", "n", "low", "high", F.posexplode("matches").alias("block", "piece"))
    asked = F.lit(False)
    for c in ("low", "high"):
        asked = asked | F.coalesce(F.floor((F.col(c) - 1) / BLOCK) == F.col("block"), F.lit(False))
    outline = F.regexp_replace(F.regexp_replace("piece", "[A-Za-z]", "a"), "[^a]", " ")
    return stored(each.select("row", "key", "n", "low", "high", "block", F.char_length("piece").cast("long").alias("chars"), F.when(asked, outline).alias("piece")), "fim-blocks")


def offsets(held: DataFrame) -> DataFrame:
    """(key, n, low, high): units of each text, and its two cuts in code points. held: as from `blocks`."""
    along = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.select("row", "block", "chars", "piece").withColumn("before", F.coalesce(F.sum("chars").over(along), F.lit(0))).where("piece IS NOT NULL")
    # a cut stands behind the unit of this ordinal; a cut before all units has none
    requests = held.where("block = 0 AND low IS NOT NULL").select("row", F.explode(F.array(F.struct(F.lit("low").alias("cut"), (F.col("low") - 1).alias("ordinal")), F.struct(F.lit("high").alias("cut"), (F.col("high") - 1).alias("ordinal")))).alias("r")).select(F.col("row").alias("of"), "r.cut", "r.ordinal").where("ordinal >= 0")
    # an interval in the condition, so both sides stay dealt by row
    within = (F.col("row") == F.col("of")) & F.col("ordinal").between(F.col("block") * BLOCK, F.col("block") * BLOCK + (BLOCK - 1))
    found = placed.join(requests, within).select("row", "cut", "before", (F.col("ordinal") - F.col("block") * BLOCK).alias("ordinal"), "piece")
    units = found.select("row", "cut", "before", "ordinal", F.posexplode(F.regexp_extract_all("piece", F.lit(UNIT), F.lit(0))).alias("place", "unit")).where("place <= ordinal")
    inside = Window.partitionBy("row", "cut").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select("row", "cut", "before", "ordinal", "place", F.char_length("unit").alias("chars")).withColumn("upto", F.col("before") + F.sum("chars").over(inside)).where("place = ordinal")
    by_row = ends.groupBy("row").agg(*(F.max(F.when(F.col("cut") == c, F.col("upto"))).alias(f"{c}_at") for c in ("low", "high")))
    heads = held.where("block = 0").select("row", "key", "n", F.when(F.col("low").isNotNull(), F.lit(0)).alias("zero"))
    # rows of one key agree in all of it
    return heads.join(by_row, "row", "left").groupBy("key").agg(F.max("n").alias("n"), *(F.max(F.coalesce(f"{c}_at", "zero")).alias(c) for c in ("low", "high")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from, from nothing but the output and its form."""
    def between(first: str, second: str, third: str) -> list[Column]:
        a, b = F.instr(output, second), F.instr(output, third)
        return [F.substring(output, F.lit(len(first) + 1), a - len(first) - 1), F.substring(output, a + len(second), b - a - len(second)), F.substring(output, b + len(third), F.char_length(output))]

    p, s, m = between(PREFIX, SUFFIX, MIDDLE)
    s2, p2, m2 = between(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with `fim`: (n, form, prefix_chars, middle_chars, output); a column of that name is replaced.

    NULL texts are empty and stay plain, as does a text that holds one of the marks; lengths of plain texts are NULL.
    Rows that agree in id and text are cut alike, a NULL id is like an empty one. Without rows there are none. Texts of
    any length are cut: only the blocks of a text share a window. Ids are looked at as text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # the row travels as one value, so no column of it can be taken for one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    cuts = offsets(blocks(rows.select("id", "text")))
    both = rows.select("doc", key_of(F.col("text"), F.col("id")).alias("key")).join(cuts, "key", "left")
    body, ident = F.coalesce(F.col("doc")[text_col], F.lit("")), F.col("doc")[id_col]
    form = form_of(body, ident)
    prefix, middle, suffix = F.substring(body, F.lit(1), F.col("low").cast("int")), F.substring(body, (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), F.substring(body, (F.col("high") + 1).cast("int"), F.char_length(body))
    output = F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(body)
    made = F.struct(F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), F.when(form != "plain", F.col("low")).alias("prefix_chars"), F.when(form != "plain", F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))
    return both.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c != "fim"), made.alias("fim"))


def run(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one per row; NULLs, repeats and long texts as in `transform`."""
    out = transform(docs.select(id_col, text_col), id_col, text_col)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(id_col, "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))
