"""Fill-in-middle transformation: texts are cut into prefix, middle and suffix and written in another order.

DataFrame functions only. Each row is transformed by itself: no shuffle, no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle. No mark begins with what another ends with.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Of a hundred texts so many are transformed, and of a hundred of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1


def units(text: Column) -> Column:
    """The units of a text from left to right; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(key: Column, seed: int = SEED) -> Column:
    """array<long> of four draws: the first four 8-digit groups of the SHA-256 of `seed:key`, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, text, n, form, prefix_chars, middle_chars, output) of every row of docs.

    Of n units the prefix ends after the smaller of two draws from 0 to n, the middle
    after the larger. form is psm (prefix, suffix, middle), spm (suffix, prefix, middle),
    or plain, where the output is the text: empty texts, texts that hold a mark
    themselves, and a share of the others by a third draw. Lengths are in code points,
    null for plain ones.

    A null text is an empty one; a null key draws as an empty one. Rows that repeat a key
    draw alike. No rows give no rows. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", draws(F.col(key), seed)).withColumn("_u", units(F.col("text"))).withColumn("n", F.size("_u").cast("long"))
    cuts = [F.col("_h")[k] % (F.col("n") + 1) for k in (0, 1)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (F.col("_h")[2] % 100 >= TRANSFORMED), "plain").when(F.col("_h")[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumn("_a", F.least(*cuts).cast("int")).withColumn("_b", F.greatest(*cuts).cast("int"))
    part = lambda start, length: F.array_join(F.slice("_u", start + 1, length), "")
    changed = F.col("form") != "plain"
    rows = rows.withColumn("_prefix", F.when(changed, part(F.lit(0), F.col("_a"))))
    rows = rows.withColumn("_middle", F.when(changed, part(F.col("_a"), F.col("_b") - F.col("_a"))))
    rows = rows.withColumn("_suffix", F.when(changed, part(F.col("_b"), F.size("_u") - F.col("_b"))))
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select(key, "text", "n", "form", F.char_length("_prefix").cast("long").alias("prefix_chars"), F.char_length("_middle").cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone.

    A transformed text holds no mark of its own, and none can arise where parts meet, so
    each mark of the output stands once.
    """
    between = lambda after, before: F.split_part(F.split_part(output, F.lit(before), F.lit(1)), F.lit(after), F.lit(2))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of what fill_in_middle() gives."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
