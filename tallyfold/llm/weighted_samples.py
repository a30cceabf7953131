"""Consistent weighted sampling: document fingerprints whose collision rate equals generalised Jaccard similarity.

A text is a set of words weighted by how often they occur. For each of ``SAMPLES`` samples a word has r and c from Gamma(2, 1)
and b uniform, all drawn from one hash of the word; with weight S it takes the level t = floor(ln S / r + b) and the value
ln a = ln c - r (t - b + 1). The word and level of the least value are the sample, and two texts have the same one with
the probability sum(min weights) / sum(max weights). A value determines its word and level, so the fingerprint keeps 16
bits of the hash of each least value.

Everything is a native expression: words are hashed, sorted and counted inside their row, and the samples are ``min`` aggregates
over exploded words, so each text is reduced to its samples in the task that reads it and only those are shuffled. Draws from
Gamma(2, 1) come from a table of its quantiles, which is made by bisection once in a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyfold.llm.common import staged
from tallyfold.operators.scan import SLICE, add_slice

SAMPLES = 64
DIGITS = 4  # hexadecimal digits of a sample
R_BITS, C_BITS, B_BITS = 12, 14, 38  # of a word's hash, for its draws of r, c and b
SALT = 0x9E3779B97F4A7C15  # times the sample's number, mixed into the word's hash
WORD_ENDS = r"[\x20\x09-\x0D]+"
LEAST_ID = -(1 << 63)


# --- draws ---


def gamma_quantiles(spark: SparkSession, bits: int) -> DataFrame:
    """One row with ``q``, the 2 ** bits midpoint quantiles of Gamma(2, 1) in order, whose distribution is 1 - (1 + x) exp(-x)."""
    n = 1 << bits
    halves = "aggregate(sequence(1, 60), named_struct('lo', 0D, 'hi', 64D), (s, i) -> IF(1 - (1 + (s.lo + s.hi) / 2) * exp(-(s.lo + s.hi) / 2) < p, named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2)), s -> (s.lo + s.hi) / 2)"
    each = spark.range(n).selectExpr("id", f"(id + 0.5D) / {n} AS p").selectExpr("id", f"{halves} AS x")
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda e: e["x"]).alias("q"))


def draw_tables(spark: SparkSession, roles: int) -> DataFrame:
    """(role, r_of, log_c_of): the quantiles of r and of ln c, once for every role; a few hundred kilobytes."""
    both = gamma_quantiles(spark, R_BITS).select(F.lit(1).alias("one"), F.col("q").alias("r_of")).join(
        gamma_quantiles(spark, C_BITS).select(F.lit(1).alias("one"), F.transform("q", lambda x: F.ln(x)).alias("log_c_of")), "one"
    )
    return both.select(F.explode(F.sequence(F.lit(0), F.lit(roles - 1))).alias("role"), "r_of", "log_c_of")


def _draw(word: Column, log_weight: Column, k: int) -> Column:
    """ln a of one word for sample k, from the tables beside it."""
    salt = k * SALT % (1 << 64)
    h = F.xxhash64(word.bitwiseXOR(F.lit(salt - (1 << 64) if salt >> 63 else salt)))
    r = F.get("r_of", h.bitwiseAND((1 << R_BITS) - 1).cast("int"))
    log_c = F.get("log_c_of", F.shiftrightunsigned(h, R_BITS).bitwiseAND((1 << C_BITS) - 1).cast("int"))
    b = F.shiftrightunsigned(h, R_BITS + C_BITS) * F.lit(2.0**-B_BITS)
    return F.when(log_weight == 0, log_c - r * (1 - b)).otherwise(log_c - r * (F.floor(log_weight / r + b) - b + 1))  # a weight of 1 has level 0


# --- weighted words ---


def _sorted_hashes(text: Column) -> Column:
    return F.sort_array(F.transform(F.filter(F.split(F.lower(text), WORD_ENDS), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _run_starts(hashes: str) -> Column:
    """Where each run of equal numbers begins in a sorted array."""
    return F.expr(f"IF(size({hashes}) = 0, CAST(array() AS array<int>), filter(sequence(0, size({hashes}) - 1), i -> i = 0 OR {hashes}[i] <> {hashes}[greatest(i - 1, 0)]))")


def _weighted(hashes: str, starts: str, role: int) -> Column:
    """(role, word hash, ln of its occurrences) of every different word."""
    return F.expr(f"transform({starts}, (s, i) -> struct({role} AS role, {hashes}[s] AS word, ln(CAST(coalesce(get({starts}, i + 1), size({hashes})) - s AS double)) AS log_weight))")


# --- the next document ---


def with_next(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Every row with ``next_<column>`` of the row behind it in ascending order; behind the last comes the first.

    ``order`` starts with two long columns without nulls, by which the rows are cut into ordered slices: a task gets one slice
    and, as a last row, the first row of the slice behind it. What all those rows are is found on the order columns alone.
    """
    first, second, *_ = order
    cut = add_slice(df, F.col(first), tie=F.col(second))
    heads = cut.groupBy(SLICE).agg(F.min(F.struct(*order)).alias("_head"))  # a row for each slice
    slices = heads.select(SLICE, "_head", F.coalesce(F.lag(SLICE).over(Window.orderBy(SLICE)), F.max(SLICE).over(Window.partitionBy())).alias("_to"))
    at_head = F.col("_at") == F.col(SLICE)
    for c in order:
        at_head = at_head & F.col(c).eqNullSafe(F.col(f"_head.{c}"))
    ghosts = cut.join(F.broadcast(slices.withColumnRenamed(SLICE, "_at")), at_head).groupBy("_to", *order).agg(*[F.first(c).alias(c) for c in columns if c not in order])
    names = df.columns
    ghosts = ghosts.select(F.col("_to").alias(SLICE), F.lit(1).alias("_ghost"), *[F.col(c) if c in (*order, *columns) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names])
    both = cut.select(SLICE, F.lit(0).alias("_ghost"), *names).unionByName(ghosts)
    w = Window.partitionBy(SLICE).orderBy("_ghost", *order)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("_ghost = 0").drop("_ghost", SLICE)


# --- fingerprints ---


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints, from 0 to 1."""
    at = lambda x, k: F.substring(x, k * DIGITS + 1, DIGITS)
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: at(a, k) == at(b, k))) / F.lit(float(samples))


def fingerprints(docs: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, n, fingerprint_<text> for each of ``texts``) of the different keys, which must tell their texts apart.

    ``n`` is how many rows have those keys. A text without words has the fingerprint of zeros.
    """
    spark = docs.sparkSession
    at = docs.select(*keys, *[_sorted_hashes(F.col(t)).alias(f"_h{i}") for i, t in enumerate(texts)])
    at = at.select("*", *[_run_starts(f"_h{i}").alias(f"_s{i}") for i in range(len(texts))])
    row = F.expr(f"array(struct({len(texts)} AS role, CAST(NULL AS bigint) AS word, CAST(NULL AS double) AS log_weight))")  # one for the row itself
    words = F.concat(*[_weighted(f"_h{i}", f"_s{i}", i) for i in range(len(texts))], row)
    tables = staged(draw_tables(spark, len(texts) + 1), "gamma-quantiles")
    each = at.select(*keys, F.inline(words)).join(F.broadcast(tables), "role")  # of constant size
    least = [F.min(_draw(F.col("word"), F.col("log_weight"), k)).alias(f"_m{k}") for k in range(samples)]
    found = each.groupBy(*keys, "role").agg(F.count("*").alias("n"), *least)  # under 100 columns, beyond which Spark compiles no code

    def digits(m: Column) -> Column:
        return F.when(m.isNull(), "0" * DIGITS).otherwise(F.right(F.hex(F.xxhash64(m)), F.lit(DIGITS)))

    of_role = found.select(*keys, "role", "n", F.unhex(F.concat(*[digits(F.col(f"_m{k}")) for k in range(samples)])).alias("fingerprint"))
    out = [F.max(F.when(F.col("role") == i, F.col("fingerprint"))).alias(f"fingerprint_{t}") for i, t in enumerate(texts)]
    whole = of_role.groupBy(*keys).agg(F.max(F.when(F.col("role") == len(texts), F.col("n"))).alias("n"), *out)
    return whole.select(*keys, "n", *[F.coalesce(F.lower(F.hex(f"fingerprint_{t}")), F.lit("0" * DIGITS * samples)).alias(f"fingerprint_{t}") for t in texts])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last half of code points replaced by as many first ones of the next document (or all
    of a shorter one); near_edited and near_next are the likeness of the text to the edited text and to the next one. Documents
    are ordered by id, then by hashes of the text; null ids come first, and the first follows the last (a single row follows itself).
    A null text is empty; texts without words have likeness 1 to each other. Rows that repeat stay, each with
    its own next row; an empty table gives no rows; other columns are not read. Texts that differ are told apart by 128 bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"), text.alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "tie2": F.xxhash64(F.reverse("text"))})
    pairs = with_next(rows, ["key", "tie", "tie2"], ["key", "tie", "tie2", "text"])
    half = F.expr("CAST(n_chars div 2 AS int)")
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    is_last = ~(F.col("key").eqNullSafe(F.col("next_key")) & (F.col("tie") == F.col("next_tie")) & (F.col("tie2") == F.col("next_tie2")))  # of equal rows
    pairs = pairs.select("doc_id", "key", "tie", "tie2", is_last.alias("is_last"), "n_chars", "text", edited.alias("edited"))
    keys = ["doc_id", "key", "tie", "tie2", "is_last", "n_chars", "edited_sha256"]
    found = fingerprints(pairs.withColumn("edited_sha256", F.unhex(F.sha2(F.col("edited").cast("binary"), 256))), keys, ["text", "edited"])
    every = staged(found.select("*", F.explode(F.expr("sequence(1L, n)"))).drop("n", "col"), "weighted-samples", "zstd")  # rows that repeat, one by one
    out = with_next(every, ["key", "tie", "tie2", "is_last"], ["fingerprint_text"])
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.col("fingerprint_text").alias("fingerprint"), F.col("fingerprint_edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint_text"), F.col("fingerprint_edited")).alias("near_edited"), likeness(F.col("fingerprint_text"), F.col("next_fingerprint_text")).alias("near_next"),
    )
