"""Query of the run detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from variascope.llm import periods
from variascope.llm.io import table

#: Words of ``text``; a leading separator gives no empty word.
WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def planted(docs):
    """Documents in which a tenth of the ids, by checksum, repeat themselves from some word on."""
    named = docs.withColumn("_h", F.expr("crc32(cast(doc_id as string))"))
    words = named.withColumn("_words", F.expr(f"CASE WHEN _h % 10 = 0 THEN {WORDS} END")).withColumns({"_n": F.size("_words"), "_g": F.expr("_h div 10")})
    placed = words.withColumn("_a", F.expr("CASE WHEN _n > 0 THEN _g % _n END")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = "array_join(transform(sequence(0, _n - 1), i -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')"
    return placed.select("doc_id", F.expr(f"CASE WHEN _h % 10 = 0 AND _n > 0 THEN {text} ELSE text END").alias("text"))


def op11_runs(spark, sf_dir):
    """Runs of repeated words in every document."""
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.find(docs).select("doc_id", "runs", "collapsed")
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs": op11_runs}
SQL = {}
