"""Queries of the subpackage, registered by the entry module where it can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, html_text, jaccard, langid, lexical, media, mixing, periods, pii, quality, sentences, sharding, suffixes
from seqloom.plans.lineage import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), keep=False, passage=suffixes.PASSAGE)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_in_documents(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The contract's texts of op11: where the hash of doc_id ends in 0, the words from some place on repeat the first of them."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.floor(digest / 10).alias("g"), (digest % 10 == 0).alias("rewritten"))
    own = own.withColumn("words", F.when(F.col("rewritten"), F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")))
    own = own.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    many = F.flatten(F.array_repeat(tail, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(many, F.lit(1), (F.col("n") - F.col("a")).cast("int"))), " ")
    return own.select("doc_id", F.when(F.col("rewritten") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(with_periodic_tails(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    out = found.select("doc_id", "runs", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LEXICAL_SQL = r"""
WITH words AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
counts AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
corpus AS (SELECT count(*) AS number, CAST(sum(n) AS BIGINT) AS total FROM sizes),
frequent AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS qid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
weighed AS (SELECT qid, item_id, term, times * CAST(floor(1000 * ln((2 * number + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN frequent USING (term), corpus),
impacts AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * number) // total)) AS p FROM counts JOIN sizes USING (rid), corpus),
scores AS (SELECT qid, item_id, rid, doc_id, CAST(sum(w * p) AS BIGINT) AS score FROM weighed JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

QUERIES = {f.__name__: f for f in (op1_suffixes, op2_html, op3_mixing, op4_sentences, op5_pii, op6_jaccard, op7_langid, op8_media, op9_decontamination, op10_sharding, op11_periods, op12_quality, op13_lexical)}
ORACLES: dict[str, str] = {"op13_lexical": LEXICAL_SQL}
