"""Queries of the corpus operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import language, mixture, quantiles, tokens
from loglattice.operators import instants, late
from loglattice.plans.tables import Query, reader
from loglattice.session import materialise

DAY_US = 24 * late.HOUR_US
AT = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


#: The rank error the percentiles may have, as a part of the number of values above.
ERROR = 0.05


def _values(t, days: bool) -> DataFrame:
    """(key, value[, day]): duration and bytes of each access, by (metric and path) and UTC day of the access; no day where the time cannot be fixed."""
    rows = t("access_log").select("event_id", "access_ts", "url_path", "duration", "bytes")
    if days:
        lines = t("line_events").select(F.col("event_id").alias("e_id"), "host_name")
        rows = instants.with_host_zone(rows.join(lines, F.col("event_id") == F.col("e_id"), "left"), t("log_hosts"), "host_name", "zone")
        rows = instants.with_instant(rows, "access_ts", "zone", "event_us")
        rows = rows.withColumn("day", late.period_of(F.when(F.col("event_us") != instants.UNFIXABLE, F.col("event_us")), DAY_US))
    both = F.explode(F.array(F.struct(F.lit("duration").alias("metric"), F.col("duration").alias("value")), F.struct(F.lit("bytes").alias("metric"), F.col("bytes").cast("double").alias("value"))))
    day = ["day"] if days else []
    rows = rows.select("url_path", *day, both.alias("v"))
    return rows.select(F.concat("v.metric", F.lit(" "), F.coalesce("url_path", F.lit(""))).alias("key"), *day, F.col("v.value").alias("value"))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.daily_sketches(_values(reader(spark, folder), True), "key", "day", "value", quantiles.section_size(ERROR))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"metric": F.split("grp", " ", 2)[0], "url_path": F.split("grp", " ", 2)[1]}).drop("grp")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of duration and bytes by path, from the days' sketches put together."""
    return _named(quantiles.percentiles(quantiles.combined(_daily(spark, folder)), AT)).select("url_path", "metric", "n", *AT)


def p4_days(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of duration and bytes by path and day; day -1 for rows whose time cannot be fixed."""
    return _named(quantiles.percentiles(_daily(spark, folder), AT, ("grp", "day"))).select("url_path", "metric", "day", "n", *AT)


def p4_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the percentiles put together from days hold their error bound, against the exact ranks of all values."""
    estimates = materialise(quantiles.percentiles(quantiles.combined(_daily(spark, folder)), AT), "estimates")
    checked = quantiles.within_bound(_values(reader(spark, folder), False), estimates, "key", "value", AT, ERROR)
    return _named(checked.withColumnRenamed("key", "grp")).select("url_path", "metric", "n", "within")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(reader(spark, folder)("documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The checksum of what each document's ids decode to."""
    return tokens.decoded(p8_ids(spark, folder)).select("doc_id", F.sha2("data", 256).alias("text_sha"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, mixture.Plan]:
    t = reader(spark, folder)
    docs = t("documents").where(F.col("source").isNotNull())
    sized = tokens.token_counts(docs.select("doc_id", "text", "source"), keep="source")
    copies, plan = mixture.mixed(sized.withColumnRenamed("n_tokens", "size"), t("mix_targets"))
    return copies, t("mix_targets"), plan


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    copies, _, _ = _mixed(spark, folder)
    return copies.where(F.col("copies") > 0).select("doc_id", F.col("source").alias("source_name"), F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source reached."""
    return mixture.shares(*_mixed(spark, folder)[:2])


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source comes within one of its documents of the tokens it is to give, and keeps to its repeats."""
    copies, targets, plan = _mixed(spark, folder)
    got = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("tokens"), F.max("size").alias("largest"), F.max("copies").alias("most"))
    wanted = spark.createDataFrame(list(plan.wanted.items()), "source string, wanted double")
    both = targets.join(got, F.col("source_name") == got["source"], "left").drop("source").join(wanted, F.col("source_name") == wanted["source"], "left")
    nothing = F.col("tokens").isNull() & F.col("wanted").isNull()
    close = nothing | (F.abs(F.col("tokens") - F.col("wanted")) <= F.col("largest"))
    return both.select("source_name", F.coalesce(close, F.lit(False)).alias("within_document"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    docs = reader(spark, folder)("documents")
    return language.with_segments(docs, language.fit(docs))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.label_cases(_segmented(spark, folder))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each span of one language in each mail, with its confidence."""
    rows = _segmented(spark, folder).select("doc_id", F.explode("segments").alias("s"))
    return rows.select("doc_id", F.col("s.lang").alias("lang"), F.col("s.start").alias("first_word"), F.col("s.n_words").alias("n_words"), F.col("s.confidence").alias("confidence"))


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each mail, with their shares of its words and a confidence."""
    return language.languages(_segmented(spark, folder)).select("doc_id", "lang", "share", "confidence")


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The language that each document's label names."""
    return reader(spark, folder)("documents").select("doc_id", language.named_language(F.col("lang")).alias("code"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_percentiles, p4_days, p4_bounds, p8_ids, p8_decoded, p9_mixture, p9_shares, p9_limits, p10_found, p10_segments, p10_languages, p10_labels)}

_BASE = r"case when regexp_full_match(l, '[a-z]{2,3}[-_][a-z0-9]{2,4}') then regexp_extract(l, '^([a-z]+)', 1) else l end"
_CODES = " ".join(f"when b in ({', '.join(repr(n) for n in names)}) then '{code}'" for code, names in language.NAMES.items())
#: Only what SQL can express: whole tables against exact ranks, round trips and guaranteed limits.
ORACLES: dict[str, str] = {
    "p4_bounds": "select coalesce(url_path, '') url_path, metric, count(*) n, true \"within\" from (select url_path, 'duration' metric, duration v from access_log union all select url_path, 'bytes', cast(bytes as double) from access_log) where v is not null and not isnan(v) group by 1, 2",
    "p8_decoded": "select doc_id, sha256(coalesce(text, '')) text_sha from documents",
    "p9_limits": "select source_name, true within_document, true within_repeats from mix_targets",
    "p10_labels": f"select doc_id, case {_CODES} end code from (select doc_id, {_BASE} b from (select doc_id, lower(trim(lang, ' ')) l from documents))",
}
