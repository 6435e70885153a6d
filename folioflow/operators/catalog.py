"""Filter catalogue, resolver, job states and stream comparison as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Filter id, format, extensions, source mode, priority.
FILTERS = [
    ("native.txt", "txt", ["txt"], "path", 100),
    ("native.markdown", "markdown", ["md", "markdown"], "text", 100),
    ("native.html", "html", ["html", "htm", "xhtml"], "text", 100),
    ("native.json", "json", ["json"], "text", 100),
    ("native.yaml", "yaml", ["yaml", "yml"], "text", 100),
    ("native.xliff", "xliff", ["xlf", "xliff"], "text", 100),
    ("native.xliff2", "xliff2", ["xlf", "xliff"], "text", 100),
    ("native.epub", "epub", ["epub"], "path", 100),
    ("native.docx", "docx", ["docx"], "path", 100),
]
SNIFF_CHARS = 65_536


def catalog(spark: SparkSession) -> DataFrame:
    """Nine rows, so always small enough to broadcast."""
    rows = [(i, *f) for i, f in enumerate(FILTERS)]
    return spark.createDataFrame(rows, "position int, filter_id string, format string, extensions array<string>, source_mode string, priority int")


def resolve(requests: DataFrame) -> DataFrame:
    """filter_id of each (doc_id, path, format, filter_id, head): given id, then format, then content, then extension.

    The catalogue is literal maps, so requests are neither joined nor shuffled.

    head: the start of the document, for the name space that tells XLIFF 1.2 and 2.0 apart. Ties go to the
    higher priority, then to the earlier entry; null if nothing fits.
    """
    by_rank = sorted(enumerate(FILTERS), key=lambda f: (-f[1][4], f[0]))
    first: dict[str, dict[str, str]] = {"id": {}, "format": {}, "ext": {}, "sniffed": {}}
    for _, (filter_id, fmt, extensions, _, _) in by_rank:
        first["id"].setdefault(filter_id, filter_id)
        first["format"].setdefault(fmt, filter_id)
        for x in extensions:
            first["ext"].setdefault(x, filter_id)
            first["sniffed"].setdefault(f"{x} {fmt}", filter_id)
    of = lambda kind, key: F.element_at(F.create_map(*[F.lit(x) for kv in first[kind].items() for x in kv]), key)
    space = F.regexp_extract(F.substring(F.coalesce("head", F.lit("")), 1, SNIFF_CHARS), r"xmlns\s*=\s*[\"']([^\"']+)", 1)
    sniffed = F.when(space == "urn:oasis:names:tc:xliff:document:2.0", "xliff2").when(space == "urn:oasis:names:tc:xliff:document:1.2", "xliff")
    ext = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([^./]+)$", 1))
    found = F.coalesce(of("id", F.col("filter_id")), of("format", F.col("format")), of("sniffed", F.concat_ws(" ", ext, sniffed)), of("ext", ext))
    return requests.select("doc_id", found.alias("resolved_filter"))


#: The states after which a new job may begin.
TERMINAL = ["completed", "canceled", "failed", "timeout", "executor_crashed"]
#: All states of a job, in their order.
STATES = ["created", "resolving", "probing", "opening", "extracting", "extracted", "translating", "applying", "reconstructing", "validating", *TERMINAL]


def jobs_latest(states: DataFrame, keys: list[str], state: str, at: str) -> DataFrame:
    """The last state of each job and whether it is terminal."""
    return states.groupBy(*keys).agg(F.max_by(state, at).alias("state")).withColumn("is_terminal", F.col("state").isin(TERMINAL))


def jobs(log: DataFrame, keys: list[str], state: str, at: str) -> DataFrame:
    """Jobs of each document and operation from a log of requests (state created) and states: keys, job, since, state, is_terminal.

    There is one active job at a time: a request while one runs is that job, after a terminal state it is a new one.
    """
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col(state).isin(TERMINAL).cast("int")).over(before), F.lit(0))
    return log.withColumn("job", ended).groupBy(*keys, "job").agg(F.min(at).alias("since"), F.max_by(state, at).alias("state")).withColumn("is_terminal", F.col("state").isin(TERMINAL))


def compare_streams(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions where two streams differ; what only one side has counts too."""
    l, r = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    return l.join(r, keys, "full").filter("NOT (left_value <=> right_value AND _l <=> _r)").drop("_l", "_r")


def resolve_chain(styles: DataFrame) -> DataFrame:
    """style_id, root_id, depth along based_on of the same type; a cycle raises an error."""
    styles.createOrReplaceTempView("_styles")
    return styles.sparkSession.sql(
        """
        WITH RECURSIVE up AS (
          SELECT style_id, style_id AS at, type, based_on, 0 AS depth, array(style_id) AS seen FROM _styles
          UNION ALL
          SELECT u.style_id, s.style_id, s.type, s.based_on, u.depth + 1, array_append(u.seen, s.style_id)
          FROM up u JOIN _styles s ON u.based_on = s.style_id AND u.type = s.type
          WHERE IF(array_contains(u.seen, s.style_id), CAST(raise_error('style cycle') AS BOOLEAN), true))
        SELECT style_id, max_by(at, depth) AS root_id, CAST(max(depth) AS INT) AS depth FROM up GROUP BY style_id
        """
    )


def coverage(features: DataFrame, supported: list[str]) -> DataFrame:
    """supported, total, ratio and the sorted gap of each filter's features."""
    known = F.array(*[F.lit(s) for s in supported])
    total, held = F.size("features"), F.size(F.array_intersect("features", known))
    return features.select(
        "filter_id", held.alias("supported"), total.alias("total"),
        F.when(total > 0, held / total).otherwise(F.lit(0.0)).alias("ratio"),
        F.array_join(F.array_sort(F.array_except("features", known)), ",").alias("gap"),
    )


def decode_ipc(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes of JSON lines and whether each is valid: version 1 with a type and an id."""
    env = F.from_json(column, "version int, type string, id string, payload string")
    return lines.select(env.alias("m")).select("m.*", ((F.col("m.version") == 1) & F.col("m.type").isNotNull() & F.col("m.id").isNotNull()).alias("is_valid"))


def encode_ipc(kind, message_id, payload=None):
    """The JSON line of an envelope; a payload that is null is left out."""
    return F.to_json(F.struct(F.lit(1).alias("version"), kind.alias("type"), message_id.alias("id"), *([payload.alias("payload")] if payload is not None else [])))


def resolve_looks(styles: DataFrame) -> DataFrame:
    """style_id, look: the properties (map run) of each style laid over those that it is based on, its own last."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    styles.createOrReplaceTempView("_looks")
    way = styles.sparkSession.sql(
        """
        WITH RECURSIVE up AS (
          SELECT style_id, type, based_on, run, 0 AS depth, array(style_id) AS seen FROM _looks
          UNION ALL
          SELECT u.style_id, s.type, s.based_on, s.run, u.depth + 1, array_append(u.seen, s.style_id)
          FROM up u JOIN _looks s ON u.based_on = s.style_id AND u.type = s.type
          WHERE IF(array_contains(u.seen, s.style_id), CAST(raise_error('style cycle') AS BOOLEAN), true))
        SELECT style_id, array_sort(collect_list(struct(-depth AS place, to_json(run) AS run))) AS way FROM up GROUP BY style_id
        """
    )
    laid = F.aggregate("way", empty, lambda m, s: F.map_zip_with(m, F.from_json(s.run, "map<string,string>"), lambda k, a, b: F.coalesce(b, a)))
    return way.select("style_id", laid.alias("look"))
