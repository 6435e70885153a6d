"""Queries of descriptions, sources, jobs and reports, on rows built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import analysis, catalog
from ..operators import units as ops
from ..sources.reader import parse
from .queries import query, read, turns, txt_events, xliff_docs


def states(spark, sf_dir):
    names = F.array(*map(F.lit, catalog.STATES))
    return read(spark, sf_dir, "events").withColumn("state", F.element_at(names, (F.col("event_id") % len(catalog.STATES) + 1).cast("int")))


STATE_SQL = "['created','resolving','probing','opening','extracting','extracted','translating','applying','reconstructing','validating','completed','canceled','failed','timeout','executor_crashed'][(event_id % 15 + 1)::INT]"
ENDED_SQL = "('completed','canceled','failed','timeout','executor_crashed')"


@query(f"WITH s AS (SELECT *, {STATE_SQL} AS state FROM events) SELECT user_id, arg_max(state, event_id) AS state, arg_max(state, event_id) IN {ENDED_SQL} AS is_terminal FROM s GROUP BY user_id")
def job_latest(spark, sf_dir):
    return catalog.jobs_latest(states(spark, sf_dir), ["user_id"], "state", "event_id")


@query(
    f"""WITH s AS (SELECT *, {STATE_SQL} AS state FROM events),
    j AS (SELECT *, coalesce(sum((state IN {ENDED_SQL})::INT) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS job FROM s)
    SELECT user_id, event_type, job, min(event_id) AS since, arg_max(state, event_id) AS state, arg_max(state, event_id) IN {ENDED_SQL} AS is_terminal FROM j GROUP BY user_id, event_type, job"""
)
def job_dedupe(spark, sf_dir):
    """Requests for a document and operation that has an active job are that job."""
    return catalog.jobs(states(spark, sf_dir), ["user_id", "event_type"], "state", "event_id")


@query("SELECT doc_id, true AS balanced FROM documents")
def event_balance(spark, sf_dir):
    return ops.balanced(txt_events(spark, sf_dir))


@query(
    """WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 5 <> 4),
    r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn % 7 <> 6),
    d AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, l.text AS a, r.text AS b FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn WHERE l.text IS DISTINCT FROM r.text)
    SELECT conv_id, string_agg(turn || ': ' || coalesce(a, '<missing>') || ' -> ' || coalesce(b, '<missing>'), chr(10) ORDER BY turn) AS report, count(*) AS differences FROM d GROUP BY conv_id"""
)
def diff_report(spark, sf_dir):
    from .queries import diff_streams

    return analysis.difference_report(diff_streams(spark, sf_dir), "conv_id", "turn")


@query(
    """WITH a AS (SELECT conv_id, list(DISTINCT role) AS x FROM conversations WHERE turn % 4 <> 3 GROUP BY 1), b AS (SELECT conv_id, list(DISTINCT role) AS y FROM conversations WHERE turn % 3 <> 1 GROUP BY 1),
    j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b ON a.conv_id = b.conv_id),
    t AS (SELECT conv_id, array_to_string(list_sort(list_filter(x, lambda i: NOT list_contains(y, i))), ',') AS missing, array_to_string(list_sort(list_filter(y, lambda i: NOT list_contains(x, i))), ',') AS extra, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS every FROM j)
    SELECT *, missing = '' AND extra = '' AS same FROM t"""
)
def id_sets(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return analysis.same_ids(c.filter("turn % 4 <> 3"), c.filter("turn % 3 <> 1"), "conv_id", "role")


def descriptions(spark, sf_dir):
    """A filter description for each part; some break a rule."""
    p = read(spark, sf_dir, "part")
    words = F.array_distinct(F.split("p_type", " "))
    rules = F.array(
        F.struct(F.lit("size").alias("name"), F.when(F.col("p_partkey") % 7 == 0, "money").otherwise("integer").alias("value_type"), F.col("p_size").cast("string").alias("default")),
        F.struct(F.when(F.col("p_partkey") % 11 == 0, "size").otherwise("brand").alias("name"), F.lit("string").alias("value_type"), F.col("p_brand").alias("default")),
    )
    tokens = F.transform(words, lambda w: F.struct(w.alias("token_type"), F.lit("x").alias("code_type"), F.when(w == "TIN", "odd").otherwise("paired").alias("tag_strategy"), F.lit(True).alias("translatable")))
    ir = F.struct(F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.lit("1").alias("version"), F.array(F.lit("text/b"), F.lit("text/a")).alias("mime_types"),
                  F.array(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(".x"), F.lit(".a")).alias("extensions"), words.alias("features"), F.array(F.lit("size"), F.lit("brand")).alias("parameters"), rules.alias("parameter_rules"), tokens.alias("token_rules"))
    return analysis.read_ir(p.select("p_partkey", F.to_json(ir).alias("value")))


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 13 = 0 THEN 'name' END, CASE WHEN p_partkey % 5 = 0 THEN 'extension_dot' END, CASE WHEN p_partkey % 11 = 0 THEN 'parameter_twice' END,
    CASE WHEN p_partkey % 7 = 0 THEN 'parameter_type' END, CASE WHEN list_contains(string_split(p_type, ' '), 'TIN') THEN 'token_strategy' END], lambda x: x IS NOT NULL), ',') AS faults FROM part"""
)
def ir_faults(spark, sf_dir):
    return analysis.ir_faults(descriptions(spark, sf_dir)).select("p_partkey", F.array_join("faults", ",").alias("faults"))


@query(
    """SELECT p_partkey, 'text/a,text/b' AS mime_types, array_to_string(list_sort([CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '.x' END, '.a']), ',') AS extensions,
    array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS features, CASE WHEN p_partkey % 11 = 0 THEN 'size,size' ELSE 'brand,size' END AS rules,
    array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS tokens FROM part"""
)
def ir_normal_form(spark, sf_dir):
    n = analysis.normalised_ir(descriptions(spark, sf_dir))
    names = lambda c, f: F.array_join(F.transform(c, lambda r: r[f]), ",")
    return n.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in ("mime_types", "extensions", "features")], names("parameter_rules", "name").alias("rules"), names("token_rules", "token_type").alias("tokens"))


def java_sources(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    up = F.when(F.col("n_nationkey") >= 5, F.concat(F.lit(" extends N"), (F.col("n_nationkey") - 5).cast("string"))).otherwise("")
    body = F.concat(
        F.lit("class N"), "n_nationkey", up, F.lit(" {\n int maxSize = 2 * "), "n_nationkey", F.lit(" * 3;\n boolean useCodes = true;\n String title = \""), "n_name", F.lit('";\n'),
        F.when(F.col("n_nationkey") % 2 == 0, " void f() { p.getMaxSize(); p.isUseCodes(); new InlineCodeFinder(); }\n").otherwise(" void f() { p.getTitle(); new GenericSkeleton(); }\n"),
        F.lit(" String m() { return MimeTypeMapper."), F.when(F.col("n_regionkey") % 2 == 0, "XML").otherwise("JSON"), F.lit("_MIME_TYPE; }\n}\n"),
    )
    return n.select("n_nationkey", body.alias("source_text"))


@query(
    """SELECT n_nationkey, 'N' || n_nationkey AS class_name, CASE WHEN n_nationkey >= 5 THEN 'N' || (n_nationkey - 5) END AS super_name, CASE WHEN n_regionkey % 2 = 0 THEN 'xml' ELSE 'json' END AS mime,
    CASE WHEN n_nationkey % 2 = 0 THEN 'code_finder' ELSE 'skeleton' END AS features, 'maxSize:integer=' || (6 * n_nationkey) || ',useCodes:boolean=true,title:string=' || n_name AS parameters,
    CASE WHEN n_nationkey % 2 = 0 THEN 'maxSize,useCodes' ELSE 'title' END AS used FROM nation"""
)
def java_facts(spark, sf_dir):
    f = analysis.java_facts(java_sources(spark, sf_dir))
    said = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["value_type"], F.lit("="), p["default"])), ",")
    return f.select("n_nationkey", "class_name", "super_name", "mime", F.array_join("features", ",").alias("features"), said.alias("parameters"), F.array_join("used", ",").alias("used"))


@query("SELECT 'N' || n_nationkey AS style_id, 'N' || (n_nationkey % 5) AS root_id, (n_nationkey // 5)::INT AS depth FROM nation")
def java_superclasses(spark, sf_dir):
    f = analysis.java_facts(java_sources(spark, sf_dir))
    return catalog.resolve_chain(f.select(F.col("class_name").alias("style_id"), F.lit("class").alias("type"), F.col("super_name").alias("based_on")))


@query("SELECT n_name AS name, 'lib-' || n_regionkey AS artifact, n_regionkey % 2 = 0 AS supplied, CASE WHEN n_nationkey % 3 = 0 THEN 'runtime-' || n_name || '-1.jar' END AS archive FROM nation")
def filter_dependencies(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    value = F.to_json(F.struct(F.col("n_name").alias("name"), F.lit("E").alias("entry_class"), F.array(F.struct(F.concat(F.lit("lib-"), F.col("n_regionkey").cast("string")).alias("artifact"))).alias("dependencies")))
    meta = analysis.filter_metadata(n.select(value.alias("value"))).filter("is_complete")
    libs = n.filter("n_regionkey % 2 = 0").select(F.concat(F.lit("lib-"), F.col("n_regionkey").cast("string"), F.lit(".jar")).alias("archive"))
    runs = n.filter("n_nationkey % 3 = 0").select(F.explode(F.array(*[F.concat(F.lit("runtime-"), "n_name", F.lit(f"-{v}.jar")) for v in (2, 1)])).alias("archive"))
    return analysis.dependencies(meta, libs).join(analysis.runtime_archive(meta, runs), "name")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'known' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'n' ELSE 'base' END AS tags FROM nation")
def evidence_overlay(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    base = n.select(F.col("n_nationkey").alias("id"), F.lit("known").alias("name"), F.array(F.lit("base")).alias("tags"))
    said = n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return analysis.overlaid_evidence(base, said, "id", ["name", "tags"]).withColumn("tags", F.array_join("tags", ","))


@query("SELECT conv_id || '-' || turn AS doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '<ph id=\"1\"/>' AS inner_xml FROM conversations")
def xliff_inner_xml(spark, sf_dir):
    return ops.units(parse(xliff_docs(spark, sf_dir), "xliff")).select("doc_id", codes.xml_of("parts").alias("inner_xml"))


@query("SELECT conv_id || '-' || turn AS doc_id, lower(role) || '_name' AS snake, 'p' AS local, role <> 'user' AS is_on, CASE WHEN turn % 2 = 0 THEN 'a=2,b=1,c=3' ELSE 'a=1,b=1' END AS props FROM conversations")
def scalar_names(spark, sf_dir):
    t = turns(spark, sf_dir)
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3")))
    props = F.array_join(F.array_sort(F.transform(F.map_entries(codes.overlaid(base, over)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return t.select("doc_id", codes.snake_case(F.concat("role", F.lit("Name"))).alias("snake"), codes.local_name(F.lit("{urn:x}p")).alias("local"), codes.is_on(F.when(F.col("role") == "user", "off").otherwise("1")).alias("is_on"), props.alias("props"))


@query("SELECT event_id, '{\"version\":1,\"type\":\"' || event_type || '\",\"id\":\"' || event_id || '\"}' AS line FROM events")
def ipc_encode(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", catalog.encode_ipc(F.col("event_type"), F.col("event_id").cast("string")).alias("line"))
